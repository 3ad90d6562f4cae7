"""The staged run end to end, and a cohort against its samples one by one."""

import json
from pathlib import Path

import pytest
from cohort_data import build, samples_table
from pyspark.sql import functions as F

from lociframe import cohort as staged
from lociframe.cohort import Cohort, build_panel, latest_regions, run
from lociframe.sinks.documents import panel_document, region_document
from lociframe.sinks.publish import committed_runs, load, publish, publish_panel, save, tidy

NAMES = ["S1", "S2"]
DOCUMENTS = {
    "coverage_1mb", "qc_result", "cnv_homdel", "catalogue_result", "breed_result", "cnv_genes", "functional_variants", "prs_result",
    "inbreeding_result", "inbreeding_f_result", "coat_color", "microbiome_result", "microbiome_age_result", "microbiome_health_result",
}


def read_documents(folder, name, sample):
    found = []
    for part in sorted(Path(folder, name, f"sample_id={sample}").glob("*.json")):
        found += [json.loads(line) for line in part.read_text().splitlines() if line]
    return found


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("cohort"))
    cohort = Cohort(spark, build(spark, NAMES), f"{base}/tables", f"{base}/public")
    worked = run(cohort, samples_table(spark, NAMES))
    return cohort, worked


def test_every_document_is_written(ran):
    cohort, worked = ran
    assert worked == [5, 6, 8, 9, 10, 11, 12, 13, 15]
    assert {p.name for p in Path(cohort.public).iterdir()} == DOCUMENTS
    for name in DOCUMENTS - {"cnv_genes"}:
        for sample in NAMES:
            assert len(read_documents(cohort.public, name, sample)) == 1, (name, sample)


def test_read_figures_reach_the_quality_document(ran):
    cohort, _ = ran
    (doc,) = read_documents(cohort.public, "qc_result", "S1")
    wanted = {
        "total_reads_raw": 5000, "total_reads_after_qc": 4000, "total_bases_raw_gb": 1.23, "pct_q30_raw": 93.1,
        "read_length_bp": 150.0, "read_length_after_trimming_bp": 148.0, "fragment_size_mean_bp": 3,
    }
    assert {k: doc[k] for k in wanted} == wanted
    marked = cohort.inputs["reads"].where("sample_id = 'S1' AND flag & 2304 = 0 AND flag & 1024 <> 0").count()
    assert doc["duplication_rate_pct"] == round(marked / 4000 * 100, 1)


def test_stored_tables_are_pruned_by_sample_and_keep_ids_as_text(spark, tmp_path):
    ids = spark.createDataFrame([("007",), ("8",)], "sample_id string")
    save(ids.withColumn("v", F.lit(1)), "t", str(tmp_path), ids)
    found = load(spark, "t", str(tmp_path))
    assert sorted(r.sample_id for r in found.collect()) == ["007", "8"]
    one = found.where("sample_id = '007'")
    assert "PartitionFilters: [isnotnull(sample_id" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1


def test_a_rerun_without_rows_replaces_the_document(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    found = ids.withColumn("v", F.lit(1))
    publish(found, "d", str(tmp_path), ids)
    publish(found.where(F.lit(False)), "d", str(tmp_path), ids.where("sample_id = 'a'"))
    assert read_documents(tmp_path, "d", "a") == [{}]
    assert read_documents(tmp_path, "d", "b") == [{"v": 1}]


def test_deletion_is_found_and_annotated(ran):
    cohort, _ = ran
    (doc,) = read_documents(cohort.public, "cnv_homdel", "S1")
    spans = [(r["chrom"], r["start"], r["end"]) for r in doc["regions"]]
    assert any(c == "chr1" and s <= 1_260_000 and e >= 1_350_000 for c, s, e in spans)
    assert doc["summary"]["total_regions"] == len(doc["regions"])
    names = {g["gene"] for g in doc["disrupted_genes"]}
    assert names and names <= {"GENE0", "GENE1", "GENE2", "OTHER"}
    assert doc["summary"]["unique_genes"] == len(names)


def test_catalogue_rows(ran):
    cohort, _ = ran
    (doc,) = read_documents(cohort.public, "catalogue_result", "S2")
    by_id = {v["cat_id"]: v for v in doc["variants"]}
    assert by_id[1]["extra"] == {"name": "one"}
    assert by_id[2]["call"]["zygosity"] in {"not_in_panel", "no_call"}
    assert by_id[3]["call"]["zygosity"] == by_id[4]["call"]["zygosity"] == "indel_no_call"
    assert doc["summary"]["total_screened"] == 4


def test_other_documents(ran):
    cohort, _ = ran
    for sample in NAMES:
        (mix,) = read_documents(cohort.public, "breed_result", sample)
        shares = [b["proportion"] for b in mix["breed_composition"]]
        assert len(shares) == 4 and abs(sum(shares) - 1) < 1e-4 and shares == sorted(shares, reverse=True)
        (prs,) = read_documents(cohort.public, "prs_result", sample)
        assert {t["trait"] for t in prs["physical_traits"]} == {"height_cm", "weight_kg", "coat_type", "coat_length"}
        assert all(1 <= t["predicted"] <= 5 for t in prs["traits"])
        (f,) = read_documents(cohort.public, "inbreeding_f_result", sample)
        assert sum(f["hist_counts"]) == 120 and len(f["hist_edges"]) == 41
        (coat,) = read_documents(cohort.public, "coat_color", sample)
        assert set(coat["loci"]) == set("EKABDMSW")
        assert all(isinstance(v, dict) and "pos" in v for locus in coat["loci"].values() for v in locus["observed_variants"])
        (health,) = read_documents(cohort.public, "microbiome_health_result", sample)
        assert 0 <= health["richness_percentile"] <= 100 and health["n_matched_genera"] == 2


def test_cohort_equals_single_samples(spark, ran, tmp_path):
    cohort, _ = ran
    alone = Cohort(spark, cohort.inputs, f"{tmp_path}/tables", f"{tmp_path}/public")
    run(alone, samples_table(spark, ["S2"]), stages=[5, 6, 12])
    for name in ("coverage_1mb", "qc_result", "inbreeding_result", "inbreeding_f_result"):
        assert read_documents(alone.public, name, "S2") == read_documents(cohort.public, name, "S2"), name


def test_done_samples_are_skipped(spark, ran):
    cohort, _ = ran
    later = samples_table(spark, NAMES).withColumn("from_stage", F.lit(12))
    assert run(cohort, later, stages=[6, 12], skip_done=True) == []


def test_panel_document(spark, ran, tmp_path):
    cohort, _ = ran
    ratios = build_panel(cohort, ["S1", "S2"])
    target = publish_panel(panel_document(ratios, ["S1", "S2"], "pool"), str(tmp_path))
    doc = spark.read.json(target).first()
    assert [c["chrom"] for c in doc["chromosomes"]] == ["chr1", "chr2", "chr5", "chrX"]
    assert doc["_meta"]["n_samples"] == 2


def test_gene_in_several_regions_is_shown_by_pass(spark):
    item = "chrom string, start long, end long, size string, sample_pct_mean long, ref_depth_pct double, verdict string"
    rows = [("S", "chr1", s, s + 10, "10 bp", 0, 90.0, v, ["G"], []) for s, v in ((10, "real"), (30, "real"), (50, "mappability_artefact"))]
    regions = spark.createDataFrame(rows, f"sample_id string, {item}, disrupted_genes array<string>, disrupted_gene_details array<string>")
    pairs = spark.createDataFrame(
        [("S", 0, "G", "b", "chr1", s, s, s + 5, "partial", False) for s in (10, 30, 50)],
        "sample_id string, gene_ord int, gene string, biotype string, chrom string, start long, gene_start long, gene_end long, overlap string, exon_overlap boolean",
    )
    summary = spark.createDataFrame([("S", 3)], "sample_id string, total_regions long")
    shown = {keep: [g.start for g in region_document(regions, pairs, summary, keep).first().disrupted_genes] for keep in ("first", "last")}
    assert shown == {"first": [10], "last": [30]}


def test_regions_are_the_latest_of_each_sample(spark, tmp_path):
    part = Cohort(spark, {}, f"{tmp_path}/tables", f"{tmp_path}/public")
    both = samples_table(spark, NAMES)
    second = both.where("sample_id = 'S2'")
    schema = "sample_id string, chrom string, start long, end long, verdict string, disrupted_genes array<string>"
    first_pass = spark.createDataFrame([(s, "chr1", 1, 9, "real", ["OLD"]) for s in NAMES], schema)
    part.keep(first_pass, "regions", both)
    genes = lambda: {r.sample_id: r.disrupted_genes for r in latest_regions(part, both).collect()}
    assert genes() == {"S1": ["OLD"], "S2": ["OLD"]}
    part.keep(first_pass.where("sample_id = 'S2'").withColumn("disrupted_genes", F.array(F.lit("NEW"))), "regions_annotated", second)
    part.keep(second.select("sample_id", F.lit(10).alias("stage")), "done_10", second)
    assert genes() == {"S1": ["OLD"], "S2": ["NEW"]}


class Killed(Exception):
    pass


def test_a_run_killed_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    """Old tables and documents stay readable, another sample's too, and the next run is whole."""
    part = Cohort(spark, {}, f"{tmp_path}/tables", f"{tmp_path}/public")
    both = samples_table(spark, NAMES)
    state = {"value": 1, "kill": None}

    def stage(c, samples):
        rows = samples.select("sample_id").withColumn("v", F.lit(state["value"]))
        for name in ("one", "two"):
            c.keep(rows, name, samples)
            assert {r.v for r in c.stored(name, samples).collect()} == {state["value"]}
            c.show(rows, f"{name}_result", samples)
            if state["kill"] == name:
                raise Killed

    def seen():
        stored = [sorted((r.sample_id, r.v) for r in load(spark, name, part.tables).collect()) for name in ("one", "two")]
        shown = [sorted((s, d["v"]) for s in NAMES for d in read_documents(part.public, f"{name}_result", s)) for name in ("one", "two")]
        assert stored == shown
        return stored

    monkeypatch.setattr(staged, "STAGES", {5: stage})
    run(part, both)
    assert seen() == [[("S1", 1), ("S2", 1)]] * 2
    state.update(value=2, kill="one")
    with pytest.raises(Killed):
        run(part, both.where("sample_id = 'S2'"))
    assert seen() == [[("S1", 1), ("S2", 1)]] * 2
    # A new driver knows nothing of the killed run.
    part = Cohort(spark, {}, part.tables, part.public)
    state.update(value=3, kill=None)
    run(part, both.where("sample_id = 'S2'"))
    assert seen() == [[("S1", 1), ("S2", 3)]] * 2
    assert len(committed_runs(spark, part.tables)) == 2
    assert len(tidy(spark, "one", part.tables)) == 1 and tidy(spark, "two", part.tables) == []
    assert seen() == [[("S1", 1), ("S2", 3)]] * 2


def test_documents_of_a_committed_run_are_published_by_the_next(spark, tmp_path, monkeypatch):
    part = Cohort(spark, {}, f"{tmp_path}/tables", f"{tmp_path}/public")
    both = samples_table(spark, NAMES)
    rows = both.select("sample_id").withColumn("v", F.lit(1))

    def stop(*_):
        raise Killed

    part.begin()
    part.show(rows, "one_result", both)
    with monkeypatch.context() as m:
        m.setattr(staged.store, "publish", stop)
        with pytest.raises(Killed):
            part.finish()
    assert not Path(part.public).exists()
    Cohort(spark, {}, part.tables, part.public).begin()
    assert [read_documents(part.public, "one_result", s) for s in NAMES] == [[{"v": 1}]] * 2
