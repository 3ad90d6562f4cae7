"""Stages 1, 2, 4 and 7: lanes, cleaning, duplicate marks, and the ledger of imputed chunks."""

import pytest
from cohort_data import build, samples_table
from pyspark.sql import functions as F
from table_rows import rows

from lociframe.cohort import Cohort, filter_called_variants, open_chunks, run
from lociframe.operators import reads as rd
from lociframe.sinks.publish import load

NAMES = ["S1", "S2"]
GOOD, POOR = [35] * 40, [5] * 40
CHUNKS = [("chr1", 0, "chr1_chunk0"), ("chr1", 1, "chr1_chunk1"), ("chr2", 0, "chr2_chunk0"), ("chr5", 0, "chr5_chunk0")]
RESULTS = "sample_id string, chunk_key string, attempt long, ok boolean"


def lanes(spark):
    found = []
    for name in NAMES:
        for lane in ("x_L010_R_1", "x_L002_R_1"):
            for mate in (1, 2):
                found.append((name, lane, mate, f"{lane}-whole", "ACGT" * 10, GOOD))
                found.append((name, lane, mate, f"{lane}-mate", "ACGT" * 10, POOR if mate == 2 else GOOD))
                found.append((name, lane, mate, f"{lane}-short", "ACGT" * 5 + "G" * 20, GOOD))
    return spark.createDataFrame(found, "sample_id string, lane string, mate int, read_id string, seq string, qual array<int>")


def chunked(calls):
    """Calls of chr1 lie in two chunks that overlap between 1.9 and 2 Mb, where the second chunk is less sure."""
    low = calls.where("chrom <> 'chr1' OR pos < 2000000").withColumn("chunk_key", F.concat("chrom", F.lit("_chunk0")))
    high = calls.where("chrom = 'chr1' AND pos >= 1900000").withColumn("chunk_key", F.lit("chr1_chunk1"))
    unsure = F.when(F.col("pos") < 2000000, F.array(F.lit(0.33), F.lit(0.33), F.lit(0.34))).otherwise(F.col("gp"))
    return low.unionByName(high.withColumn("gp", unsure))


def ledger(spark, cohort):
    return {(r.sample_id, r.chunk_key): (r.status, r.attempts) for r in load(spark, "chunk_ledger", cohort.tables).collect()}


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("early"))
    inputs = build(spark, NAMES)
    reads = inputs.pop("reads").withColumn("flag", F.col("flag").bitwiseAND(F.lit(~rd.DUPLICATE)).cast("int"))
    again = reads.where("read_id = 'S1chr10' OR read_id = 'S2chr10'")
    worse = again.withColumns({"read_id": F.concat("read_id", F.lit("copy")), "qual": F.transform("qual", lambda q: q - 5)})
    inputs["aligned"] = reads.unionByName(worse)
    inputs["lanes"] = lanes(spark)
    inputs.pop("read_reports")
    calls = inputs.pop("calls")
    inputs["all_calls"] = calls
    inputs["chunk_calls"] = chunked(calls)
    inputs["chunks"] = spark.createDataFrame(CHUNKS, "chrom string, chunk_id int, chunk_key string")
    inputs["failed_chunks"] = spark.createDataFrame([("chr5_chunk0",)], "chunk_key string")
    log = [(n, k, 1, not (n == "S2" and k == "chr1_chunk1")) for n in NAMES for k in ("chr1_chunk0", "chr1_chunk1", "chr2_chunk0")]
    inputs["chunk_results"] = spark.createDataFrame(log, RESULTS)
    return Cohort(spark, inputs, f"{base}/tables", f"{base}/public")


def test_the_run_from_lanes_to_calls(spark, cohort):
    both = samples_table(spark, NAMES)
    assert rows(open_chunks(cohort, both), "sample_id", "chunk_key", "status") == sorted(
        (n, k, "pending") for n in NAMES for _, _, k in CHUNKS[:3]
    )
    assert run(cohort, both, stages=[1, 2, 4, 5, 6, 7, 12]) == [1, 2, 4, 5, 6, 7, 12]
    # Lanes in version order, two reads a lane and mate beside the one that both mates keep.
    assert rows(load(spark, "lane_manifest", cohort.tables), "sample_id", "lane_no", "lane", "reads_1", "reads_2") == sorted(
        (n, i, lane, 3, 3) for n in NAMES for i, lane in enumerate(("x_L002_R_1", "x_L010_R_1"))
    )
    clean = load(spark, "clean_reads", cohort.tables)
    assert {(r.read_id.split("-")[1], r.mate) for r in clean.collect()} == {("whole", 1), ("whole", 2)}
    assert clean.count() == 8
    (doc,) = spark.read.json(f"{cohort.public}/qc_result").where("sample_id = 'S1'").collect()
    assert (doc.total_reads_raw, doc.total_reads_after_qc, doc.read_length_bp, doc.read_length_after_trimming_bp) == (12, 4, 40.0, 40.0)
    assert doc.pct_q30_raw == round(10 / 12 * 100, 1)
    # The worse copy is the duplicate, and only it gets the bit.
    marked = load(spark, "reads", cohort.tables).where(F.col("flag").bitwiseAND(F.lit(rd.DUPLICATE)) != 0)
    usable = cohort.inputs["aligned"].where("read_id LIKE '%copy' AND flag & 4 = 0")
    assert rows(marked.where("read_id LIKE '%copy'"), "read_id") == rows(usable, "read_id")
    assert load(spark, "reads", cohort.tables).count() == cohort.inputs["aligned"].count()


def test_chunks_are_retried_and_stitched(spark, cohort):
    both = samples_table(spark, NAMES)
    first = ledger(spark, cohort)
    assert first[("S1", "chr1_chunk1")] == ("done", 1) and first[("S2", "chr1_chunk1")] == ("failed", 1)
    assert {v for (_, k), v in first.items() if k == "chr5_chunk0"} == {("known_failed", 0)}
    assert rows(load(spark, "done_7", cohort.tables), "sample_id") == [("S1",)]
    assert rows(open_chunks(cohort, both), "sample_id", "chunk_key", "attempts") == [("S2", "chr1_chunk1", 1)]
    calls = cohort.inputs["all_calls"]
    known = calls.where("chrom IN ('chr1', 'chr2')")
    got = load(spark, "calls", cohort.tables)
    columns = ["sample_id", "chrom", "pos", "ref", "gt"]
    # S1 has every site once, with the surer chunk's call where two overlap; S2 lacks what its failed chunk holds alone.
    assert rows(got.where("sample_id = 'S1'"), *columns, "gp") == rows(known.where("sample_id = 'S1'"), *columns, "gp")
    assert rows(got.where("sample_id = 'S2'"), *columns) == rows(known.where("sample_id = 'S2' AND (chrom = 'chr2' OR pos < 2000000)"), *columns)
    # The same log again changes nothing: attempts are counted once.
    assert run(cohort, both, stages=[7, 12], skip_done=True) == [7, 12]
    assert ledger(spark, cohort) == first
    # A good second attempt completes S2. S1 is through and stays; stage 12 follows the new calls.
    cohort.inputs["chunk_results"] = cohort.inputs["chunk_results"].unionByName(spark.createDataFrame([("S2", "chr1_chunk1", 2, True)], RESULTS))
    before = load(spark, "done_12", cohort.tables).count()
    assert run(cohort, both, stages=[1, 2, 4, 5, 6, 7, 12], skip_done=True) == [7, 12]
    assert ledger(spark, cohort)[("S2", "chr1_chunk1")] == ("done", 2)
    assert rows(load(spark, "calls", cohort.tables), *columns) == rows(known, *columns)
    assert load(spark, "done_12", cohort.tables).count() == before == 2
    stats = {r.sample_id: r.n_records for r in load(spark, "call_stats", cohort.tables).collect()}
    assert stats == {r.sample_id: r["count"] for r in known.groupBy("sample_id").count().collect()}
    assert run(cohort, both, stages=[1, 2, 4, 5, 6, 7, 12], skip_done=True) == []
    assert open_chunks(cohort, both).isEmpty()


def test_from_stage_has_effect_on_the_early_stages(spark, cohort):
    later = samples_table(spark, NAMES).withColumn("from_stage", F.when(F.col("sample_id") == "S1", 7).otherwise(8))
    assert run(cohort, later, stages=[1, 2, 4, 7]) == [7]


def test_a_sample_without_lanes_of_both_mates_is_named(spark, tmp_path):
    one = lanes(spark).where("sample_id = 'S1' OR mate = 1")
    part = Cohort(spark, {"lanes": one}, f"{tmp_path}/tables", f"{tmp_path}/public")
    with pytest.raises(ValueError, match="S2"):
        run(part, samples_table(spark, NAMES), stages=[1])
    assert rows(open_chunks(Cohort(spark, {"chunks": spark.createDataFrame(CHUNKS, "chrom string, chunk_id int, chunk_key string")}, f"{tmp_path}/t", ""), samples_table(spark, ["S9"])), "attempts") == [(0,)] * 4


def test_called_variants_are_filtered_and_counted(spark, tmp_path):
    raw = spark.createDataFrame(
        [("S", "chr1", 1, "A", "G", 50.0, 20), ("S", "chr1", 2, "AT", "G", 50.0, 20), ("S", "chr1", 3, "A", "G", 5.0, 20), ("S", "chr1", 4, "A", "G", 50.0, 2)],
        "sample_id string, chrom string, pos long, ref string, alt string, qual double, dp int",
    )
    part = Cohort(spark, {"raw_variants": raw}, f"{tmp_path}/tables", f"{tmp_path}/public")
    got = filter_called_variants(part, samples_table(spark, ["S"]))
    assert rows(got, "n_records", "n_snv", "n_indel") == [(2, 1, 1)]
    assert rows(load(spark, "variants", part.tables), "pos", "filter") == [(1, "PASS"), (2, "PASS")]
