"""Readers on real files, short rows and missing parts included."""

import gzip
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from table_rows import rows

from lociframe.sources import jsondocs, plink, tables, taxa, vcf
from lociframe.sources.lines import read_lines, read_ordered_lines


def put(folder, name, text):
    path = Path(folder, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def test_line_numbers_over_many_splits(spark, scratch):
    path = put(scratch, "long.txt", "".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = read_lines(spark, path).select("ord", "value").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["ord"], r["value"]) for r in got) == [(i, f"line {i}") for i in range(5000)]


def test_ordered_lines_need_no_shuffle(spark, scratch):
    """Files of many, one and packed splits, blank lines and a gzip file: numbers follow the lines of each file."""
    texts = {"a.txt": [f"a{i}" for i in range(4000)], "b.txt": [f"b{i}" for i in range(3000)], "c.txt": ["c"] * 7, "d.txt": [""] * 30_000, "e.txt.gz": [f"e{i}" for i in range(5000)]}
    paths = [put(scratch, f"ordered/{name}", "".join(line + "\n" for line in lines)) for name, lines in texts.items()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = read_ordered_lines(spark, paths)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        got = df.collect()
        assert df.rdd.getNumPartitions() > 6
        calls = tables.read_calls(spark, paths)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in calls and "Sort" not in calls
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, lines in texts.items():
        mine = sorted((r.ord, r.value) for r in got if r.file.endswith(name))
        assert len({o for o, _ in mine}) == len(mine)
        assert [v for _, v in mine] == lines, name


def test_sample_sheet(spark, scratch):
    path = put(
        scratch, "sheet.tsv",
        "sample_id\tfastq_dir\tage\toutput_name\twork_dir\tpub_dir\tfrom_stage\tsex\tnotes\n"
        "S1\t/in/S1\t3\ts1\t/w\t/p\t4\tM\tx\nS2\t/in/S2\t\t\t\t\t\n\t/in/S3\t1\n",
    )
    got = tables.read_sample_sheet(spark, path)
    assert rows(got.where("sample_id is not null"), "sample_id", "output_name", "work_dir", "from_stage") == [("S1", "s1", "/w", 4), ("S2", "s2", "work/S2", 1)]
    assert rows(got.where("problem is not null"), "problem") == [("empty sample_id",)]
    assert {r["from_stage"] for r in tables.read_sample_sheet(spark, path, from_stage=9).collect()} == {9}
    with pytest.raises(PySparkException):
        tables.valid_samples(got).collect()


def test_contigs_and_coverage(spark, scratch):
    fai = put(scratch, "g.fai", "chr1\t3500\t5\t60\nchrX\t100\nchrY\t50\nchrM\t1\nchrUn_1\t9\n")
    assert rows(tables.read_contigs(spark, fai)) == [("chr1", 3500), ("chrX", 100)]
    cov = put(scratch, "S1.coverage.tsv", "chr1\t0\t100\t250\nchr1\t100\t100\t9\nbad\t1\t2\nchr1\t100\t150\t0\n")
    assert rows(tables.read_coverage(spark, cov)) == [("S1", "chr1", 0, 100, 250, 2.5), ("S1", "chr1", 100, 150, 0, 0.0)]


def test_variant_text(spark, scratch):
    text = (
        "##meta\n#CHROM\n"
        "chr1\t500\t.\tA\tG\t30\tPASS\tDP=3;ANN=G|x|HIGH|G1|i;FLAG\tGP:GT\t0,0,1:1|1\n"
        "chr1\t600\t.\tA\tG\t.\t.\tDP=3\nshort\tline\nchr1\t700\t.\tA\tG,T\t.\t.\tANN=T|y|z;DP=1\tDP\t4\n"
    )
    got = vcf.read_vcf_text(spark, put(scratch, "S9.vcf.gz", text))
    assert rows(got, "sample_id", "pos", "gt", "ann_text") == [("S9", 500, "1|1", "G|x|HIGH|G1|i"), ("S9", 600, "", ""), ("S9", 700, "", "T|y|z")]
    assert rows(got.where("pos = 500"), F.element_at("info", "DP"), "qual") == [("3", 30.0)]


def test_call_text(spark, scratch):
    path = put(scratch, "S1.calls.txt", "chr1\t5\tA\tG,T\t0.1,.\t0|1\t0.1,0.2,0.7\nchr1\t6\tA\tG\t0.3\t./.\t.\nchr1\t7\n")
    got = tables.read_calls(spark, path)
    assert rows(got, "pos", "alt", "raf", "gp") == [(5, ["G", "T"], [0.1, None], [0.1, 0.2, 0.7]), (6, ["G"], [0.3], None)]


def test_panel_files(spark, scratch):
    bim = put(scratch, "p.bim", "1 rs1 0 500 A G\n1\trs2\t0\t600\tC\tT\n")
    assert rows(plink.read_bim(spark, bim)) == [(0, "1", 500, "A", "G"), (1, "1", 600, "C", "T")]
    fam = put(scratch, "p.fam", "GOLD i1 0 0 1 -9\nLAB i2 0 0 1 -9\n")
    assert rows(plink.read_fam(spark, fam)) == [(0, "GOLD"), (1, "LAB")]
    matrix = put(scratch, "p.txt", "0.1 0.5\n0.2  0.25\n")
    assert rows(tables.read_matrix(spark, matrix)) == [(0, [0.1, 0.5]), (1, [0.2, 0.25])]
    labels = put(scratch, "clust.txt", "f i GOLD\nf i LAB\nf i GOLD\nshort\n")
    assert rows(tables.parse_cluster_labels(read_lines(spark, labels)), "label", "ord") == [("GOLD", 0), ("GOLD", 2), ("LAB", 1)]


@pytest.mark.parametrize("n_ind", [1, 4, 6, 28, 29, 57])
def test_packed_genotypes(spark, n_ind):
    codes = {0: 0.0, 1: None, 2: 1.0, 3: 2.0}
    packed, want = [], []
    for snp in range(5):
        calls = [(snp * 7 + i * i) % 4 for i in range(n_ind)]
        out = bytearray((n_ind + 3) // 4)
        for i, code in enumerate(calls):
            out[i // 4] |= code << (2 * (i % 4))
        packed.append((snp, out))
        want += [(snp, i, codes[c]) for i, c in enumerate(calls)]
    df = spark.createDataFrame(packed, "snp_idx long, packed binary")
    got = [tuple(r) for r in plink.unpack_genotypes(df, n_ind).orderBy("snp_idx", "ind_idx").collect()]
    assert got == want


def test_frequencies_and_reference_f(spark, scratch):
    af = put(scratch, "af.tsv.gz", "chr1\t5\t0.25,0.01\nchr1\t6\t.\nbad\n")
    assert rows(tables.read_panel_af(spark, af), "pos", "af") == [(5, 0.25), (6, None)]
    het = put(scratch, "r.het", "ID O E N F\nr1 1 2 3 0.05\nr2 1 2\n r3 1 2 3 -0.5 x\n")
    assert rows(tables.read_ref_f(spark, het)) == [("r1", 0.05), ("r3", -0.5)]


def test_traits(spark, scratch):
    path = put(scratch, "t.csv", "Breed,Energy Level,Shedding Level\nGreat Dane ,5,\nBoxer,x,2\n")
    assert rows(tables.read_traits(spark, path)) == [("Boxer", "Energy Level", "x"), ("Boxer", "Shedding Level", "2"), ("Great Dane", "Energy Level", "5")]


def test_profiles_in_both_layouts(spark, scratch):
    path = put(scratch, "S1.profile.txt", "#c\nk__Bacteria\t2\t97.5\nk__Bacteria|p__X\t2|9\t50\nk__B|p__X|t__Z\t2|9|1\t1\nk__Archaea\t2.5\nk__B|s__A_b\t7.5\tmore\n")
    assert rows(taxa.read_profile(spark, path), "rank", "name", "rel_abundance") == [("k", "Archaea", 2.5), ("k", "Bacteria", 97.5), ("p", "X", 50.0), ("s", "A b", 7.5)]


def test_wide_reference(spark, scratch):
    path = put(scratch, "ref.csv", "AGE,k__B|g__G,k__B|g__G|s__S,k__B|g__G|s__S|t__T\n3,0.5,0.25,0.1\n4,0,0,0\n")
    refs, long = taxa.read_wide_reference(spark, path)
    assert rows(refs) == [(0, 3.0), (1, 4.0)]
    assert rows(long.where(taxa.is_species(F.col("clade"))), "ref_id", "abundance") == [(0, 0.25), (1, 0.0)]
    assert rows(long.where(taxa.is_genus(F.col("clade"))).select("clade").distinct()) == [("k__B|g__G",)]
    with pytest.raises(ValueError):
        taxa.melt_reference(spark.createDataFrame([(1, 2.0)], "ref_id int, `k__B` double"))


def test_json_fallback_and_statistics(spark, scratch):
    second = put(scratch, "b.json", '{"k": 7}')
    schema = "k long"
    assert rows(jsondocs.read_json_or_empty(spark, [f"{scratch}/a.json", second], schema)) == [(7,)]
    assert rows(jsondocs.read_json_or_empty(spark, [f"{scratch}/none.json"], schema)) == []
    doc = '{"summary": {"before_filtering": {"total_reads": 10, "total_bases": 2e9, "q30_rate": 0.9, "read_mean_length": 140}, "after_filtering": {"total_reads": 8, "read1_mean_length": 120}}, "insert_size": {"histogram": [99, 1, 3]}}'
    r = jsondocs.extract_read_stats(spark.createDataFrame([("s", doc)], "sample_id string, json string")).first()
    assert (r["total_reads_raw"], r["total_reads_after_qc"], r["total_bases_raw_gb"], r["read_length_bp"], r["read_length_after_trimming_bp"]) == (10, 8, 2.0, 140.0, 120.0)
    assert r["histogram"] == [99, 1, 3]


def test_chunks_and_lanes(spark, scratch):
    chunks = put(scratch, "chunks.txt", "0\tchr1\tchr1:1-2\tchr1:1-1\n8\tchr1\tchr1:3-4\tchr1:3-3\n")
    failed = put(scratch, "failed.txt", "chr1_chunk8\n\n")
    assert rows(tables.read_chunks(spark, chunks), "chunk_key") == [("chr1_chunk0",), ("chr1_chunk8",)]
    assert rows(tables.read_failed(spark, failed)) == [("chr1_chunk8",)]
    for lane in (2, 10):
        put(scratch, f"fq/s_L{lane}_R1_x.txt", f"lane{lane}\n")
    got = tables.union_lanes(spark, f"{scratch}/fq", 1)
    assert rows(got, "lane_no", "value") == [(0, "lane2"), (1, "lane10")]
    with pytest.raises(PySparkException):
        tables.union_lanes(spark, f"{scratch}/fq", 2)
