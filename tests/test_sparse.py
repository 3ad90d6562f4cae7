"""Sparse tables with a fill: the documents and rows they stand for."""

from pyspark.sql import functions as F
from table_rows import rows

from lociframe.operators import catalogue as cat
from lociframe.operators import microbiome as mb
from lociframe.plans.quantiles import exact_quantiles
from lociframe.sinks.documents import catalogue_document

CATALOGUE = "cat_id long, chrom string, pos long, ref string, alt string, extra map<string, string>"
CALLS = "sample_id string, chrom string, pos long, ref string, alt array<string>, raf array<double>, gt string, gp array<double>, ord long"


def tables(spark):
    catalogue = spark.createDataFrame(
        [(9, "chr1", 10, "A", "C", {"n": "x"}), (2, "chr1", 20, "A", "C", None), (5, "chr1", 10, "A", "G", {}), (4, "chr2", 7, "AT", "A", None),
         (7, None, None, "A", "C", {"n": "y"}), (3, "chr3", 3, "C", "T", None)], CATALOGUE
    )
    calls = spark.createDataFrame(
        [("S1", "chr1", 10, "A", ["C"], [0.25], "0|1", [0.0, 1.0, 0.0], 1), ("S1", "chr2", 7, "AT", ["A"], [0.5], "1|1", [0.0, 0.0, 1.0], 2),
         ("S2", "chr1", 20, "A", ["C"], [0.125], "0|1", [0.5, 0.5, 0.0], 1), ("S9", "chr1", 10, "A", ["C"], [0.25], "1|1", [0.0, 0.0, 1.0], 1)], CALLS
    )
    samples = spark.createDataFrame([("S1", 3.0), ("S2", 25.0), ("S3", 30.0), ("S4", 1.5)], "sample_id string, mean_depth double")
    piled = spark.createDataFrame(
        [("S2", "chr3", 3, {"C": 1, "T": 29}, 30), ("S2", "chr1", 10, {"A": 2}, 2), ("S1", "chr3", 3, {"T": 9}, 9)],
        "sample_id string, chrom string, pos long, counts map<string, long>, total long",
    )
    return catalogue, calls, samples, piled


def test_sparse_calls_and_defaults_stand_for_all_rows(spark):
    catalogue, calls, samples, piled = tables(spark)
    full = cat.genotype_catalogue(catalogue, calls, samples, piled)
    sparse = cat.sparse_catalogue(catalogue, calls, samples, piled)
    defaults = cat.default_calls(catalogue, sparse, samples)
    assert full.count() == 24 and sparse.count() == 7
    assert rows(cat.catalogue_summary(sparse, defaults=defaults)) == rows(cat.catalogue_summary(full))
    shown = ("cat_id", "pos", "ref", "alt", "extra", "zygosity", "affected", "call_confidence", "source", "note")
    want = {(r.sample_id, r.cat_id): tuple(r[c] for c in shown) for r in full.collect()}
    docs = catalogue_document(sparse, defaults, catalogue, cat.catalogue_summary(sparse, defaults=defaults)).collect()
    assert len(docs) == 4
    for doc in docs:
        assert [v.cat_id for v in doc.variants] == [2, 3, 4, 5, 7, 9]
        for v in doc.variants:
            got = tuple(v[c] if c in v else v.call[c] for c in shown)
            assert got == want[doc.sample_id, v.cat_id], (doc.sample_id, v)
    by_id = {(d.sample_id, v.cat_id): v.call for d in docs for v in d.variants}
    assert by_id["S1", 9].panel_gt == "0|1" and by_id["S1", 9].panel_af == 0.25 and by_id["S2", 3].depth == 30 and by_id["S4", 2].depth is None


def test_sparse_calls_without_any_call_or_sample(spark):
    catalogue, calls, samples, piled = tables(spark)
    none = cat.sparse_catalogue(catalogue, calls.limit(0), samples, piled.limit(0))
    defaults = cat.default_calls(catalogue, none, samples)
    docs = catalogue_document(none, defaults, catalogue, cat.catalogue_summary(none, defaults=defaults)).collect()
    assert [len(d.variants) for d in docs] == [6] * 4
    assert {v.call.zygosity for d in docs if d.sample_id == "S4" for v in d.variants} == {"not_in_panel", "indel_no_call"}
    assert cat.genotype_catalogue(catalogue, calls, samples.limit(0), piled).count() == 0


def test_a_shared_set_is_one_reference(spark):
    held = spark.createDataFrame(
        [("a", "g1", 1.0), ("a", "g2", 3.0), ("b", "g2", 2.0), ("b", "g1", 5.0), ("c", "g3", 1.0)], "sample_id string, genus string, abundance double"
    )
    samples = spark.createDataFrame([(s,) for s in "abcd"], "sample_id string")
    refs = spark.createDataFrame([(1, "g1", 0.5), (1, "g2", 0.5), (2, "g1", 2.0), (3, "g4", 1.0)], "ref_id long, genus string, abundance double")
    n = spark.createDataFrame([(4,)], "n long")
    sets = mb.feature_sets(held, samples)
    ids = {r.sample_id: r.set_id for r in sets.collect()}
    assert ids["a"] == ids["b"] and len(set(ids.values())) == 3
    found = {}
    for r in mb.set_diversity(sets, refs, n).collect():
        found.setdefault(r.set_id, []).append((r.richness, round(r.shannon, 6), r.w))
    assert sorted(found[ids["a"]]) == [(0, 0.0, 2), (1, 0.0, 1), (2, 0.693147, 1)]
    assert found[ids["c"]] == found[ids["d"]] == [(0, 0.0, 4)]


def test_weighted_quantiles_repeat_rows(spark):
    df = spark.createDataFrame([("k", 1.0, 3), ("k", 5.0, 1), ("m", 2.0, 2), ("k", 9.0, 2)], "k string, v double, w long")
    probs = {"a": 0.25, "b": 0.5, "c": 0.9}
    plain = df.select("k", "v", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("_"))
    assert rows(exact_quantiles(df, ["k"], "v", probs, weight="w")) == rows(exact_quantiles(plain, ["k"], "v", probs))


def test_equal_reference_rows_are_one_profile(spark, monkeypatch):
    """Copies of a reference row add to its weight; they are not met with every set again."""
    rows_of = [(k, f, v) for k in range(40) for f, v in (("x", 1.0 + k % 2), ("y", 3.0))]
    refs = spark.createDataFrame(rows_of, "ref_id long, genus string, abundance double")
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    sets = mb.feature_sets(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "sample_id string, genus string"), samples)
    met, plain = [], mb.diversity
    monkeypatch.setattr(mb, "diversity", lambda long, *rest, **more: met.append(long.count()) or plain(long, *rest, **more))
    got = mb.set_diversity(sets, refs, spark.createDataFrame([(41,)], "n long")).join(sets.select("sample_id", "set_id"), "set_id")
    assert met == [6]  # two profiles, of which set a holds two features and set b one
    assert sorted((r.sample_id, r.richness, r.w) for r in got.collect()) == [("a", 0, 1), ("a", 2, 20), ("a", 2, 20), ("b", 0, 1), ("b", 1, 40)]
