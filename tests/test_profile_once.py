"""`aligned_features` makes and parses its profile once, and adds what a sample lacks without dealing out full rows."""

from pyspark.sql import functions as F

from lociframe.operators import microbiome as mb
from lociframe.queries.taxa import aligned_features
from lociframe.sources.taxa import parse_profile


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_aligned_features_makes_its_profile_once(spark):
    plan = executed(aligned_features(spark, "/root/testdata/sf0.001"))
    lines = [line for line in plan.splitlines() if "Generate explode(array(concat_ws(" in line and "|s__" in line]
    assert len(lines) == 1, plan
    assert "SortMergeJoin [clade" not in plan


def test_align_features_on_odd_rows(spark):
    samples = spark.createDataFrame([(k,) for k in (1, 2, 3)], "sample_id long")
    features = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "clade string")
    rows = [(1, "a", 1.5), (1, "b", None), (1, "z", 9.0), (2, "a", 2.0), (2, "a", 3.0), (2, None, 4.0), (9, "a", 5.0), (None, "a", 6.0)]
    profile = spark.createDataFrame(rows, "sample_id long, clade string, abundance double")
    got = sorted(tuple(r) for r in mb.align_features(features, samples, profile).collect())
    assert got == [(1, "a", 1.5), (1, "b", 0.0), (1, "c", 0.0), (2, "a", 2.0), (2, "a", 3.0), (2, "b", 0.0), (2, "c", 0.0), (3, "a", 0.0), (3, "b", 0.0), (3, "c", 0.0)]
    assert mb.align_features(features.limit(0), samples, profile).count() == 0
    narrow = mb.align_features(features, samples, profile.withColumn("abundance", F.col("abundance").cast("float")))
    assert dict(narrow.dtypes)["abundance"] == "float"
    packed = mb.pack_profile(profile)
    assert sorted(mb.unpack_profile(packed).dropna().collect()) == sorted(profile.dropna().collect())


def test_the_rank_is_the_text_before_the_first_pair_of_lines(spark):
    clades = ["k__A", "k__A|g__B__C", "k__A|s__", "g", "", "s__x|", "|s__y", "k__A|t__z", "a|b|p__q__r|"]
    lines = spark.createDataFrame([(1, k, f"{c}\t2|77\t1.5") for k, c in enumerate(clades)], "sample_id int, ord int, value string")
    got = {r.ord: (r.clade, r.rank) for r in parse_profile(lines).collect()}
    want = {k: (c, c.split("|")[-1].split("__")[0]) for k, c in enumerate(clades)}
    assert got == {k: v for k, v in want.items() if v[1] in ("k", "p", "c", "o", "f", "g", "s")}
