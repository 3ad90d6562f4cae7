"""Plan helpers against plain Python on random rows, with a key that holds most of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from table_rows import rows

from lociframe.operators.inbreeding import histogram, percentile_rank
from lociframe.plans import blockscan as bs
from lociframe.plans import intervals
from lociframe.plans.picks import first_by, last_by
from lociframe.plans.quantiles import exact_quantiles


def skewed_points(n, seed):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(3000), i) for i in range(n)]


def test_running_number_and_max(spark):
    data = skewed_points(800, 1)
    df = bs.with_block(spark.createDataFrame(data, "k string, pos long, id long"), "pos", 100)
    got = rows(bs.running_number(df, ["k"], ["pos", "id"], "rn"), "k", "pos", "id", "rn")
    top = rows(bs.running_max(df, ["k"], ["pos", "id"], F.col("id"), "top"), "k", "pos", "id", "top")
    total = rows(bs.running_sum(df, ["k"], ["pos", "id"], F.col("id"), "s"), "k", "pos", "id", "s")
    want, want_top, want_sum = [], [], []
    for key in {k for k, _, _ in data}:
        best, acc = None, 0
        for i, (k, pos, ident) in enumerate(sorted(d for d in data if d[0] == key)):
            acc += ident
            want.append((k, pos, ident, i + 1))
            want_top.append((k, pos, ident, best))
            want_sum.append((k, pos, ident, acc))
            best = ident if best is None else max(best, ident)
    assert sorted(got) == sorted(want)
    assert sorted(total) == sorted(want_sum)
    none_last = lambda t: (t[0], t[1], t[2])
    assert sorted(top, key=none_last) == sorted(want_top, key=none_last)


def test_picks(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), ("a", 3, None)], "k string, o int, v string")
    assert rows(first_by(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", 5, "z")]
    assert rows(last_by(df, ["k"], ["o"])) == [("a", 3, None), ("b", 5, "z")]


def test_overlap_join_matches_nested_loops(spark):
    rng = random.Random(3)
    left = [(i, "hot" if rng.random() < 0.6 else "b", s, s + rng.randrange(250)) for i in range(150) for s in [rng.randrange(2000)]]
    right = [(i, "hot" if rng.random() < 0.6 else "b", s, s + rng.randrange(80)) for i in range(150) for s in [rng.randrange(2000)]]
    a = spark.createDataFrame(left, "l long, k string, s long, e long")
    b = spark.createDataFrame(right, "r long, k string, rs long, re long")
    got = rows(intervals.overlap_join(a, b, ["k"], ("s", "e"), ("rs", "re"), bucket=64), "l", "r")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[3] >= y[2] and y[3] >= x[2])
    assert got == want


def test_points_in_intervals(spark):
    rng = random.Random(4)
    spans = [(i, "c", s, s + rng.randrange(100)) for i in range(60) for s in [rng.randrange(1000)]]
    points = [("c", rng.randrange(1100)) for _ in range(300)]
    got = rows(
        intervals.points_in_intervals(
            spark.createDataFrame(spans, "i long, k string, s long, e long"),
            spark.createDataFrame(points, "k string, pos long"),
            ["k"], ("s", "e"), "pos", ["i"], bucket=50,
        )
    )
    want = [(i, n) for i, _, s, e in spans if (n := sum(s <= p <= e for _, p in points))]
    assert got == sorted(want)


@pytest.mark.parametrize("gap", [0, 7, 40])
def test_merge_adjacent(spark, gap):
    rng = random.Random(gap)
    data = [("hot" if rng.random() < 0.7 else "b", s, s + 1 + rng.randrange(60), rng.random()) for s in rng.sample(range(20000), 400)]
    df = spark.createDataFrame(data, "k string, s long, e long, v double")
    got = rows(intervals.merge_adjacent(df, ["k"], "s", "e", gap, "v", block_span=500))
    want = []
    for key in ("hot", "b"):
        cur = None
        for k, s, e, v in sorted(d for d in data if d[0] == key):
            if cur and s <= cur[2] + gap:
                cur[2] = max(cur[2], e)
                cur[3].append(v)
            else:
                cur = [k, s, e, [v]]
                want.append(cur)
    assert [(k, s, e, n) for k, s, e, n, _ in got] == sorted((k, s, e, len(v)) for k, s, e, v in want)
    means = {(k, s): np.mean(v) for k, s, _, v in want}
    assert all(abs(v - means[(k, s)]) < 1e-9 for k, s, _, _, v in got)


def test_merge_touching_border(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 15, 20), ("a", 26, 30)], "k string, s long, e long")
    assert rows(intervals.merge_adjacent(df, ["k"], "s", "e", 5), "s", "e") == [(0, 20), (26, 30)]


def test_exact_quantiles_with_ties_and_skew(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.8 else "b", float(rng.choice([1, 1, 1, 2, 50, rng.randrange(1000)]))) for _ in range(900)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"q10": 0.1, "q50": 0.5, "q99": 0.99}, parts=5).collect()}
    for key in ("hot", "b"):
        want = np.percentile([v for k, v in data if k == key], [10, 50, 99])
        assert np.allclose([got[key]["q10"], got[key]["q50"], got[key]["q99"]], want)
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == np.median([v for _, v in data])


def test_percentile_kinds_by_key(spark):
    rng = random.Random(6)
    ref = [(k, float(rng.randrange(20))) for k in ("a", "b") for _ in range(100)]
    asked = [(k, i, float(rng.randrange(-2, 23))) for k in ("a", "b") for i in range(30)]
    r = spark.createDataFrame(ref, "k string, v double")
    s = spark.createDataFrame(asked, "k string, i int, x double")
    for kind in ("strict", "weak", "rank"):
        got = {(k, i): p for k, i, _, p in percentile_rank(r, s, "v", "x", kind, ["k"]).select("k", "i", "x", "percentile").collect()}
        for k, i, x in asked:
            values = [v for kk, v in ref if kk == k]
            below, upto, n = sum(v < x for v in values), sum(v <= x for v in values), len(values)
            want = {"strict": 100 * below / n, "weak": 100 * upto / n, "rank": (below + upto + (upto > below)) * 50 / n}[kind]
            assert abs(got[(k, i)] - want) < 1e-9


def test_histogram_matches_numpy(spark):
    values = [random.Random(7).gauss(0, 1) for _ in range(1)] + [random.Random(i).gauss(0, 1) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts, edges = np.histogram(values, bins=40, range=(min(values), max(values) + 0.001))
    got = histogram(df, "v").orderBy("bin").collect()
    assert [r["n"] for r in got] == counts.tolist()
    assert np.allclose([r["lower"] for r in got], edges[:-1])
