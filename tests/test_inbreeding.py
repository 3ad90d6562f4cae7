"""Runs of homozygosity against a site-by-site walk, and the coefficients."""

import random

from pyspark.sql import functions as F
from table_rows import rows

from lociframe.functions import genotypes as gt
from lociframe.operators import inbreeding as inb


def walk_sites(sites, window, max_het, min_len):
    """Site-by-site search over (pos, het) pairs."""
    out, i = [], 0
    while i <= len(sites) - window:
        if sum(h for _, h in sites[i : i + window]) > max_het:
            i += 1
            continue
        j = i + window
        seen = sum(h for _, h in sites[i:j])
        while j < len(sites) and seen + sites[j][1] <= max_het:
            seen += sites[j][1]
            j += 1
        if sites[j - 1][0] - sites[i][0] >= min_len:
            out.append((sites[i][0], sites[j - 1][0]))
        i = j
    return out


def test_runs_match_site_walk_over_small_blocks(spark):
    rng = random.Random(11)
    data, want = [], []
    for key in range(60):
        n = rng.choice([3, 20, 120, 400])
        share = rng.choice([0.02, 0.1, 0.3, 0.7])
        sites = [(p * 10, rng.random() < share) for p in sorted(rng.sample(range(1000), n))]
        data += [(f"s{key}", "chr1", p, h) for p, h in sites]
        want += [(f"s{key}", a, b) for a, b in walk_sites(sites, 8, 1, 100)]
    df = spark.createDataFrame(data, "sample_id string, chrom string, pos long, is_het boolean")
    for block in (3, 7, 1000):
        got = rows(inb.roh(df, window=8, min_length=100, block_span=500, hets_per_block=block), "sample_id", "start", "end")
        assert got == sorted(want), block


def test_more_hets_allowed(spark):
    rng = random.Random(12)
    sites = [(p, rng.random() < 0.3) for p in sorted(rng.sample(range(5000), 600))]
    df = spark.createDataFrame([("s", "chr1", p, h) for p, h in sites], "sample_id string, chrom string, pos long, is_het boolean")
    for allowed in (0, 2, 3):
        got = rows(inb.roh(df, window=10, max_het=allowed, min_length=50, block_span=100, hets_per_block=9), "start", "end")
        assert got == sorted(walk_sites(sites, 10, allowed, 50)), allowed


def site_rows(name, n, hets, step):
    return [(name, "chr1", i * step, i in hets) for i in range(n)]


def test_borders(spark):
    data = site_rows("too_few", 49, set(), 20_000)
    data += site_rows("just", 50, set(), 20_000)
    data += site_rows("one_het", 60, {30}, 20_000)
    data += site_rows("second_het_at_49", 50, {0, 49}, 20_000)
    data += site_rows("second_het_at_50", 51, {0, 50}, 20_000)
    exact = [(i * 10_000) for i in range(50)] + [500_000]
    data += [("half_mb", "chr1", p, False) for p in exact]
    data += [("short", "chr1", p, False) for p in [*exact[:-1], 499_999]]
    df = spark.createDataFrame(data, "sample_id string, chrom string, pos long, is_het boolean")
    got = {r[0]: r[1:] for r in rows(inb.roh(df), "sample_id", "start", "end")}
    assert got["just"] == (0, 49 * 20_000)
    assert got["one_het"] == (0, 59 * 20_000)
    assert got["second_het_at_50"] == (0, 49 * 20_000)
    assert got["half_mb"] == (0, 500_000)
    assert set(got) == {"just", "one_het", "second_het_at_50", "half_mb"}


def test_levels_and_zero_samples(spark):
    segs = spark.createDataFrame([("a", 0, int(2200e6 * 0.0625))], "sample_id string, start long, end long")
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    got = {r["sample_id"]: (r["level"], r["roh_n_segments"]) for r in inb.froh(segs, samples).collect()}
    assert got == {"a": ("Moderate", 1), "b": ("Very_Low", 0)}


def test_genotype_f_pairs_repeats_once(spark):
    calls = spark.createDataFrame(
        [("s", 1, "chr1", 5, "0|0"), ("s", 2, "chr1", 5, "0|1"), ("s", 3, "chr1", 6, "./."), ("s", 4, "chr1", 9, "1|1")],
        "sample_id string, ord long, chrom string, pos long, gt string",
    )
    panel = spark.createDataFrame([(1, "chr1", 5, 0.5), (2, "chr1", 6, 0.1), (3, "chr1", 6, 0.2), (4, "chr1", 9, None)], "ord long, chrom string, pos long, af double")
    joined = inb.join_af(calls, panel)
    assert rows(joined, "pos", "gt", "af") == [(5, "0|0", 0.5), (6, "./.", 0.1)]
    r = inb.genotype_f(joined, gt.is_hom_biallelic(F.col("gt"))).first()
    assert (r["o_hom"], r["n_obs"]) == (1, 2)
    assert abs(r["e_hom"] - (0.5 + 0.82)) < 1e-12
    fixed = inb.genotype_f(joined.withColumn("af", F.lit(0.0)), gt.is_hom_biallelic(F.col("gt"))).first()
    assert fixed["f"] is None
