"""Catalogue genotyping: known variants against imputed calls, with a read fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import genotypes as gt
from lociframe.operators.reads import call_from_counts
from lociframe.plans.fill import absent
from lociframe.plans.picks import first_by, last_by

MIN_MEAN_DEPTH = 10


def restrict_to_sites(calls: DataFrame, sites: DataFrame, keys: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    """Calls at listed positions only; Spark broadcasts the list when it is small enough."""
    return calls.join(sites.select(*keys), list(keys), "left_semi")


def drop_keys(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Remove entries from a map column."""
    dropped = F.array(*[F.lit(n) for n in names])
    return df.withColumn(column, F.map_filter(column, lambda k, _: ~F.array_contains(dropped, k)))


def lookup_catalogue(
    catalogue: DataFrame, calls: DataFrame, site: Sequence[str] = ("chrom", "pos", "ref"), ord_col: str = "ord"
) -> DataFrame:
    """First call of each sample at each catalogue variant: cat_id, sample_id, gt, gp, panel_af.

    `calls` holds alt and raf as arrays and an `ord` column. The frequency is picked by the position of the allele,
    cut to the length of the list.
    """
    wanted = catalogue.select("cat_id", *site, F.col("alt").alias("_alt")).where(F.col(site[1]).isNotNull())
    listed = restrict_to_sites(calls, wanted.select(*site).distinct(), site)
    split = listed.select("sample_id", *site, "raf", "gt", "gp", ord_col, F.posexplode("alt").alias("_i", "_alt"))
    matched = split.join(wanted, [*site, "_alt"]).withColumn(
        "panel_af", F.when(F.size("raf") > 0, F.get("raf", F.least(F.col("_i"), F.size("raf") - 1)))
    )
    picked = matched.select("cat_id", "sample_id", "gt", "gp", "panel_af", ord_col, "_i")
    return first_by(picked, ["cat_id", "sample_id"], [F.col(ord_col), F.col("_i")]).drop("_i", ord_col)


def call_with_fallback(rows: DataFrame, min_gp: float = 0.90, min_depth: float = MIN_MEAN_DEPTH) -> DataFrame:
    """Final call of each (sample, catalogue variant).

    `rows`: ref, alt, pos, in_panel, gt, gp, mean_depth, counts, total. Order of the rules: indel, panel call behind
    the posterior gate (posteriors at 4 decimals), read call where the mean depth (1 decimal) allows it, else a reason-coded no-call.
    """
    snv = gt.is_snv(F.col("ref"), F.col("alt"), F.col("pos"))
    best = F.round(gt.max_posterior(F.col("gp")), 4)
    confident = best >= min_gp
    deep = F.round("mean_depth", 1) >= min_depth
    read_ok = F.col("read_zygosity").isNotNull()
    rows = call_from_counts(rows)
    zygosity = (
        F.when(~snv, "indel_no_call")
        .when(F.col("in_panel") & confident, gt.zygosity_strict("gt"))
        .when(F.col("in_panel"), "low_gp_no_call")
        .when(deep & read_ok, F.col("read_zygosity"))
        .when(deep, "no_call")
        .otherwise("not_in_panel")
    )
    source = (
        F.when(~snv, "indel")
        .when(F.col("in_panel"), "panel_imputed")
        .when(deep & read_ok, "reads_direct")
        .when(deep, "not_in_panel_insufficient_reads")
        .otherwise("not_in_panel_low_coverage")
    )
    confidence = (
        F.when(F.col("source") == "panel_imputed", F.when(confident, "high").otherwise("low"))
        .when(F.col("source") == "reads_direct", F.col("read_confidence"))
        .otherwise("none")
    )
    note = F.when(
        F.col("zygosity") == "low_gp_no_call", F.format_string("max GP %.2f below %.1f threshold", best, F.lit(min_gp))
    ).when(
        F.col("zygosity") == "not_in_panel",
        F.format_string("Not in panel; depth %.1fx < 10x threshold", F.col("mean_depth")),
    )
    return (
        rows.withColumn("zygosity", zygosity)
        .withColumn("source", source)
        .withColumn("affected", F.col("zygosity").isin("alt/alt", "het"))
        .withColumn("call_confidence", confidence)
        .withColumn("note", note)
    )


def sparse_rows(catalogue: DataFrame, calls: DataFrame, samples: DataFrame, pileups: DataFrame) -> DataFrame:
    """Input rows of `call_with_fallback` for the pairs with a call or reads; their number follows the data."""
    found = lookup_catalogue(catalogue, calls).withColumn("in_panel", F.lit(True))
    placed = catalogue.select("cat_id", "chrom", "pos").where(F.col("pos").isNotNull())
    piled = pileups.select("sample_id", "chrom", "pos", "counts", "total").join(placed, ["chrom", "pos"]).drop("chrom", "pos")
    return (
        found.join(piled, ["cat_id", "sample_id"], "full")
        .withColumn("in_panel", F.coalesce("in_panel", F.lit(False)))
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .join(samples.select("sample_id", "mean_depth"), "sample_id")
        .join(catalogue, "cat_id")
    )


def sparse_catalogue(
    catalogue: DataFrame, calls: DataFrame, samples: DataFrame, pileups: DataFrame, min_gp: float = 0.90
) -> DataFrame:
    """A call for every pair of a sample and a catalogue variant with a call or reads. `samples`: sample_id, mean_depth."""
    return call_with_fallback(sparse_rows(catalogue, calls, samples, pileups), min_gp)


def _without_evidence(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of a pair that has neither a call nor reads, in the types of `like`."""
    types = dict(like.dtypes)
    empty = {c: F.lit(None).cast(types[c]) for c in ("gt", "gp", "panel_af", "counts")}
    return rows.withColumns({**empty, "in_panel": F.lit(False), "total": F.lit(0).cast(types["total"])})


def default_calls(catalogue: DataFrame, sparse: DataFrame, samples: DataFrame, min_gp: float = 0.90) -> DataFrame:
    """The calls of all pairs that `sparse` leaves out, as one row per sample and kind of variant, `n` pairs each.

    Such a call depends on the sample's depth and on whether the variant is a placed SNV, so a few rows stand for all.
    """
    kinds = {"_placed": gt.is_snv(F.col("ref"), F.col("alt"), F.col("pos")), "_snv": gt.is_snv(F.col("ref"), F.col("alt"))}
    listed = catalogue.withColumns(kinds).groupBy(*kinds).agg(
        *[F.min_by(c, "cat_id").alias(c) for c in ("ref", "alt", "pos")], F.count(F.lit(1)).alias("_listed")
    )
    held = sparse.withColumns(kinds).groupBy("sample_id", *kinds).agg(F.count(F.lit(1)).alias("_held"))
    rows = samples.select("sample_id", "mean_depth").join(listed, F.lit(True)).join(held, ["sample_id", *kinds], "left")
    rows = rows.withColumn("n", F.col("_listed") - F.coalesce("_held", F.lit(0))).drop("_listed", "_held", "_snv")
    return call_with_fallback(_without_evidence(rows, sparse), min_gp)


def genotype_catalogue(
    catalogue: DataFrame, calls: DataFrame, samples: DataFrame, pileups: DataFrame, min_gp: float = 0.90
) -> DataFrame:
    """A call for every catalogue variant in every sample, as rows. The staged run keeps the sparse form."""
    some = sparse_rows(catalogue, calls, samples, pileups)
    rest = absent(some, samples, catalogue, "cat_id").join(catalogue, "cat_id").join(samples.select("sample_id", "mean_depth"), "sample_id")
    return call_with_fallback(some.unionByName(_without_evidence(rest, some)), min_gp)


def catalogue_summary(called: DataFrame, keys: Sequence[str] = ("sample_id",), defaults: DataFrame | None = None) -> DataFrame:
    """Counters over the catalogue. A variant without a position counts as an indel and, by its alleles, as an SNV.

    `called` holds all pairs, or the sparse ones if `defaults` stands for the others.
    """
    snv = gt.is_snv(F.col("ref"), F.col("alt"))
    affected, source = F.col("affected"), F.col("source")
    needed = [*keys, "ref", "alt", "affected", "call_confidence", "source"]
    rows = called.select(*needed, F.lit(1).cast("long").alias("n"))
    if defaults is not None:
        rows = rows.unionByName(defaults.select(*needed, "n"))

    def count(rule):
        return F.coalesce(F.sum(F.when(rule, F.col("n"))), F.lit(0).cast("long"))

    return rows.groupBy(*keys).agg(
        F.sum("n").alias("total_screened"),
        count(affected & snv).alias("affected_snv"),
        count(affected & snv & (F.col("call_confidence") == "high")).alias("affected_high_confidence"),
        count(source == "indel").alias("indel_unknown"),
        count(~affected & snv).alias("unaffected"),
        count(source == "panel_imputed").alias("in_panel"),
        count(source == "reads_direct").alias("called_from_reads"),
        count(source.startswith("not_in_panel")).alias("not_callable"),
    )


def match_panel(snps: DataFrame, calls: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Calls at panel SNPs whose two alleles are the SNP's two alleles: sample_id, snp_idx, a1, a2, ref, alt, gp.

    A repeated SNP position means the last SNP row; a repeated call means the last call. Calls here carry ref and alt
    as plain strings, so a multi-allelic call never matches.
    """
    unique = last_by(
        snps.withColumn("chrom", F.concat(F.lit("chr"), F.regexp_replace("chrom", "^chr", ""))).select(
            "chrom", "pos", "snp_idx", "a1", "a2"
        ),
        ["chrom", "pos"],
        ["snp_idx"],
    )
    pair = F.array("a1", "a2")
    joined = calls.select("sample_id", "chrom", "pos", "ref", "alt", "gp", ord_col).join(unique, ["chrom", "pos"])
    usable = joined.where(F.array_contains(pair, F.col("ref")) & F.array_contains(pair, F.col("alt")))
    usable = usable.where(F.size("gp") >= 3)
    return last_by(usable.drop("chrom", "pos"), ["sample_id", "snp_idx"], [ord_col]).drop(ord_col)


def panel_coverage(matched: DataFrame, n_snps: int, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """SNPs with a dosage and their share of the panel in percent."""
    return matched.groupBy(*keys).agg(
        F.count("dosage").alias("snps_used"), (F.count("dosage") / F.lit(n_snps) * 100).alias("pct_covered")
    )
