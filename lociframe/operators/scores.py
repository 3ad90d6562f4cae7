"""Trait scores: thinning, marginal ridge weights, standardised scores, trait units."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.inbreeding import percentile_rank
from lociframe.plans import blockscan as bs
from lociframe.session import cut_lineage

MIN_INDIVIDUALS = 30
UNITS = 256  # individuals or samples of one dense block
SETS = 16  # SNP sets whose coefficients stand next to each other in one block
SNP_BLOCK = 4096
MIN_BREEDS = 20


def thin(
    dosages: DataFrame, step: int = 5, keys: Sequence[str] = ("sample_id",), order: str = "snp_idx", block_span: int = 100_000
) -> DataFrame:
    """Every `step`-th row of each key in `order`, beginning with the first."""
    numbered = bs.running_number(bs.with_block(dosages, order, block_span), list(keys), [F.col(order)], "_rn")
    return numbered.where((F.col("_rn") - 1) % step == 0).drop("_rn", bs.BLOCK)


def snp_sets(thinned: DataFrame, snp: str = "snp_idx") -> tuple[DataFrame, DataFrame]:
    """Group samples that kept the same SNPs: (sample_id, set_id) and (set_id, snp).

    Samples imputed on one panel share one set, so everything about the reference individuals is computed once per
    set, not once per sample. The id is a 128-bit fingerprint of the set.
    """
    a, b = F.xxhash64(snp), F.xxhash64(F.col(snp), F.lit("b"))
    ids = thinned.groupBy("sample_id").agg(
        F.concat_ws(":", F.count(snp), F.bit_xor(a), F.bit_xor(b)).alias("set_id")
    )
    one = ids.groupBy("set_id").agg(F.min("sample_id").alias("sample_id"))
    return ids, thinned.join(one, "sample_id").select("set_id", snp)


def impute_mean(geno: DataFrame, snp: str = "snp_idx", g: str = "g") -> DataFrame:
    """Fill missing genotypes with the SNP's mean over all individuals."""
    means = geno.groupBy(snp).agg(F.avg(g).alias("_mean"))
    return geno.join(means, snp).withColumn(g, F.coalesce(F.col(g).cast("double"), F.col("_mean"))).drop("_mean")


def snp_moments(
    geno: DataFrame, traits: DataFrame, min_individuals: int = MIN_INDIVIDUALS, snp: str = "snp_idx", ind: str = "ind_idx"
) -> DataFrame:
    """Σ(g−ḡ)(y−ȳ) and Σ(g−ḡ)² of every trait and SNP: trait, snp, gy, gg. They do not depend on SNP sets.

    `geno`: snp, ind, g (filled). `traits`: trait, ind, y without nulls. Traits with fewer individuals give no rows.
    """
    enough = traits.groupBy("trait").agg(F.count("y").alias("_n")).where(F.col("_n") >= min_individuals).select("trait")
    rows = geno.join(traits.join(enough, "trait", "left_semi"), ind)
    n = F.count("y")
    return rows.groupBy("trait", snp).agg((F.covar_pop("g", "y") * n).alias("gy"), (F.var_pop("g") * n).alias("gg"))


def ridge_weights(moments: DataFrame, frac: float = 0.1, group: Sequence[str] = ()) -> DataFrame:
    """Weights from moments: group, trait, snp, beta; the penalty is `frac` times the mean variation over the group's SNPs."""
    keys = [*group, "trait"]
    scale = moments.groupBy(*keys).agg(F.avg("gg").alias("_scale"))
    beta = F.col("gy") / (F.col("gg") + frac * F.col("_scale"))
    return moments.join(scale, keys).withColumn("beta", beta).drop("gy", "gg", "_scale")


def marginal_ridge(
    geno: DataFrame, traits: DataFrame, frac: float = 0.1, min_individuals: int = MIN_INDIVIDUALS, snp: str = "snp_idx", ind: str = "ind_idx"
) -> DataFrame:
    """One-SNP ridge weights: trait, snp, beta."""
    return ridge_weights(snp_moments(geno, traits, min_individuals, snp, ind), frac)


def block_products(values: DataFrame, betas: DataFrame, group: str, unit: str, out: str, snp: str = "snp_idx") -> DataFrame:
    """Σ value · beta per group, unit, set and trait, as products of dense blocks: UNITS units by SNP_BLOCK SNPs, times those
    SNPs by the coefficients of the group's sets and traits. No row per unit, set and SNP is ever made.

    `values`: group, unit, snp, v. `betas`: group, set_id, trait, snp, beta; a SNP that a set lacks is zero there.
    """
    n = max(1, -(-int(values.agg(F.approx_count_distinct(unit)).first()[0]) // UNITS))
    spot = F.floor(F.col(snp) / SNP_BLOCK).cast("long").alias("blk")
    left = values.select(F.col(group).alias("grp"), F.col(unit).alias("u"), F.col(snp).alias("s"), F.col("v").cast("double").alias("v"), spot, F.pmod(F.xxhash64(unit), F.lit(n)).alias("part"))
    used = left.select(F.col("grp").alias("g2"), F.col("blk").alias("b2"), F.col("part").alias("p2")).distinct()
    right = betas.select(F.col(group).alias("g1"), "set_id", "trait", F.col(snp).alias("s"), "beta", spot)
    right = right.join(used, (F.col("g1") == F.col("g2")) & (F.col("blk") == F.col("b2"))).select("g2", "b2", "p2", "set_id", "trait", "s", "beta")
    names = ["grp", "u", "set_id", "trait", "x"]

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in names})
        units, u = pd.factorize(a["u"])[::-1]
        snps, s = pd.factorize(a["s"])[::-1]
        sets = b[["set_id", "trait"]].drop_duplicates().reset_index(drop=True)
        column = b.merge(sets.reset_index(names="_c"), on=["set_id", "trait"])
        row = pd.Index(snps).get_indexer(column["s"])
        known = row >= 0
        dense, weights = np.zeros((len(units), len(snps))), np.zeros((len(snps), len(sets)))
        dense[u, s] = a["v"].to_numpy()
        weights[row[known], column["_c"].to_numpy()[known]] = column["beta"].to_numpy()[known]
        made = dense @ weights
        at, c = np.divmod(np.arange(made.size), len(sets))
        pick = sets.iloc[c].reset_index(drop=True)
        return pd.DataFrame({"grp": a["grp"].iloc[0], "u": np.asarray(units)[at], "set_id": pick["set_id"], "trait": pick["trait"], "x": made.ravel()})[names]

    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    parts = left.groupBy("grp", "blk", "part").cogroup(right.groupBy("g2", "b2", "p2")).applyInPandas(
        multiply, f"grp {kinds['grp']}, u {kinds['u']}, set_id string, trait string, x double"
    )
    return parts.groupBy("u", "set_id", "trait").agg(F.sum("x").alias(out)).withColumnRenamed("u", unit)


def weighted_sum(rows: DataFrame, betas: DataFrame, value: str, keys: Sequence[str], on: Sequence[str], out: str) -> DataFrame:
    """Σ value · beta per key and trait."""
    return rows.join(betas, list(on)).groupBy(*keys, "trait").agg(F.sum(F.col(value) * F.col("beta")).alias(out))


def score_and_standardise(
    scores: DataFrame, reference: DataFrame, group: Sequence[str] = (), score: str = "score", ref_score: str = "ref_score"
) -> DataFrame:
    """z score (population deviation) and non-strict percentile of each score in its reference.

    `reference` holds one row per group, trait and reference individual.
    """
    keys = [*group, "trait"]
    reference = cut_lineage(reference)
    stats = reference.groupBy(*keys).agg(F.avg(ref_score).alias("_mean"), F.stddev_pop(ref_score).alias("_sd"))
    ranked = percentile_rank(reference, scores, ref_score, score, "weak", keys)
    return (
        ranked.join(stats, keys)
        .withColumn("prs_z", (F.col(score) - F.col("_mean")) / (F.col("_sd") + 1e-8))
        .drop("_mean", "_sd")
    )


def eligible_traits(breed_scores: DataFrame, minimum: int = MIN_BREEDS) -> DataFrame:
    """Traits with scores for at least `minimum` breeds."""
    return breed_scores.groupBy("trait").agg(F.count("value").alias("n_breeds")).where(F.col("n_breeds") >= minimum)


def breed_trait(panel_breeds: DataFrame, names: DataFrame, values: DataFrame) -> DataFrame:
    """code → trait-table name → value: breed, trait, value. Codes without a name or a value drop out."""
    return panel_breeds.select("breed").distinct().join(
        names.select(F.col("code").alias("breed"), F.col("name").alias("breed_name")), "breed"
    ).join(values, "breed_name").select("breed", "trait", "value")


def unmatched_codes(panel_breeds: DataFrame, names: DataFrame, values: DataFrame) -> DataFrame:
    """Breeds that breed_trait drops, with the name that was looked for."""
    return (
        panel_breeds.select("breed")
        .distinct()
        .join(names.select(F.col("code").alias("breed"), F.col("name").alias("breed_name")), "breed", "left")
        .join(values.select("breed_name").distinct(), "breed_name", "left_anti")
    )


def ordinal_code(value: Column, levels: dict[str, int]) -> Column:
    """Number of a named level, null for other values."""
    out = F.lit(None).cast("double")
    for name, number in levels.items():
        out = F.when(value == name, float(number)).otherwise(out)
    return out


def one_vs_rest(value: Column, category: str) -> Column:
    """1 for the category, 0 for any other value, null when empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", (value == category).cast("double"))


def rescale_score(
    standardised: DataFrame, breed_scores: DataFrame, low: Column | float, high: Column | float, out: str = "predicted"
) -> DataFrame:
    """Back to trait units: mean + z · deviation over breeds (unweighted), cut to [low, high]."""
    units = breed_scores.groupBy("trait").agg(F.avg("value").alias("_mu"), F.stddev_pop("value").alias("_sd"))
    low = F.lit(low) if isinstance(low, (int, float)) else low
    high = F.lit(high) if isinstance(high, (int, float)) else high
    return (
        standardised.join(units, "trait")
        .withColumn(out, F.greatest(low, F.least(high, F.col("_mu") + F.col("prs_z") * F.col("_sd"))))
        .drop("_mu", "_sd")
    )


def argmax_category(scored: DataFrame, keys: Sequence[str], by: str, tie: str) -> DataFrame:
    """The row with the highest `by`; the smallest `tie` wins among equals."""
    rest = [c for c in scored.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(by)).alias("a"), F.col(tie).alias("b")))
    return scored.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def nearest_level(value: Column, levels: dict[str, int]) -> Column:
    """Name of the level closest to the value; the first named one on ties."""
    options = [
        F.struct(F.abs(value - n).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name"))
        for i, (name, n) in enumerate(levels.items())
    ]
    return F.array_min(F.array(*options))["name"]


def carry_over(results: DataFrame, reference: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Copy optional columns of a reference result; null where it has none."""
    return results.join(reference.select(key, *columns), key, "left")


def trait_scores(dosages: DataFrame, geno: DataFrame, individuals: DataFrame, breed_scores: DataFrame, step: int = 5) -> DataFrame:
    """sample_id, trait, score, prs_z, percentile for every sample and every trait with enough individuals.

    `dosages`: sample_id, snp_idx, dosage. `geno`: snp_idx, ind_idx, g (null = missing). `individuals`: ind_idx,
    breed. `breed_scores`: breed, trait, value.
    """
    kept = thin(dosages.where(F.col("dosage").isNotNull()), step)
    members, sets = snp_sets(kept)
    sets, members = cut_lineage(sets), cut_lineage(members)
    filled = impute_mean(geno.join(sets.select("snp_idx").distinct(), "snp_idx", "left_semi"))
    y = individuals.join(breed_scores, "breed").select("trait", "ind_idx", F.col("value").alias("y"))
    # Moments are taken once per trait and SNP; sets meet them, never the genotypes.
    betas = cut_lineage(ridge_weights(snp_moments(filled, y).join(sets, "snp_idx"), group=["set_id"]))
    n_sets = int(sets.agg(F.approx_count_distinct("set_id")).first()[0])
    parts = max(1, -(-n_sets // SETS))
    shared = betas.withColumn("bunch", F.pmod(F.xxhash64("set_id"), F.lit(parts)))
    everyone = filled.select("ind_idx", "snp_idx", F.col("g").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("bunch"))
    theirs = block_products(everyone, shared, "bunch", "ind_idx", "ref_score")
    own = kept.join(members, "sample_id").select("sample_id", "snp_idx", F.col("dosage").alias("v"), F.col("set_id").alias("own"))
    mine = block_products(own, betas.withColumn("own", F.col("set_id")), "own", "sample_id", "score")
    valid = theirs.join(y.select("trait", "ind_idx"), ["trait", "ind_idx"], "left_semi")
    counts = kept.groupBy("sample_id").agg(F.count("snp_idx").alias("n_snps_used"))
    return score_and_standardise(mine, valid, ["set_id"]).drop("set_id").join(counts, "sample_id")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Rank rows of short groups (taxa of a sample, components, features)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
