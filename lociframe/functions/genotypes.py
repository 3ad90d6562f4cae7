"""Genotype, posterior and allele expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alleles(gt: str | Column) -> Column:
    return F.split(gt, r"[|/]")


def allele_subset(left: Column, right: Column) -> Column:
    """Every member of array `left` is in array `right`."""
    return F.size(F.array_except(left, right)) == 0


def zygosity_strict(gt: str | Column) -> Column:
    """Only 1s: alt/alt, only 0s: ref/ref, anything else counts as het (also ./. and 2|2)."""
    seen = F.array_distinct(alleles(gt))
    return (
        F.when(seen == F.array(F.lit("1")), "alt/alt").when(seen == F.array(F.lit("0")), "ref/ref").otherwise("het")
    )


def carries_alt(gt: str | Column) -> Column:
    """False when the call holds nothing but 0 and '.'; an empty call is kept."""
    return ~allele_subset(alleles(gt), F.array(F.lit("0"), F.lit(".")))


def zygosity_alt(gt: str | Column) -> Column:
    """Zygosity of a call that carries an alternative allele; null when it does not."""
    parts = alleles(gt)
    named = (
        F.when(F.array_distinct(parts) == F.array(F.lit("1")), "hom_alt")
        .when(F.array_contains(parts, "0") & F.array_contains(parts, "1"), "het")
        .otherwise("other")
    )
    return F.when(carries_alt(gt), named)


def is_het(gt: str | Column) -> Column:
    """Null when any allele is missing, else whether the alleles differ."""
    parts = alleles(gt)
    return F.when(~F.array_contains(parts, "."), F.size(F.array_distinct(parts)) > 1)


def is_hom_biallelic(gt: Column) -> Column:
    """Missing and multi-allelic calls are observed but not homozygous."""
    return F.coalesce(gt.isin("0|0", "1|1", "0/0", "1/1"), F.lit(False))


def alt_copies(gt: str | Column) -> Column:
    return F.size(F.filter(alleles(gt), lambda a: a == "1"))


def max_posterior(gp: Column) -> Column:
    return F.coalesce(F.array_max(gp), F.lit(0.0))


def passes_posterior(gp: Column, threshold: float = 0.90) -> Column:
    return max_posterior(gp) >= threshold


def posterior_tier(max_gp: Column, accept: float = 0.80, high: float = 0.90) -> Column:
    return F.when(max_gp >= high, "high").when(max_gp >= accept, "medium").otherwise("low")


def is_swapped(ref: Column, alt: Column, exp_ref: Column, exp_alt: Column) -> Column:
    """The call lists the expected alleles the other way round; never true without an expectation."""
    return F.coalesce((ref == exp_alt) & (alt == exp_ref), F.lit(False))


def oriented_copies(n_alt: Column, swapped: Column) -> Column:
    return F.when(swapped, 2 - n_alt).otherwise(n_alt)


def dosage_first(ref: Column, a1: Column, gp: Column) -> Column:
    """Expected copies of the panel's first allele; null without three posteriors."""
    value = F.when(ref == a1, 2 * F.get(gp, 0) + F.get(gp, 1)).otherwise(F.get(gp, 1) + 2 * F.get(gp, 2))
    return F.when(F.size(gp) >= 3, value)


def dosage_second(alt: Column, a2: Column, gp: Column) -> Column:
    """Expected copies of the panel's second allele; null without three posteriors."""
    value = F.when(alt == a2, F.get(gp, 1) + 2 * F.get(gp, 2)).otherwise(2 * F.get(gp, 0) + F.get(gp, 1))
    return F.when(F.size(gp) >= 3, value)


def is_snv(ref: Column, alt: Column, pos: Column | None = None) -> Column:
    """Both alleles are one base; with `pos` the position must be given and not 0 as well."""
    single = (F.length(F.coalesce(ref, F.lit(""))) == 1) & (F.length(F.coalesce(alt, F.lit(""))) == 1)
    return single if pos is None else single & (F.coalesce(pos, F.lit(0)) != 0)


def genotype_from_counts(n_ref: Column, n_alt: Column) -> Column:
    fraction = n_alt / F.nullif(n_ref + n_alt, F.lit(0))
    return F.when(fraction < 0.1, "ref/ref").when(fraction > 0.9, "alt/alt").otherwise("het")


def depth_tier(total: Column, high: int = 20, medium: int = 10) -> Column:
    return F.when(total >= high, "high").when(total >= medium, "medium").otherwise("low")
