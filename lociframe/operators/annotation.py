"""Annotated variants: gene extents, best effects, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.fixed_values import ANN_FIELDS, EXONIC_EFFECTS
from lociframe.functions import genotypes as gt
from lociframe.functions.text import contains_any, is_fusion_name


def explode_annotations(variants: DataFrame, ann: str = "ann_text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per annotation with `ann_idx` and the named fields; variants without text give no row.

    `keep` names impacts: annotations of others are dropped by a test of their text, before it is split. The split is
    made once per annotation, and reading a field is an array access.
    """
    rows = variants.where(F.length(ann) > 0).select("*", F.posexplode(F.split(ann, ",")).alias("ann_idx", "_a"))
    if keep:
        rows = rows.where(reduce(or_, [F.col("_a").contains(f"|{impact}|") for impact in keep]))
    # An explode of one element keeps the split from being repeated for every field that is read.
    rows = rows.select(*[c for c in rows.columns if c not in ("_a", ann)], F.explode(F.array(F.split("_a", r"\|"))).alias("_f"))
    named = [F.get("_f", i).alias(name) for i, name in enumerate(ANN_FIELDS)]
    return rows.select("*", F.size("_f").alias("n_fields"), *named).drop("_f")


def order_number(df: DataFrame, order: Sequence[str], width: int = 1 << 20) -> Column:
    """One number that orders like `order`, a whole number and the place within it (below `width`); a struct of both where
    the first is no whole number or has too many digits for that."""
    first, place = order
    kind = df.schema[first].dataType
    if not isinstance(kind, T.IntegralType) and not (isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 31):
        return F.struct(*order)
    return (F.col(first).cast("decimal(31,0)") * F.lit(width).cast("decimal(7,0)") + F.col(place)).cast("decimal(38,0)")


def base_effect(effect: Column) -> Column:
    return F.split(effect, "&")[0]


def is_exonic(effect: Column) -> Column:
    """Substring test, so a compound effect counts when any part does."""
    return contains_any(effect, EXONIC_EFFECTS)


def drop_fusion_genes(annotations: DataFrame) -> DataFrame:
    named = (F.coalesce("gene_id", F.lit("")) != "") & (F.coalesce("gene_name", F.lit("")) != "")
    return annotations.where((F.col("n_fields") >= 8) & named & ~is_fusion_name(F.col("gene_name")))


def gene_extents(annotations: DataFrame, keys: Sequence[str] = ("sample_id",), order: Sequence[str] = ("ord", "ann_idx")) -> DataFrame:
    """Gene intervals from all annotated sites; name, chromosome and biotype as first seen (`gene_ord`).

    Rows are reduced to one per gene, way of naming it and place in a site's list first, with plain minima of numbers, and
    only those are compared whole.
    """
    named, (number, place) = ["gene_name", "chrom", "biotype"], order
    spread = F.min("pos").alias("start"), F.max("pos").alias("end"), F.min(number).alias(number)
    few = drop_fusion_genes(annotations).groupBy(*keys, "gene_id", *named, place).agg(*spread)
    few = few.withColumn("gene_ord", order_number(few, order))
    first = F.struct("gene_ord", F.col("gene_name").alias("name"), "chrom", "biotype")
    return (
        few.groupBy(*keys, "gene_id")
        .agg(F.min(first).alias("_first"), F.min("start").alias("start"), F.max("end").alias("end"))
        .select(*keys, "gene_id", "_first.*", "start", "end")
        .withColumn("strand", F.lit("+"))
    )


def exonic_points(annotations: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Distinct exonic positions of each gene, as rows."""
    return drop_fusion_genes(annotations).where(is_exonic(F.col("effect"))).select(*keys, "gene_id", "pos").distinct()


def attach_af(
    variants: DataFrame, calls: DataFrame, keys: Sequence[str] = ("sample_id", "chrom", "pos", "alt"), ord_col: str = "ord"
) -> DataFrame:
    """Panel frequency by position and ALT text; the last call with a readable frequency wins.

    `calls` carries the ALT text in `alt` and the first listed frequency in `af`. The pick is an aggregate of two numbers
    per key, so the calls shrink before they are shuffled, and `variants` is read once.
    """
    usable = calls.where(F.col("af").isNotNull())
    last = usable.groupBy(*keys).agg(F.max_by("af", ord_col).alias("af"))
    return variants.join(last, list(keys), "left")


SITE = ("sample_id", "chrom", "pos", "ref", "alt")


def listed_effects(variants: DataFrame, alt: str = "alt") -> DataFrame:
    """HIGH and MODERATE annotations that name a gene and are for the full ALT text, so a multi-allelic ALT never matches."""
    rows = explode_annotations(variants, keep=("HIGH", "MODERATE"))
    named = F.col("impact").isin("HIGH", "MODERATE") & (F.coalesce("gene_name", F.lit("")) != "") & (F.col("allele") == F.col(alt))
    fields = [c for c in variants.columns if c != "ann_text"]
    return rows.where(named).select(*fields, "ann_idx", "gene_name", "impact", "effect")


def best_effect(variants: DataFrame, ord_col: str = "ord") -> DataFrame:
    """HIGH before MODERATE per variant (`ord_col` and what it has of SITE) and gene, the earlier annotation on ties: the
    columns of `variants` without its text, ann_idx, gene_name, impact, effect.

    Rows are dealt out by site and gene, which `dedupe_effects` asks for as well, so both picks share one shuffle.
    """
    keys = [c for c in SITE if c in variants.columns]
    rows = listed_effects(variants).repartition(*keys, "gene_name")
    rank = F.when(F.col("impact") == "HIGH", 0).otherwise(1)
    own = Window.partitionBy(*keys, "gene_name", ord_col).orderBy(rank, "ann_idx")
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def dedupe_effects(effects: DataFrame, keys: Sequence[str] = SITE, order: Sequence[str] = ("ord", "ann_idx")) -> DataFrame:
    """One row per site, gene and impact, the first in file order."""
    own = Window.partitionBy(*keys, "gene_name", "impact").orderBy(*order)
    return effects.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def rare_count(af: Column, zygosity: Column, threshold: float) -> Column:
    return F.count_if((zygosity == "hom_alt") & (af < threshold))


def effect_counts(effects: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    return (
        effects.where(F.col("impact") == "HIGH")
        .groupBy(*keys, base_effect(F.col("effect")).alias("base_effect"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def moderate_by_gene(
    effects: DataFrame, keys: Sequence[str] = ("sample_id",), gene: str = "gene_name", order: Sequence[str] = ("ord", "ann_idx")
) -> DataFrame:
    """MODERATE variants per gene; the base effects are listed in first-seen order."""
    rows = effects.where(F.col("impact") == "MODERATE").withColumn("_e", base_effect(F.col("effect")))
    seen = rows.groupBy(*keys, gene, "_e").agg(
        F.min(F.struct(*order)).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("zygosity") == "hom_alt").alias("_hom"),
        F.count_if(F.col("zygosity") == "het").alias("_het"),
        F.min(F.when(F.col("zygosity") == "hom_alt", F.col("af"))).alias("_af"),
    )
    listed = F.array_sort(F.collect_list(F.struct("_first", "_e")))
    return seen.groupBy(*keys, gene).agg(
        F.sum("_n").alias("n_moderate"),
        F.sum("_hom").alias("hom_alt"),
        F.sum("_het").alias("het"),
        F.transform(listed, lambda x: x["_e"]).alias("effects"),
        F.min("_af").alias("min_af"),
        F.min("_first").alias("first_seen"),
    )


def order_moderate(by_gene: DataFrame) -> DataFrame:
    return by_gene.orderBy(F.desc("n_moderate"), "first_seen")


def order_high(effects: DataFrame, order: Sequence[str] = ("ord", "ann_idx")) -> DataFrame:
    """hom_alt first, then by frequency with a missing one as 1.0, then by file order."""
    high = effects.where(F.col("impact") == "HIGH")
    return high.orderBy(F.when(F.col("zygosity") == "hom_alt", 0).otherwise(1), F.coalesce("af", F.lit(1.0)), *order)


def impact_summary(effects: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    high, moderate = F.col("impact") == "HIGH", F.col("impact") == "MODERATE"
    hom, het = F.col("zygosity") == "hom_alt", F.col("zygosity") == "het"
    return effects.groupBy(*keys).agg(
        F.count_if(high).alias("high_total"),
        F.count_if(high & hom).alias("high_hom_alt"),
        F.count_if(high & het).alias("high_het"),
        *[
            rare_count(F.col("af"), F.when(high, F.col("zygosity")), t).alias(f"high_hom_rare_{int(t * 100)}pct")
            for t in (0.01, 0.05, 0.10)
        ],
        F.count_if(moderate).alias("moderate_total"),
        F.count_if(moderate & hom).alias("moderate_hom_alt"),
        F.count_if(moderate & het).alias("moderate_het"),
    )


def functional_effects(annotated: DataFrame, calls: DataFrame) -> DataFrame:
    """Deduplicated HIGH and MODERATE effects of the variants a sample carries, with zygosity and frequency."""
    needed = ["sample_id", "ord", "chrom", "pos", "ref", "alt", "ann_text"]
    carried = annotated.where(gt.carries_alt("gt")).select(*needed, gt.zygosity_alt("gt").alias("zygosity"))
    return attach_af(dedupe_effects(best_effect(carried)), calls)
