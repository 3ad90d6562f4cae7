"""Exact quantiles of a column that may be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.session import cut_lineage


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], parts: int | None = None, weight: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per key; `probs` maps an output name to a probability. `weight` counts a row many times.

    Equal values are counted first. The distinct values are laid out in ranges of equal size and written once, so
    the ranks need only one count per range, and each range is ranked on its own.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouping = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*grouping, value).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("_n"))
    laid = cut_lineage(
        counted.repartitionByRange(parts, *grouping, value).withColumn("_part", F.spark_partition_id())
    )
    whole = Window.partitionBy(*grouping)
    front = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        laid.groupBy(*grouping, "_part")
        .agg(F.sum("_n").alias("_in"))
        .withColumn("_before", F.coalesce(F.sum("_in").over(front), F.lit(0)))
        .withColumn("_total", F.sum("_in").over(whole))
    )
    targets = [F.lit(p) * (F.col("_total") - 1) for p in probs.values()]
    ranks = F.array(*[F.floor(t) for t in targets], *[F.ceil(t) for t in targets])
    wanted = ranges.where(
        F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")))
    )
    inside = Window.partitionBy(*grouping, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        laid.join(wanted, [*grouping, "_part"])
        .withColumn("_hi", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )

    def at(rank):
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col(value)))

    picks, finish = [], []
    for name, p in probs.items():
        target = F.lit(p) * (F.col("_total") - 1)
        picks += [at(F.floor(target)).alias(f"_f_{name}"), at(F.ceil(target)).alias(f"_c_{name}")]
        frac = target - F.floor(target)
        finish.append((F.col(f"_f_{name}") + (F.col(f"_c_{name}") - F.col(f"_f_{name}")) * frac).alias(name))
    out = ranked.groupBy(*grouping, "_total").agg(*picks).select(*grouping, *finish)
    return out if keys else out.drop("_all")
