"""Interval joins and merges without nested loops or whole-key windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.plans import blockscan as bs


def buckets(start: Column, end: Column, width: int) -> Column:
    """All bucket numbers a closed interval touches."""
    return F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    bucket: int = 1_000_000,
    how: str = "inner",
) -> DataFrame:
    """Pairs whose closed intervals share a point. `right` must not share non-key column names with `left`.

    Both sides are spread over the buckets they touch and joined on (keys, bucket); a pair is kept only in the
    bucket where the later of the two starts lies, so each pair comes out once.
    """
    ls, le = left_bounds
    rs, re = right_bounds
    lhs = left.where(F.col(le) >= F.col(ls)).withColumn("_b", F.explode(buckets(F.col(ls), F.col(le), bucket)))
    rhs = right.where(F.col(re) >= F.col(rs)).withColumn("_b", F.explode(buckets(F.col(rs), F.col(re), bucket)))
    pairs = lhs.join(rhs, [*keys, "_b"]).where(
        (F.col(le) >= F.col(rs))
        & (F.col(re) >= F.col(ls))
        & (F.col("_b") == F.floor(F.greatest(ls, rs) / bucket).cast("long"))
    )
    return pairs.drop("_b")


def points_in_intervals(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    bounds: tuple[str, str],
    pos: str,
    interval_id: Sequence[str],
    bucket: int = 1_000_000,
) -> DataFrame:
    """Number of points inside each closed interval: `interval_id` columns and `n_points` (only where > 0)."""
    start, end = bounds
    spread = intervals.where(F.col(end) >= F.col(start)).select(
        *dict.fromkeys([*keys, *interval_id, start, end]),
        F.explode(buckets(F.col(start), F.col(end), bucket)).alias("_b"),
    )
    placed = points.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_b", F.floor(F.col(pos) / bucket).cast("long")
    )
    return (
        spread.join(placed, [*keys, "_b"])
        .where(F.col(pos).between(F.col(start), F.col(end)))
        .groupBy(*interval_id)
        .agg(F.sum("_n").alias("n_points"))
    )


def merge_adjacent(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: Column | int,
    value: str | None = None,
    block_span: int = 1_000_000,
) -> DataFrame:
    """Merge intervals that start no later than `gap` after everything in front of them.

    Output: keys, start, end, n_merged and, when `value` is given, its mean over the merged rows.
    """
    gap = F.lit(gap) if isinstance(gap, int) else gap
    rows = bs.with_block(df.withColumn("_gap", gap), start, block_span)
    order = [F.col(start), F.col(end)]
    rows = bs.running_max(rows, keys, order, F.col(end), "_reach")
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + F.col("_gap"))
    rows = bs.running_max(rows, keys, order, F.when(opens, F.col(start)), "_island", include_current=True)
    measures = [F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")]
    if value:
        measures.append((F.sum(value) / F.count(value)).alias(value))
    return rows.groupBy(*keys, F.col("_island").alias(start)).agg(*measures)
