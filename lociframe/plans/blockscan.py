"""Ordered scans over long keys.

A window over (sample, chrom) puts the whole chromosome of a sample in one task. The scans here split each key
into position blocks: a local window runs inside (key, block), one row per block is carried over the blocks in
front of it, and the carry is joined back on (key, block). No task holds more than one block of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def with_block(df: DataFrame, pos: str | Column, span: int | float) -> DataFrame:
    """Add the block number of each row: `pos` cut into stretches of `span`."""
    col = F.col(pos) if isinstance(pos, str) else pos
    return df.withColumn(BLOCK, F.floor(col / F.lit(span)).cast("long"))


def _carried(df: DataFrame, keys: Sequence[str], carries: dict[str, tuple[Column, str, bool]]) -> DataFrame:
    """One row per (keys, block) with each carry taken over the other blocks of the key.

    `carries` maps an output name to (aggregate within a block, fold over blocks, looks forward).
    """
    per_block = df.groupBy(*keys, BLOCK).agg(*[agg.alias(f"_in_{n}") for n, (agg, _, _) in carries.items()])
    back = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
    folds = {"sum": F.sum, "max": F.max, "min": F.min}
    return per_block.select(
        *keys,
        BLOCK,
        *[
            folds[fold](f"_in_{n}").over(ahead if forward else back).alias(n)
            for n, (_, fold, forward) in carries.items()
        ],
    )


def _local(keys: Sequence[str], order: Sequence[Column | str]):
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rn") -> DataFrame:
    """row_number over (keys) by `order`; blocks must follow `order`."""
    carry = _carried(df, keys, {"_before": (F.count(F.lit(1)), "sum", False)})
    local = df.withColumn(out, F.row_number().over(_local(keys, order)).cast("long"))
    return (
        local.join(carry, [*keys, BLOCK])
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop("_before")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """Sum of `value` over the rows of the key up to and including the current row."""
    prepared = df.withColumn("_v", value)
    carry = _carried(prepared, keys, {"_before": (F.sum("_v"), "sum", False)})
    window = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        prepared.withColumn(out, F.sum("_v").over(window))
        .join(carry, [*keys, BLOCK])
        .withColumn(out, F.coalesce(out, F.lit(0)) + F.coalesce("_before", F.lit(0)))
        .drop("_before", "_v")
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: Column,
    out: str,
    include_current: bool = False,
) -> DataFrame:
    """Largest `value` among the rows in front of each row (null where there is none)."""
    prepared = df.withColumn("_v", value)
    carry = _carried(prepared, keys, {"_before": (F.max("_v"), "max", False)})
    window = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    return (
        prepared.withColumn(out, F.max("_v").over(window))
        .join(carry, [*keys, BLOCK])
        .withColumn(out, F.greatest(F.col(out), F.col("_before")))
        .drop("_before", "_v")
    )


def ordinals_with_neighbours(
    df: DataFrame, keys: Sequence[str], pos: str, order: Sequence[Column | str], mark: str
) -> DataFrame:
    """Add to each row, in one scan over the blocks: `ordinal` (from 0), the previous and next `pos` of the key as
    `prev_pos` and `next_pos`, and `mark_no`, the number of rows with `mark` up to and including this one."""
    marked = F.count_if(F.col(mark))
    carry = _carried(
        df,
        keys,
        {
            "_before": (F.count(F.lit(1)), "sum", False),
            "_marks": (marked, "sum", False),
            "_last": (F.max(pos), "max", False),
            "_first": (F.min(pos), "min", True),
        },
    )
    window = _local(keys, order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("ordinal", F.row_number().over(window).cast("long") - 1)
        .withColumn("prev_pos", F.lag(pos).over(window))
        .withColumn("next_pos", F.lead(pos).over(window))
        .withColumn("mark_no", F.sum(F.col(mark).cast("long")).over(upto))
        .join(carry, [*keys, BLOCK])
        .withColumn("ordinal", F.col("ordinal") + F.coalesce("_before", F.lit(0)))
        .withColumn("mark_no", F.col("mark_no") + F.coalesce("_marks", F.lit(0)))
        .withColumn("prev_pos", F.coalesce("prev_pos", "_last"))
        .withColumn("next_pos", F.coalesce("next_pos", "_first"))
        .drop("_before", "_marks", "_last", "_first")
    )
