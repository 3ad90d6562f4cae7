"""Rows that a sparse table leaves out, found from one shared list of all items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def absent(pairs: DataFrame, samples: DataFrame, items: DataFrame, item_key: str) -> DataFrame:
    """sample_id and item of every pair that `pairs` has no row for.

    The list of items is one row, as every full result per sample holds it too; a sample takes its own items out of it.
    Only the present pairs are shuffled.
    """
    listed = items.agg(F.collect_set(item_key).alias("_all"))
    held = pairs.groupBy("sample_id").agg(F.collect_set(item_key).alias("_held"))
    rest = F.when(F.col("_held").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_held"))
    return (
        samples.select("sample_id")
        .join(held, "sample_id", "left")
        .join(listed, F.lit(True))
        .select("sample_id", F.explode(rest).alias(item_key))
    )
