"""Text files as numbered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.plans import blockscan as bs


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, value, ord: the line number in its file, from 0.

    Spark reads a file in splits; the generated id grows with the split and inside it. Counting the lines per split
    and adding up the counts gives the line number without sending a whole file through one task.
    """
    raw = spark.read.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias(bs.BLOCK),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    numbered = bs.running_number(raw, ["file"], [F.col("_id")], "ord")
    return numbered.select("file", "value", (F.col("ord") - 1).alias("ord"))


def read_ordered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, value, ord: a number that grows along each file, with gaps; no shuffle and no sort.

    Twice the byte at which the split starts plus the row's place in its task. A split of n bytes has at most n + 1 lines,
    and the next split starts n bytes on; Spark packs several splits into a task only behind a file's whole ones. So the
    numbers of a file are unique and in its order, and stay below about three times its bytes.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("file"), "value", (F.col("_metadata.file_block_start") * 2 + place).alias("ord")
    )
