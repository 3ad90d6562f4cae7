"""Gapped alignments: what the operations of a read's CIGAR text cover on the reference and on the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVERSE = 16
_SPAN = "struct<start: bigint, end: bigint>"
_BLOCK = "struct<start: bigint, end: bigint, q: bigint>"


def walk(cigar: Column, pos: Column) -> Column:
    """One ordered fold over the operations of `cigar`, for a read whose first aligned base is at `pos` (from 1).

    The result has `blocks` (aligned stretches: start, end, and the 0-based place `q` of the first base in the read),
    `deleted` and `skipped` (stretches of the reference that the read passes over), all closed, and `lead` and `tail`, the
    bases clipped off either end. The fold copies what it has found at each operation, so it suits reads of some hundred
    operations. A read without a CIGAR (null, empty or `*`) gives null.
    """
    operations = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    start = F.struct(
        pos.cast("long").alias("r"),
        F.lit(0).cast("long").alias("q"),
        none(_BLOCK).alias("blocks"),
        none(_SPAN).alias("deleted"),
        none(_SPAN).alias("skipped"),
        F.lit(0).cast("long").alias("lead"),
        F.lit(0).cast("long").alias("tail"),
    )

    def step(acc: Column, operation: Column) -> Column:
        op = F.right(operation, F.lit(1))
        n = F.left(operation, F.length(operation) - 1).cast("long")
        aligned, clipped = op.isin("M", "=", "X"), op.isin("S", "H")
        end = acc["r"] + n - 1
        block = F.struct(acc["r"].alias("start"), end.alias("end"), acc["q"].alias("q"))
        span = F.struct(acc["r"].alias("start"), end.alias("end"))
        opened = F.size(acc["blocks"]) > 0  # clips in front of the first aligned base lead, others trail
        return F.struct(
            (acc["r"] + F.when(aligned | op.isin("D", "N"), n).otherwise(0)).alias("r"),
            (acc["q"] + F.when(aligned | op.isin("I", "S"), n).otherwise(0)).alias("q"),
            F.when(aligned, F.array_append(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"),
            F.when(op == "D", F.array_append(acc["deleted"], span)).otherwise(acc["deleted"]).alias("deleted"),
            F.when(op == "N", F.array_append(acc["skipped"], span)).otherwise(acc["skipped"]).alias("skipped"),
            (acc["lead"] + F.when(clipped & ~opened, n).otherwise(0)).alias("lead"),
            (acc["tail"] + F.when(clipped & opened, n).otherwise(0)).alias("tail"),
        )

    return F.when(F.size(operations) > 0, F.aggregate(operations, start, step))


def five_prime(walked: Column, pos: Column, flag: Column) -> Column:
    """Where the first base of the sequenced fragment would lie if nothing were clipped; on the reverse strand that is
    the read's right end."""
    back = flag.bitwiseAND(F.lit(REVERSE)) != 0
    return F.when(back, walked["r"] - 1 + walked["tail"]).otherwise(pos - walked["lead"])


def with_blocks(reads: DataFrame, gaps: bool = False) -> DataFrame:
    """One row per aligned block of each read: all columns of `reads`, b_start and b_end (closed, from 1) and b_q.

    `gaps` counts deleted and skipped stretches in, so a read is one block from its first to its last aligned base. Reads
    without a CIGAR, and tables without the column, are one block from `pos` to `end`.
    """
    whole = F.struct(F.col("pos").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(0).cast("long").alias("q"))
    if "cigar" not in reads.columns:
        spread = reads.withColumn("_b", whole)
    else:
        walked = reads.withColumn("_w", walk(F.col("cigar"), F.col("pos")))
        reach = F.array(F.struct(F.col("pos").cast("long").alias("start"), (F.col("_w.r") - 1).alias("end"), F.lit(0).cast("long").alias("q")))
        spread = walked.withColumn("_b", F.explode(F.when(F.col("_w").isNull(), F.array(whole)).otherwise(reach if gaps else F.col("_w.blocks")))).drop("_w")
    return spread.select(*reads.columns, F.col("_b.start").alias("b_start"), F.col("_b.end").alias("b_end"), F.col("_b.q").alias("b_q"))
