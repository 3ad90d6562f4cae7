"""SNP lists, individuals and 2-bit packed genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.sources.lines import read_lines


def parse_bim(lines: DataFrame) -> DataFrame:
    """snp_idx (line number), chrom, pos, a1, a2."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(
        F.col("ord").alias("snp_idx"), f[0].alias("chrom"), f[3].cast("long").alias("pos"), f[4].alias("a1"), f[5].alias("a2")
    )


def parse_fam(lines: DataFrame) -> DataFrame:
    """ind_idx (line number), breed."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(F.col("ord").cast("int").alias("ind_idx"), f[0].alias("breed"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    return parse_bim(read_lines(spark, path))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    return parse_fam(read_lines(spark, path))


def unpack_genotypes(packed: DataFrame, n_ind: int, snp: str = "snp_idx", column: str = "packed") -> DataFrame:
    """Genotypes of a packed row: snp, ind_idx, g (copies of the second allele; null = missing).

    Four individuals per byte, lowest bits first; 00 → 0, 01 → missing, 10 → 1, 11 → 2.
    """
    n_bytes = (n_ind + 3) // 4
    first = F.explode(F.sequence(F.lit(0), F.lit(n_bytes - 1), F.lit(7)))
    # Seven bytes fit a long, so 28 genotypes are cut out of one number with shifts.
    chunks = packed.select(snp, column, first.alias("_at")).select(
        snp,
        "_at",
        F.least(F.lit(7), F.lit(n_bytes) - F.col("_at")).alias("_len"),
        F.conv(F.hex(F.substr(column, F.col("_at") + 1, F.lit(7))), 16, 10).cast("long").alias("_bits"),
    )
    inside = chunks.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(27))))
    ind = F.col("_at") * 4 + F.col("_j")
    shift = (F.col("_len") - 1 - F.floor(F.col("_j") / 4)) * 8 + F.col("_j") % 4 * 2
    code = F.call_function("shiftright", F.col("_bits"), shift.cast("int")).bitwiseAND(F.lit(3))
    g = F.when(code == 0, 0.0).when(code == 2, 1.0).when(code == 3, 2.0)
    return inside.where((F.col("_j") < F.col("_len") * 4) & (ind < n_ind)).select(snp, ind.cast("int").alias("ind_idx"), g.alias("g"))
