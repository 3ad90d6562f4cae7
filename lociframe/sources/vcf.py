"""Annotated variant text as rows. Files are plain or gzipped text; this is a projection of their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.sources.lines import read_ordered_lines


def parse_vcf(lines: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """chrom, pos, ref, alt (text), info (map), gt, ann_text; header and short lines are dropped.

    `gt` is '' where the line has no genotype. Of a repeated INFO key the last entry counts.
    """
    rows = lines.where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 8)

    def at(i):
        return F.get("f", i)

    entries = F.transform(F.filter(F.split(at(7), ";"), lambda x: x.contains("=")), lambda x: F.split(x, "=", 2))
    info = F.map_from_entries(F.transform(entries, lambda e: F.struct(e[0].alias("k"), e[1].alias("v"))))
    slot = F.array_position(F.split(at(8), ":"), "GT")
    gt = F.when((F.size("f") >= 10) & (slot > 0), F.get(F.split(at(9), ":"), (slot - 1).cast("int")))
    return rows.select(
        *keys,
        "ord",
        at(0).alias("chrom"),
        at(1).try_cast("long").alias("pos"),
        at(3).alias("ref"),
        at(4).alias("alt"),
        at(5).try_cast("double").alias("qual"),
        at(6).alias("filter"),
        info.alias("info"),
        F.coalesce(gt, F.lit("")).alias("gt"),
    ).withColumn("ann_text", F.coalesce(F.try_element_at("info", F.lit("ANN")), F.lit("")))


def read_vcf_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Variant files, one per sample; the sample is the file name up to the first dot."""
    lines = read_ordered_lines(spark, path)
    return parse_vcf(lines.withColumn("sample_id", F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)))
