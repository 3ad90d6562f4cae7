"""Taxon profiles and the wide reference table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.fixed_values import TAXON_RANKS
from lociframe.operators.microbiome import leaf_name
from lociframe.sources.lines import read_lines


def parse_profile(lines: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """clade, rank, name, rel_abundance of the seven main ranks.

    The percent is the third column when the second holds taxon numbers, else the second.
    """
    rows = lines.where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 2)
    numbered = (F.size("f") >= 3) & F.get("f", 1).rlike(r"^\|*[0-9][0-9|]*$")
    clade = F.get("f", 0)
    rank = F.substring_index(F.substring_index(clade, "|", -1), "__", 1)
    return rows.select(
        *keys,
        "ord",
        clade.alias("clade"),
        rank.alias("rank"),
        leaf_name(clade).alias("name"),
        F.when(numbered, F.get("f", 2)).otherwise(F.get("f", 1)).try_cast("double").alias("rel_abundance"),
    ).where(F.col("rank").isin(*TAXON_RANKS))


def read_profile(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    lines = read_lines(spark, path)
    return parse_profile(lines.withColumn("sample_id", F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)))


def is_species(clade: Column) -> Column:
    return clade.contains("|s__") & ~clade.contains("|t__")


def is_genus(clade: Column) -> Column:
    return clade.contains("|g__") & ~clade.contains("|s__") & ~clade.contains("|t__")


def melt_reference(wide: DataFrame, ref_id: str = "ref_id") -> tuple[DataFrame, DataFrame]:
    """(ref_id, age) and (ref_id, clade, feature_ord, abundance); fails without an age column."""
    age = next((c for c in wide.columns if c.lower() == "age"), None)
    if age is None:
        raise ValueError("the reference table has no age column")
    clades = [(i, c) for i, c in enumerate(wide.columns) if "__" in c]
    cells = F.array(
        *[F.struct(F.lit(c).alias("clade"), F.lit(i).alias("feature_ord"), F.col(f"`{c}`").cast("double").alias("abundance")) for i, c in clades]
    )
    long = wide.select(ref_id, F.explode(cells).alias("x")).select(ref_id, "x.*")
    return wide.select(ref_id, F.col(f"`{age}`").cast("double").alias("age")), long


def read_wide_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Wide CSV with one row per reference sample; ref_id is the row number in the file."""
    lines = read_lines(spark, path)
    header = spark.read.csv(path, header=True).columns
    f = F.split("value", ",")
    rows = lines.where((F.col("ord") > 0) & (F.trim("value") != ""))
    wide = rows.select((F.col("ord") - 1).alias("ref_id"), *[F.get(f, i).alias(c) for i, c in enumerate(header)])
    return melt_reference(wide)
