"""JSON references, read statistics and flag-summary texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through Spark's own file systems, so it works for shared folders and object stores."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_json_or_empty(spark: SparkSession, paths: Sequence[str], schema) -> DataFrame:
    """First path that exists; an empty table of the schema when none does."""
    for path in paths:
        if path_exists(spark, path):
            return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.createDataFrame([], schema)


def extract_read_stats(docs: DataFrame, json: str = "json") -> DataFrame:
    """Read statistics out of a trimming report; one length key may stand in for the other."""

    def at(path: str) -> Column:
        return F.get_json_object(json, f"$.{path}")

    def length(side: str) -> Column:
        return F.coalesce(at(f"summary.{side}.read1_mean_length"), at(f"summary.{side}.read_mean_length")).cast("double")

    return docs.withColumns(
        {
            "total_reads_raw": at("summary.before_filtering.total_reads").cast("long"),
            "total_reads_after_qc": at("summary.after_filtering.total_reads").cast("long"),
            "total_bases_raw_gb": at("summary.before_filtering.total_bases").cast("double") / 1e9,
            "pct_q30_raw": at("summary.before_filtering.q30_rate").cast("double") * 100,
            "read_length_bp": length("before_filtering"),
            "read_length_after_trimming_bp": length("after_filtering"),
            "histogram": F.from_json(at("insert_size.histogram"), "array<bigint>"),
        }
    ).drop(json)


def fragment_histogram(rows: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Counts by fragment size as an array starting at size 0 (sizes are bounded by the library)."""
    counted = rows.groupBy(*keys, size).agg(F.count(F.lit(1)).alias("_n"))
    listed = F.map_from_entries(F.collect_list(F.struct(F.col(size), F.col("_n"))))
    top = F.max(size)
    filled = F.transform(F.sequence(F.lit(0), F.col("_top")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)))
    return (
        counted.where(F.col(size).isNotNull())
        .groupBy(*keys)
        .agg(listed.alias("_m"), top.alias("_top"))
        .select(*keys, filled.alias("histogram"))
    )


def parse_flag_summary(lines: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Mapped and duplicate primary reads out of a flag-summary text."""
    number = F.regexp_extract("value", r"^(\d+)", 1).try_cast("long")
    mapped = F.col("value").contains("primary mapped") & ~F.col("value").contains("primary duplicate")
    return lines.groupBy(*keys).agg(
        F.max(F.when(mapped, number)).alias("reads_mapped"),
        F.max(F.when(F.col("value").contains("primary duplicates"), number)).alias("primary_duplicates"),
    )
