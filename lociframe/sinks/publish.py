"""Writers: JSON documents at the edge, versioned Parquet tables inside.

A stored table lies in `path`/name/run=…/sample_id=…; nothing in it is ever overwritten. A run writes its tables first and
its commit last: `path`/commits/run=… lists every (sample, table) that the run wrote, and counts only once Spark has put
its _SUCCESS file there. Readers take, for each sample, the newest committed run that has the table. So a run that is
killed between two tables, or within one, leaves all of its samples as they were, for all of its tables at once.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lociframe.session import remove_folder
from lociframe.sources.jsondocs import path_exists

#: Files of one sample in a stored table, at most.
SALTS = 8
#: Name prefix of stored tables that are documents to be published.
DOCUMENT = "document_"


def publish(df: DataFrame, name: str, path: str, samples: DataFrame) -> str:
    """One JSON document per sample under `path`/`name`/sample_id=…; other samples' documents stay.

    A sample of `samples` without a row gets an empty document, so that an older one does not outlive its result.
    """
    target = f"{path}/{name}"
    due = samples.select("sample_id").distinct()
    due.join(df, "sample_id", "left").repartition("sample_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").json(target)
    return target


def publish_panel(document: DataFrame, path: str) -> str:
    """The panel-of-normals document, one row."""
    target = f"{path}/panel_coverage"
    document.write.mode("overwrite").json(target)
    return target


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Run numbers of the folders run=… under a path."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/run=*")
    held = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in held or [])


def committed_runs(spark: SparkSession, path: str) -> list[int]:
    return [k for k in _folders(spark, f"{path}/commits") if path_exists(spark, f"{path}/commits/run={k}/_SUCCESS")]


def new_run(spark: SparkSession, path: str) -> int:
    """Number of a new run: the time, but always above every run there is. One process writes to a store at a time."""
    return max([time.time_ns() // 1_000_000, *(k + 1 for k in _folders(spark, f"{path}/commits")[-1:])])


def write_version(df: DataFrame, name: str, path: str, samples: DataFrame, run: int, order: Sequence[str] = ()) -> None:
    """Write a table of one run, not yet visible to readers.

    Each of `samples` also gets one empty marker row, so that the table can be read when no sample has rows. Rows are
    spread by sample and a few salts before writing, so a sample has at most SALTS files and none of its tasks holds a
    whole large sample. With `order` the rows of each file are sorted by these columns.
    """
    marked = df.withColumn("_empty", F.lit(False)).unionByName(
        samples.select("sample_id").distinct().withColumn("_empty", F.lit(True)), allowMissingColumns=True
    )
    spread = F.pmod(F.xxhash64(*[F.col(c) for c, kind in marked.dtypes if "map<" not in kind]), F.lit(SALTS))
    laid = marked.repartition("sample_id", spread)
    if order:
        laid = laid.sortWithinPartitions("sample_id", *order)
    laid.write.mode("overwrite").partitionBy("sample_id").parquet(f"{path}/{name}/run={run}")


def commit(spark: SparkSession, path: str, run: int, written: Sequence[tuple[str, DataFrame]]) -> None:
    """Make the tables of a run visible, all at once, for the samples that each was written for."""
    entries = [samples.select("sample_id", F.lit(name).alias("table")).distinct() for name, samples in written]
    reduce(DataFrame.unionByName, entries).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/run={run}")


def commits(spark: SparkSession, path: str, runs: Sequence[int] | None = None) -> DataFrame:
    """sample_id, table, run of the committed runs, or of the given ones."""
    runs = committed_runs(spark, path) if runs is None else runs
    schema = StructType([StructField("sample_id", StringType()), StructField("table", StringType()), StructField("run", LongType())])
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/commits").parquet(*[f"{path}/commits/run={k}" for k in runs])


def save(df: DataFrame, name: str, path: str, samples: DataFrame, order: Sequence[str] = ()) -> str:
    """Write and commit one table on its own. A sample whose result has no rows still replaces its older rows."""
    spark = df.sparkSession
    run = new_run(spark, path)
    write_version(df, name, path, samples, run, order)
    commit(spark, path, run, [(name, samples)])
    return f"{path}/{name}"


def load(spark: SparkSession, name: str, path: str, own: tuple[int, DataFrame] | None = None) -> DataFrame:
    """Rows of a stored table, from the newest committed run of each sample.

    `own` is an open run and the samples that it has written the table for: it reads those of its own. The id stays a
    partition column, so a join on it prunes the files that are read; its type is given, because Spark would read a
    value such as 007 as a number.
    """
    target = f"{path}/{name}"
    listed = commits(spark, path).where(F.col("table") == name).select("sample_id", "run")
    if own:
        listed = listed.unionByName(own[1].select("sample_id", F.lit(own[0]).cast("long").alias("run")))
    newest = listed.groupBy("sample_id").agg(F.max("run").alias("run"))
    types = {"sample_id": StringType(), "run": LongType()}
    held = spark.read.parquet(target).schema
    typed = StructType([StructField(f.name, types.get(f.name, f.dataType)) for f in held.fields])
    return spark.read.schema(typed).parquet(target).join(newest, ["sample_id", "run"], "left_semi").where(~F.col("_empty")).drop("_empty", "run")


def exists(spark: SparkSession, name: str, path: str) -> bool:
    """Whether any committed run has the table."""
    return not commits(spark, path).where(F.col("table") == name).isEmpty()


def publish_committed(spark: SparkSession, tables: str, public: str) -> None:
    """Publish the documents of committed runs that were not published to the end; safe to repeat."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for run in committed_runs(spark, tables):
        done = f"{tables}/commits/run={run}/_PUBLISHED"
        if path_exists(spark, done):
            continue
        entries = commits(spark, tables, [run]).where(F.col("table").startswith(DOCUMENT))
        for row in entries.select("table").distinct().orderBy("table").collect():
            due = entries.where(F.col("table") == row.table)
            publish(load(spark, row.table, tables), row.table.removeprefix(DOCUMENT), public, due)
        mark = jvm.org.apache.hadoop.fs.Path(done)
        mark.getFileSystem(conf).create(mark).close()


def tidy(spark: SparkSession, name: str, path: str) -> list[int]:
    """Remove the runs of a table that no sample reads any more: replaced or never committed ones. No run may be open."""
    held = commits(spark, path).where(F.col("table") == name)
    used = {r.run for r in held.groupBy("sample_id").agg(F.max("run").alias("run")).select("run").distinct().collect()}
    unused = [k for k in _folders(spark, f"{path}/{name}") if k not in used]
    for run in unused:
        remove_folder(spark, f"{path}/{name}/run={run}")
    return unused
