"""Registry and table access shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that must return the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(col: str, origin: str = "1995-01-01") -> Column:
    """Whole days since `origin`."""
    return F.datediff(F.col(col).cast("date"), F.lit(origin).cast("date")).cast("long")


def sql_days(col: str, origin: str = "1995-01-01") -> str:
    return f"CAST(date_diff('day', DATE '{origin}', CAST({col} AS DATE)) AS BIGINT)"


def seconds(col: str) -> Column:
    """Whole seconds since 1970, from the calendar fields, so that the session's time zone plays no part."""
    c = F.col(col)
    return (F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("long")


def sql_seconds(col: str) -> str:
    return f"CAST(floor(epoch_us({col}) / 1000000.0) AS BIGINT)"


def r(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)
