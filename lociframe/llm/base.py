"""Registry of the subpackage and the few things its operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bytes of text that a kernel takes at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that must return the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def packed(df: DataFrame, *also: Column) -> DataFrame:
    """All columns of `df` as the struct `doc`, so that no name of theirs can clash with those an operator adds."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), *also)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Slices of `texts` of about `limit` bytes each, so that a kernel's memory does not depend on the batch."""
    if not len(texts):
        return
    ends = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    start, base = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
        yield texts.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


def text_function(make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str | DataType, limit: int = PIECE_BYTES):
    """A column function from Arrow texts to Arrow values.

    `make` runs once per task and gives the function for a piece of texts. Only the text column goes to Python. The
    result counts as nondeterministic so that Spark never evaluates it twice for one row.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for texts in batches:
            done = [fn(piece) for piece in pieces(texts, limit)]
            yield pa.concat_arrays(done) if done else fn(texts)

    return F.arrow_udf(run, kind).asNondeterministic()
