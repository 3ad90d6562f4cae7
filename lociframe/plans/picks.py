"""First / last / best record of a group as an aggregate, so copies are dropped before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Column, picker) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(picker(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row of each key with the smallest `order` (which must be unique within the key)."""
    return _pick(df, keys, F.struct(*order), F.min_by)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row of each key with the largest `order`."""
    return _pick(df, keys, F.struct(*order), F.max_by)
