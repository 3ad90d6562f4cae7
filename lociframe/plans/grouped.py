"""Many small groups through NumPy without a pandas call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[tuple, dict[str, np.ndarray]], list[tuple]],
    schema: str,
) -> DataFrame:
    """`fn(key, columns)` for every group, rows sorted by `order`; it returns output rows without the key.

    Rows are hash-partitioned by key and sorted, and each task streams over its partition, so a task holds one group
    and one batch. The partition count is stated, so that Spark does not fold many cheap-looking but slow groups into
    one task. `schema` names the key columns first.
    """
    keys, order = list(keys), list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    names = [field.split()[0].strip("`") for field in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        held_key = None
        out: list[tuple] = []

        def close():
            rows = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            out.extend(held_key + tuple(r) for r in fn(held_key, columns))

        for pdf in batches:
            if pdf.empty:
                continue
            change = np.zeros(len(pdf), dtype=bool)
            for k in keys:
                values = pdf[k].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(change)
            for a, b in zip([0, *starts], [*starts, len(pdf)], strict=True):
                piece = pdf.iloc[a:b]
                key = tuple(piece[k].iloc[0] for k in keys)
                if held and key != held_key:
                    close()
                    held = []
                held.append(piece)
                held_key = key
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            close()
        if out:
            yield pd.DataFrame(out, columns=names)

    return laid.mapInPandas(run, schema)
