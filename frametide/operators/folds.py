"""Order-dependent operators: one Arrow pass over rows sorted by key, in place of a Python call for each group.

The pass holds one state (or one group), whatever the number of groups; functions are pickled by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one result batch.
BATCH = 8192


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """Rows that ``step(state, row)`` gives (tuples under ``schema``) for the rows of each key, a dict each, in ``order``; ``start(row)`` makes the state, ``finish(state)`` may add rows."""
    names, width = df.columns, [df.columns.index(k) for k in keys]
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for part in batches:
            for values in zip(*[c.to_pylist() for c in part.columns], strict=True):
                row, key = dict(zip(names, values, strict=True)), tuple(values[i] for i in width)
                if key != now:
                    if now is not None and finish:
                        out += finish(state)
                    now, state = key, start(row)
                out += step(state, row)
                if len(out) >= BATCH:
                    yield batch(out)
                    out = []
        if now is not None and finish:
            out += finish(state)
        if out:
            yield batch(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)


def by_group(df: DataFrame, keys: list[str], order: list[str], kernel: Callable, schema: str) -> DataFrame:
    """Rows that ``kernel(rows)`` gives for each group, a list of dicts in ``order``; groups must be small: a frame, a shot."""

    def add(state: list, row: dict) -> list:
        state.append(row)
        return []

    return fold(df, keys, order, lambda row: [], add, schema, kernel)
