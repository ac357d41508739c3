"""Ordered folds over the rows of a key: each key's rows stream in order through one task with a small state.

Greedy selection and next-fit packing depend on all earlier choices, so they are
no window sums.  The rows are shuffled by key and sorted; a task keeps the state
of one key, never its rows, so a key of any size needs little memory.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered(rows: DataFrame, key: str, order: list, step: Callable, start: Callable, columns: str) -> DataFrame:
    """``rows`` with the columns (a DDL string) that ``step(state, row) -> (state, values)`` gives for each row.

    ``start()`` makes the state of a new key.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + columns

    def run(batches):
        now, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != now:
                    now, state = row[key], start()
                state, values = step(state, row)
                out.append(values)
            cols = [pa.array([v[k] for v in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
