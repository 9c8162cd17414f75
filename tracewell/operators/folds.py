"""Rules that go through a key's rows in order, with a state of fixed size."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, schema: str) -> DataFrame:
    """Rows of ``schema`` from ``step(state, row) -> (state, rows out)``, row by row of each key in order; ``step(state, None)`` ends a key.

    Keys are dealt to sorted partitions and stream through: a task holds a batch
    and one state (None at a key's beginning), however many rows the key has. Rows
    have the columns' names and plain Python values, whole numbers exactly and
    nulls as None; null keys are one key.
    """
    kinds = [(c.split()[0], KINDS[c.split()[1]]) for c in schema.split(", ")]
    at, names = [df.columns.index(k) for k in keys], list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # made in the task, as its class has no module that a task could import
        make = namedtuple("Values", names, rename=True)._make  # noqa: PYI024
        key, state, begun = None, None, False

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = tuple(values[i] for i in at)
                if not begun or now != key:
                    if begun:
                        out += step(state, None)[1]
                    key, state, begun = now, None, True
                state, rows = step(state, make(values))
                out += rows
            yield batch_of(out)
        if begun:
            yield batch_of(step(state, None)[1])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
