"""Ordered folds: rows of a key in order, one state carried from row to row.

Partitions are sorted by key and order and streamed through Arrow batches, so memory does not grow with
a key's rows; the caller cuts keys that may hold most rows into parts that do not depend on each other.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """df's rows with the columns ``out`` (DDL): ``step(state, *inputs) -> (state, values)``, ``start() -> state`` per key."""
    names = [part.split()[0] for part in out.split(",")]
    kept = df.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            made = []
            for k, row in zip(zip(*(t.column(c).to_pylist() for c in keys)), zip(*(t.column(c).to_pylist() for c in inputs))):
                if k != last or state is None:
                    last, state = k, start()
                state, values = step(state, *row)
                made.append(values)
            cols = list(zip(*made)) if made else [()] * len(names)
            types = [_type(part.split()[1]) for part in out.split(",")]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, x) for c, x in zip(cols, types))], names=[*kept, *names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _type(name: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}[name]
