"""Ordered folds: a state machine run over the rows of each key, in order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(df: DataFrame, key: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], dict], out: str) -> DataFrame:
    """``out`` columns for each row: those of ``df`` that it names, and what ``step(state, row)`` returns.

    Rows are dealt by key and sorted within their partition, then streamed: a task holds one Arrow batch and the state
    of one key, however many rows a key or how many keys a partition has.
    """
    schema = StructType.fromDDL(out)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema]
    place = [df.columns.index(k) for k in key]

    def run(batches):
        current, state = None, None
        for batch in batches:
            rows = []
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                mine = tuple(values[i] for i in place)
                if state is None or mine != current:
                    current, state = mine, start()
                row = dict(zip(batch.schema.names, values))
                row.update(step(state, row))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], arrow.field(n).type) for n in names], schema=arrow)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, out)
