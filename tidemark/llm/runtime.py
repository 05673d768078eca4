"""What the operators of this subpackage share: slices of Arrow batches, durable intermediate tables, small helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.streaming.jobs import shared_dir

#: Bytes of text that a Python function holds as objects at a time.
SLICE_BYTES = 4 << 20


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches (64 MB at most by Spark's own bound) in zero-copy slices by the bytes of a string or binary column;
    a row that is longer is a slice of its own. What an operator holds does not depend on session settings; before each
    batch, and at the end, the worker gives back what Arrow keeps of those before."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < len(ends):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(low, high - low)
            low = high
        del batch
        pa.default_memory_pool().release_unused()


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it (names differ in more than case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None]) -> None:
    """Tell how to empty a table that an operator keeps in Python workers between tasks."""
    _HELD[name] = clear


def begin(name: str) -> None:
    """An operator starts in a Python worker: tables that others left there go, so that they do not add up, and memory
    that Arrow keeps for later goes back to the system (about 110 MB in a worker that has read 200 MB of texts)."""
    for other, clear in _HELD.items():
        if other != name:
            clear()
    pa.default_memory_pool().release_unused()


def durable(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that outlives executors: the files hold the rows, no executor does. The tables of
    an application lie in one folder named after it and can be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table that ``durable`` wrote and no later step reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    seen = set()
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.toString() not in seen:
            seen.add(path.toString())
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
