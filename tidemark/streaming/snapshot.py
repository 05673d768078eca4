"""A snapshot that a stream upserts: hash buckets on disk, and a manifest that says which folder holds each bucket.

A micro-batch is merged with the buckets that its keys fall into; these are written to a folder of their own, then one
commit of the manifest makes them count. All other buckets stay where they are, so a batch costs what it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.manifest import Manifest


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the last committed version."""
    parts = Manifest(spark, path).read().parts
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{p}" for p in parts.values()))


#: Makes rows out of a batch and the rows of the buckets that it touches (None if there are none yet).
Fold = Callable[[DataFrame, DataFrame | None], DataFrame]


def _bucket(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def fold(batch: DataFrame, number: int, path: str, make: Fold, schema: StructType, by: list[str], buckets: int) -> None:
    """Batch ``number`` of a stream without state of its own, folded into the snapshot of rows of ``schema``: the state
    of a key is its row. ``make`` is given both sides with ``_bucket``, dealt by it, and keeps that column; grouped by
    ``_bucket`` and key nothing is shuffled again. What is said of ``merge`` about repeats and crashes holds here too.

    The batch is not kept: its source is read once for the buckets that it touches (not if there are no rows yet) and
    once for the fold.
    """
    spark, manifest = batch.sparkSession, Manifest(batch.sparkSession, path)
    version = manifest.read()
    if version.number >= number:
        return
    buckets = int(version.about.get("buckets", buckets))
    of, folder = _bucket(by, buckets), manifest.fresh("rows")
    touched = [str(r[0]) for r in batch.select(of.alias("b")).distinct().collect()] if version.parts else []  # at most ``buckets`` numbers
    old = [f"{path}/{version.parts[b]}" for b in touched if b in version.parts]
    dealt = lambda rows: rows.withColumn("_bucket", of).repartition(buckets, "_bucket")
    rows = make(dealt(batch), dealt(spark.read.schema(schema).parquet(*old)) if old else None)
    rows.select(*schema.names, "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    manifest.commit({name.removeprefix("_bucket="): f"{folder}/{name}" for name in manifest.folders(folder)}, number, {"buckets": str(buckets)})
    manifest.sweep(["rows"])


def merge(batch: DataFrame, number: int, path: str, key: list[str], order: list[str], by: list[str], buckets: int) -> None:
    """Merge batch ``number`` into the snapshot: of each ``key`` the row of the largest ``order`` stays.

    A batch that was committed before changes nothing, so a batch that is run again after a failure is harmless; what a
    crash left between bucket and manifest is named by no manifest and removed by the next batch. The number of buckets
    is noted by the first batch and holds from then on.
    """
    spark, manifest = batch.sparkSession, Manifest(batch.sparkSession, path)
    version = manifest.read()
    if version.number >= number:
        return
    buckets = int(version.about.get("buckets", buckets))
    names = batch.columns
    kept = [c for c in names if c not in key]
    of = _bucket(by, buckets)
    best = lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("row")).select(*key, "row.*").select(*names)
    batch = batch.persist()
    try:
        touched = [r[0] for r in batch.select(of.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            manifest.commit({}, number, {"buckets": str(buckets)})
            return
        old = [f"{path}/{version.parts[str(b)]}" for b in touched if str(b) in version.parts]
        rows = best(batch)
        if old:
            rows = best(rows.unionByName(spark.read.schema(batch.schema).parquet(*old)))
        folder = manifest.fresh("rows")
        rows.withColumn("_bucket", of).repartition(min(len(touched), buckets), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
        manifest.commit({str(b): f"{folder}/_bucket={b}" for b in touched}, number, {"buckets": str(buckets)})
        manifest.sweep(["rows"])
    finally:
        batch.unpersist()


def upsert_snapshot(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], by: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Drain a stream into a snapshot that holds, for each ``key``, the row of the largest ``order``; gives the snapshot.

    ``by``: the part of the key that buckets are made of (all of it by default). By run, what a run writes falls into
    one bucket. ``buckets`` should keep a bucket near the size of a file.
    """
    return _drain(stream, lambda batch, number: merge(batch, number, path, key, order, by or key, buckets), path, checkpoint, stream.schema)


def fold_snapshot(stream: DataFrame, path: str, checkpoint: str, make: Fold, schema: StructType, by: list[str], buckets: int = 64) -> DataFrame:
    """Drain a stream into a snapshot whose rows are folded out of its batches, see ``fold``; gives the snapshot."""
    return _drain(stream, lambda batch, number: fold(batch, number, path, make, schema, by, buckets), path, checkpoint, schema)


def _drain(stream: DataFrame, step: Callable[[DataFrame, int], None], path: str, checkpoint: str, schema: StructType) -> DataFrame:
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return read_snapshot(stream.sparkSession, path, schema)
