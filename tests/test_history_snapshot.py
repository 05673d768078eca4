"""Histories folded into a snapshot: whatever the batches, also events that come again; no node goes through Python."""

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import in_parts
from tidemark.model import NODE
from tidemark.operators import history
from tidemark.sources import ledgerize as L
from tidemark.streaming import history as history_stream
from tidemark.streaming import jobs, snapshot

COLUMNS = [*NODE, "scheduled_event_id", "attempt", "status", "cancel_requested", "result_hash"]


def rows(df):
    return sorted(map(str, df.select(*COLUMNS, F.col("started_at").cast("timestamp")).collect()))


def test_history_is_folded_without_python(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(history_stream.HistoryNode, "handleInputRows", None)
    monkeypatch.setattr(history_stream, "changed_nodes", None)
    events = L.history_events(spark, data)
    got = history_stream.project_stream(in_parts(spark, events, tmp_path / "in", "event_id", 3), str(tmp_path / "nodes"), str(tmp_path / "check"))
    assert rows(got) == rows(history.project(events))


@pytest.mark.parametrize("parts", [2, 5])
def test_batches_that_come_again_change_nothing(spark, tmp_path, parts):
    """Of 50 nodes, whose events are dealt to all batches; each batch comes with all events of the one before."""
    of = F.col("id")
    kinds = F.array(*map(F.lit, ("STARTED", "SCHEDULED", "STARTED", "CANCEL_REQUESTED", "SCHEDULED", "FAILED", "COMPLETED", "STARTED", "CANCEL_REQUESTED")))
    events = spark.range(600).select(
        F.lit("n").alias("namespace"), F.lit("w").alias("workflow_id"), (of % 10).cast("string").alias("run_id"), (of % 5).cast("int").alias("seq"), (of % 50).alias("scheduled_event_id"), of.alias("event_id"),
        F.timestamp_seconds(F.abs(F.hash("id")) % 100_000).alias("event_time"), F.element_at(kinds, (F.abs(F.hash("id", F.lit(2))) % 9 + 1).cast("int")).alias("event_type"),
        F.when(of % 7 != 0, (of % 4).cast("int")).alias("attempt"), F.when(of % 3 != 0, F.sha2(of.cast("string"), 256)).alias("result_hash"),
    ).localCheckpoint()
    path, schema = str(tmp_path / "nodes"), history_stream.StructType.fromDDL(history_stream.ROWS)
    step = 600 // parts
    for i in range(parts):
        batch = events.where((F.col("event_id") >= (i - 1) * step) & (F.col("event_id") < (i + 1) * step))
        for _ in range(2):
            snapshot.fold(batch, i, path, history_stream.fold_events, schema, NODE[:3], 4)
    got = snapshot.read_snapshot(spark, path, schema).withColumn("started_at", F.timestamp_micros("started_us"))
    assert rows(got) == rows(history.project(events)) and got.count() > 40


def test_changes_of_nodes_end_in_the_same_rows(spark, data, tmp_path):
    jobs.use_rocksdb(spark)
    events = L.history_events(spark, data).where("event_id < 400")
    changes = jobs.drain(history_stream.changed_nodes(in_parts(spark, events, tmp_path / "in", "event_id", 2)))
    best = changes.groupBy(*NODE, "scheduled_event_id").agg(F.max_by(F.struct(*changes.columns[5:]), "last").alias("row")).select(*NODE, "scheduled_event_id", "row.*")
    assert rows(best.withColumn("started_at", F.timestamp_micros("started_us"))) == rows(history.project(events))
