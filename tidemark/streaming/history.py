"""Event histories as a stream.

``project_stream`` keeps nodes in a snapshot: the row of a node is its state, and a batch is folded into it by one
aggregate in the JVM. ``changed_nodes`` keeps the same state by node in the state store and gives a node's row whenever
it changes; each node costs several calls to a Python worker a batch, so it is for small batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from tidemark.model import NODE
from tidemark.operators.history import TERMINAL_EVENTS
from tidemark.streaming.snapshot import fold_snapshot

_KEY = [*NODE, "scheduled_event_id"]
_FIELDS = {"attempt": IntegerType(), "started_us": LongType(), "status": StringType(), "cancel_requested": BooleanType(), "result_hash": StringType(), "closed": BooleanType(), "last": LongType()}
_STATE = StructType()
for _name, _kind in _FIELDS.items():
    _STATE = _STATE.add(_name, _kind)
ROWS = (
    "namespace string, workflow_id string, run_id string, seq int, scheduled_event_id long, attempt int, started_us long, "
    "status string, cancel_requested boolean, result_hash string, closed boolean, last long"
)


class HistoryNode(StatefulProcessor):
    """One scheduled node. Events count from its SCHEDULED event on, in order of ``event_id``; those up to the last one
    taken are repeats."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("node", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        node = dict(zip(_FIELDS, self.state.get())) if self.state.exists() else None
        before = dict(node) if node else None
        for row in pd.concat(list(rows)).sort_values("event_id").itertuples(index=False):
            kind = row.event_type
            if node is None:
                if kind == "SCHEDULED":
                    node = {"attempt": None, "started_us": None, "status": "SCHEDULED", "cancel_requested": False, "result_hash": None, "closed": False, "last": int(row.event_id)}
                continue
            if row.event_id <= node["last"]:
                continue
            node["last"] = int(row.event_id)
            if kind == "STARTED":
                node["attempt"] = None if pd.isna(row.attempt) else int(row.attempt)
                node["started_us"] = max(int(row.time_us), node["started_us"] or int(row.time_us))
            elif kind == "CANCEL_REQUESTED" and not node["closed"]:
                node["cancel_requested"] = True
            elif kind in TERMINAL_EVENTS:
                node["status"], node["closed"] = kind, True
                if kind == "COMPLETED":
                    node["result_hash"] = row.result_hash
        if node is None or node == before:
            return
        self.state.update(tuple(node[n] for n in _FIELDS))
        frame = pd.DataFrame([(*key, *(node[n] for n in _FIELDS))], columns=[p.split()[0] for p in ROWS.split(", ")])
        yield frame.astype({"attempt": "Int32", "started_us": "Int64"})

    def close(self) -> None:
        pass


def changed_nodes(events: DataFrame) -> DataFrame:
    """A node's row after each batch that changed it; the one with the largest ``last`` stands. Needs the RocksDB state
    store; events of a node must come in order from one batch to the next."""
    chosen = events.select(*_KEY, "event_id", "event_type", "attempt", F.unix_micros(F.col("event_time").cast("timestamp")).alias("time_us"), "result_hash")
    return chosen.groupBy(*_KEY).transformWithStateInPandas(statefulProcessor=HistoryNode(), outputStructType=StructType.fromDDL(ROWS), outputMode="Update", timeMode="None")


def fold_events(events: DataFrame, old: DataFrame | None) -> DataFrame:
    """Rows of nodes out of a batch of events and the rows that its nodes may have had before (both with ``_bucket``).

    The rule of ``HistoryNode``: a row counts as the events up to its ``last``. Windows and aggregate are by the same
    key, so events are sorted once.
    """
    key, fields = ["_bucket", *_KEY], list(_FIELDS)
    kind, at = F.col("event_type"), F.col("event_id")
    only = lambda what, value: F.when(kind == what, value)
    time = F.unix_micros(F.col("event_time").cast("timestamp"))
    rows = events.select(*key, "event_id", "event_type", only("STARTED", F.col("attempt")).alias("attempt"), only("STARTED", time).alias("time_us"), only("COMPLETED", F.col("result_hash")).alias("result_hash"))
    rows = rows.withColumn("was", F.lit(None).cast(_STATE))
    if old is not None:
        rows = rows.unionByName(old.select(*key, F.col("last").alias("event_id"), F.struct(*fields).alias("was")), allowMissingColumns=True)
    had = F.col("was").isNotNull()
    opened = F.coalesce(F.max(F.when(had, at)).over(Window.partitionBy(*key)), F.min(only("SCHEDULED", at)).over(Window.partitionBy(*key)))
    after = rows.withColumn("_opened", opened).where(had | (at > F.col("_opened")) | ((at == F.col("_opened")) & (kind == "SCHEDULED")))
    ends = kind.isin(*TERMINAL_EVENTS)
    last = lambda test, value: F.max_by(F.when(test, value), F.when(test, at))
    found = after.groupBy(*key).agg(
        F.first("was", ignorenulls=True).alias("was"),
        F.max(only("STARTED", at)).isNotNull().alias("_started"), last(kind == "STARTED", F.col("attempt")).alias("_attempt"), F.max("time_us").alias("_time"),
        F.max(only("COMPLETED", at)).isNotNull().alias("_completed"), last(kind == "COMPLETED", F.col("result_hash")).alias("_hash"),
        last(ends, kind).alias("_status"), F.min(F.when(ends, at)).alias("_end"), F.min(only("CANCEL_REQUESTED", at)).alias("_cancel"), F.max("event_id").alias("last"),
    )
    flag = lambda c: F.coalesce(c, F.lit(False))
    return found.select(
        *key,
        F.when(F.col("_started"), F.col("_attempt")).otherwise(F.col("was.attempt")).alias("attempt"),
        F.greatest("was.started_us", "_time").alias("started_us"),
        F.coalesce("_status", "was.status", F.lit("SCHEDULED")).alias("status"),
        (flag(F.col("was.cancel_requested")) | (~flag(F.col("was.closed")) & flag(F.col("_cancel") < F.coalesce("_end", F.lit(2**63 - 1))))).alias("cancel_requested"),
        F.when(F.col("_completed"), F.col("_hash")).otherwise(F.col("was.result_hash")).alias("result_hash"),
        (flag(F.col("was.closed")) | F.col("_end").isNotNull()).alias("closed"),
        "last",
    )


def project_stream(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain a stream of events into a snapshot of nodes: the rows of ``operators.history.project``. Events of a node
    must come in order from one batch to the next."""
    rows = fold_snapshot(events, path, checkpoint, fold_events, StructType.fromDDL(ROWS), NODE[:3])
    return rows.select(*_KEY, "attempt", F.timestamp_micros("started_us").alias("started_at"), "status", "cancel_requested", "result_hash")
