"""The ledger as a stream: the state of a run is keyed by run, late writes are refused by fence and still reported.

A run's state is one row for each of its nodes (fence, attempt, status) and whether it is sealed. Order is by fence,
never by event time or a worker's clock. State lives until the run is sealed; unsealed runs can be given a time to
live. Writes after the seal are refused and reported, not dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from tidemark.model import RUN

#: Operations: ``w`` write, ``c`` commit, ``a`` abandon, ``s`` seal (its seq is not used).
OPS = "namespace string, workflow_id string, run_id string, seq int, arrival long, op string, attempt int, fence_us long"
OUTCOMES = "namespace string, workflow_id string, run_id string, seq int, arrival long, op string, attempt int, outcome string, status string, note string"
# The worker that declares state has no session to parse schema text with.
_SEQ = StructType().add("seq", IntegerType())
_NODE_STATE = StructType().add("fence_us", LongType()).add("attempt", IntegerType()).add("status", StringType())
_SEALED = StructType().add("sealed", BooleanType())


class RunState(StatefulProcessor):
    """Fenced writes and status changes of one run. Operations of a micro-batch are taken in order of arrival."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getMapState("nodes", _SEQ, _NODE_STATE, self.ttl_ms)
        self.sealed = handle.getValueState("sealed", _SEALED, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sealed = self.sealed.exists()
        out = []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples(index=False):
            note, state = None, None
            place = (int(row.seq),)
            if row.op == "s":
                outcome = "NOOP" if sealed else "SEALED"
                sealed = True
                self.sealed.update((True,))
            else:
                state = self.nodes.getValue(place) if self.nodes.containsKey(place) else None
                if row.op == "w":
                    new = (int(row.fence_us), int(row.attempt))
                    wrote = not sealed and (state is None or state[2] == "PROVISIONAL" and (state[0], state[1]) <= new)
                    if wrote:
                        state = (*new, "PROVISIONAL")
                        self.nodes.updateValue(place, state)
                    outcome, note = ("WROTE", None) if wrote else ("FENCED_OUT", "run sealed" if sealed else None)
                else:
                    moved = state is not None and state[2] == "PROVISIONAL" and not sealed
                    if moved:
                        state = (state[0], state[1], "COMMITTED" if row.op == "c" else "ABANDONED")
                        self.nodes.updateValue(place, state)
                    outcome = "CHANGED" if moved else "NOOP"
            out.append((*key, row.seq, row.arrival, row.op, row.attempt, outcome, state[2] if state else None, note))
        frame = pd.DataFrame(out, columns=[p.split()[0] for p in OUTCOMES.split(", ")])
        frame["attempt"] = frame["attempt"].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


def fenced(ops: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Outcomes of a stream of operations. Needs the RocksDB state store (``use_rocksdb``).

    With a time to live the query runs on processing time, and such a query does not end by itself: use it with a
    periodic trigger, not with ``jobs.drain``.
    """
    return ops.groupBy(*RUN).transformWithStateInPandas(
        statefulProcessor=RunState(ttl_ms), outputStructType=StructType.fromDDL(OUTCOMES), outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def first_seen(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """At-least-once input made once: rows whose key was seen are dropped. With ``event_time``, keys are kept for
    ``delay`` beyond the watermark, so state is bounded; without, for ever."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
