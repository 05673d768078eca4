"""Retention as a stream: keys that nobody touches expire by timers, and what comes after is told.

Time is ``seen_at``, when the log took a row; the watermark follows it ``grace`` behind, so rows may be that late. A key
expires ``retention`` after its last touch. Its state is kept for ``memory`` more, so that a write after the expiry is
known as one; then it goes, and the state of the stream is bounded by the keys of that time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructType

_STATE = StructType().add("last_ms", LongType()).add("expired", BooleanType())


class Retained(StatefulProcessor):
    """One key. What happens does not depend on how rows fall into batches: a row that comes after the expiry within one
    batch finds the key expired just as if a timer had fired before."""

    def __init__(self, retention_ms: int, memory_ms: int, columns: list[str]):
        self.retention_ms, self.memory_ms, self.columns = retention_ms, memory_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("touched", _STATE)

    def _rows(self, key, told: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame([(*key, what, at) for what, at in told], columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, expired = self.state.get() if self.state.exists() else (None, False)
        if last is not None:
            self.handle.deleteTimer(last + self.retention_ms + (self.memory_ms if expired else 0))
        told = []
        for at in sorted(t for frame in rows for t in frame["seen_ms"].tolist()):
            if last is not None and not expired and at > last + self.retention_ms:
                told.append(("EXPIRED", last + self.retention_ms))
                expired = True
            if last is None or at > last + self.retention_ms + self.memory_ms:
                told.append(("FIRST", at))
            else:
                told.append(("AFTER_EXPIRY" if expired else "TOUCHED", at))
            last, expired = (at if last is None else max(last, at)), False
        self.state.update((last, False))
        self.handle.registerTimer(last + self.retention_ms)
        yield self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, expired = self.state.get()
        if expired:
            self.state.clear()
            return iter(())
        self.state.update((last, True))
        self.handle.registerTimer(last + self.retention_ms + self.memory_ms)
        return iter([self._rows(key, [("EXPIRED", last + self.retention_ms)])])

    def close(self) -> None:
        pass


def retained(touches: DataFrame, key: list[str], retention_ms: int, grace: str, memory_ms: int) -> DataFrame:
    """``what`` and ``at_ms`` by key: FIRST, TOUCHED and AFTER_EXPIRY for each touch, EXPIRED for each expiry that the
    watermark has passed. ``touches``: the key and ``seen_at`` (timestamp). Needs the RocksDB state store."""
    timed = touches.select(*key, "seen_at", F.unix_millis("seen_at").alias("seen_ms")).withWatermark("seen_at", grace)
    out = StructType([touches.schema[k] for k in key]).add("what", "string").add("at_ms", "long")
    return timed.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=Retained(retention_ms, memory_ms, out.names), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )
