"""Effects as a stream: the state of an effect is keyed by the effect and moved by events in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from tidemark.functions import hashing as H
from tidemark.operators.effects import EFFECT_KEY, FOLDED, Effect

_FIELDS = {"status": StringType(), "request": StringType(), "result": StringType(), "resolution": StringType(), "attempts": IntegerType(), "prevented": IntegerType(), "last": LongType()}
_STATE = StructType()
for _name, _kind in _FIELDS.items():
    _STATE = _STATE.add(_name, _kind)


class EffectState(StatefulProcessor):
    """One effect. Its input is delivered at least once: events up to the last arrival taken are repeats and have no
    effect and no row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("effect", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        effect, last, out = Effect(), -1, []
        if self.state.exists():
            *values, last = self.state.get()
            for name, value in zip(_FIELDS, values):
                setattr(effect, name, value)
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples(index=False):
            if row.arrival <= last:
                continue
            last = int(row.arrival)
            outcome = effect.apply(row.event, row.request_hash, row.result)
            out.append((*key, row.key, last, row.event, outcome, effect.status, effect.request, effect.result, effect.attempts, effect.prevented, effect.resolution))
        self.state.update((*(getattr(effect, n) for n in _FIELDS if n != "last"), last))
        yield pd.DataFrame(out, columns=[p.split()[0] for p in FOLDED.split(", ")])

    def close(self) -> None:
        pass


def replayed(events: DataFrame) -> DataFrame:
    """Stream form of ``operators.effects.replay``. Needs the RocksDB state store; events of an effect must come in order
    of arrival from one batch to the next, and a batch holds the events of an effect in memory."""
    keyed = events.select(*EFFECT_KEY, H.effect_key().alias("key"), "arrival", "event", "request_hash", "result")
    return keyed.groupBy(*EFFECT_KEY).transformWithStateInPandas(statefulProcessor=EffectState(), outputStructType=StructType.fromDDL(FOLDED), outputMode="Append", timeMode="None")
