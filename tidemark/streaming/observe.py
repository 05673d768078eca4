"""What a run knows of its nodes, as keyed state: the sequence counter, and the ids still to be told to the ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tidemark.model import RUN
from tidemark.operators.lifecycle import OBSERVED, Observed

_COUNTERS = StructType().add("next_seq", IntegerType()).add("accepted", IntegerType())
_SEQ = StructType().add("seq", IntegerType())
_PENDING = StructType().add("what", StringType())
_CARRIED = StructType().add("ids", ArrayType(IntegerType()))
#: How pending ids are kept: to be committed, abandoned, or both.
_MARKS = {(True, False): "c", (False, True): "a", (True, True): "ca"}


class ObservedRun(StatefulProcessor):
    """Events of one run in order of ``step``. State: counters, one entry for each pending id, and for each node that is
    scheduled and not done the ids that its schedule carried. A batch reads the pending ids of its runs once and writes
    back what changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", _COUNTERS)
        self.pending = handle.getMapState("pending", _SEQ, _PENDING)
        self.carried = handle.getMapState("carried", _SEQ, _CARRIED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {place[0]: value[0] for place, value in self.pending.iterator()}
        run = Observed(*(self.counters.get() or (0, 0)), {s for s, m in before.items() if "c" in m}, {s for s, m in before.items() if "a" in m})
        out = []
        for row in pd.concat(list(rows)).sort_values("step").itertuples(index=False):
            if row.result == "schedule":
                seq = run.schedule()
                told = sorted(run.commits | run.abandons)
                if told:
                    self.carried.updateValue((seq,), (told,))
            else:
                seq, told = int(row.seq), row.carried
                if told is None:
                    told = self.carried.getValue((seq,))[0] if self.carried.containsKey((seq,)) else ()
                if self.carried.containsKey((seq,)):
                    self.carried.removeKey((seq,))
                run.result(seq, row.result == "ok", [int(i) for i in told])
            out.append((*key, row.step, seq, row.result, run.accepted, sorted(run.commits), sorted(run.abandons)))
        after = {s: _MARKS[s in run.commits, s in run.abandons] for s in run.commits | run.abandons}
        for seq in before.keys() - after.keys():
            self.pending.removeKey((seq,))
        for seq, mark in after.items():
            if before.get(seq) != mark:
                self.pending.updateValue((seq,), (mark,))
        self.counters.update((run.next_seq, run.accepted))
        yield pd.DataFrame(out, columns=[p.split()[0] for p in OBSERVED.split(", ")])

    def close(self) -> None:
        pass


def observed(events: DataFrame) -> DataFrame:
    """Stream form of ``lifecycle.observe``. Events may also be of the kind ``schedule`` (``seq`` null): the run numbers
    the node, and ``commits`` and ``abandons`` are the ids that its header carries; a later result of the node with null
    ``carried`` settles those. Needs the RocksDB state store. A batch holds the events of a run in memory, so the size
    of micro-batches bounds it."""
    chosen = events.select(*RUN, "step", "seq", "result", "carried")
    return chosen.groupBy(*RUN).transformWithStateInPandas(statefulProcessor=ObservedRun(), outputStructType=StructType.fromDDL(OBSERVED), outputMode="Append", timeMode="None")
