"""State of a run, rebuilt from its ordered deltas: every channel has a reducer, every result a label.

``fold`` is the general form, one ordered fold a run with any reducers and the check of input hashes. ``fold_lists`` is
the closed form for channels that append, keep the last value or add up: ordered aggregates in the JVM.

EXACT: the run is sealed and the state's hash is the sealed one. GAP: it is not, with the reason. OPEN: not sealed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import RUN

Reducer = Callable[[Any, list], Any]


def append(state: Any, values: list) -> Any:
    out = list(state or [])
    for v in values:
        out += v
    return out


def last(state: Any, values: list) -> Any:
    return values[-1]


def add_up(state: Any, values: list) -> Any:
    return (state or 0) + sum(values)


def merge_by_id(state: Any, values: list) -> Any:
    """Messages by id: a known id is replaced in its place, a new one goes to the end."""
    out = list(state or [])
    at = {m.get("id"): i for i, m in enumerate(out)}
    for value in values:
        for message in value if isinstance(value, list) else [value]:
            if message.get("id") in at:
                out[at[message["id"]]] = message
            else:
                at[message.get("id")] = len(out)
                out.append(message)
    return out


REDUCERS: dict[str, Reducer] = {"append": append, "last": last, "sum": add_up, "merge_by_id": merge_by_id}


def canonical_hash(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class State:
    """Channels of a run while it is folded. The canonical text of a channel is made anew only when the channel was
    written, and the hash of some channels only when one of them was, so a step costs what it changes."""

    def __init__(self, values: dict[str, Any]):
        self.values, self._texts, self._hashes = dict(values), {}, {}

    def write(self, channel: str, value: Any) -> None:
        self.values[channel] = value
        self._texts.pop(channel, None)
        self._hashes = {keys: h for keys, h in self._hashes.items() if channel not in keys}

    def hash(self, keys: tuple[str, ...]) -> str:
        """``canonical_hash`` of the channels among ``keys`` that have a value (``keys`` may name others)."""
        if keys not in self._hashes:
            there = sorted(k for k in keys if k in self.values)
            for k in there:
                if k not in self._texts:
                    self._texts[k] = json.dumps({k: self.values[k]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)[1:-1]
            self._hashes[keys] = hashlib.sha256(("{" + ",".join(self._texts[k] for k in there) + "}").encode()).hexdigest()
        return self._hashes[keys]


def delta_of(kind: str, output: str | None) -> list[tuple[str, Any]]:
    """(channel, value) pairs that a node's output writes: the command's update, or the result; interrupts write none."""
    if kind == "INTERRUPT" or not output:
        return []
    data = json.loads(output)
    part = (data.get("langgraph_command") or {}).get("update") if kind == "COMMAND" else data.get("result")
    if isinstance(part, dict):
        return list(part.items())
    if isinstance(part, list):
        return [(k, v) for k, v in part]
    return []


FOLDED = "namespace string, workflow_id string, run_id string, state string, state_hash string, label string, reason string, positions array<string>, rows_used long, chain_rows_used long"


def chain_rows(rows: DataFrame) -> DataFrame:
    """What a chain fold of a workflow needs: all rows of its latest run (``_own``), of the earlier runs the COMMITTED
    row that wins each step and path, and the earliest snapshot (``_seed``)."""
    workflow = Window.partitionBy(*RUN[:2])
    marked = rows.withColumn("_own", F.struct("run_rank", "run_id") == F.max(F.struct("run_rank", "run_id")).over(workflow))
    own, earlier = marked.where("_own"), marked.where("NOT _own AND status = 'COMMITTED' AND step IS NOT NULL")
    first = Window.partitionBy(*RUN[:2]).orderBy("run_rank", "step", "path")
    seed = earlier.where("seq = 0 AND input_snapshot IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    fill = later_wins(earlier.where("kind <> 'INTERRUPT'"))
    mark = lambda df, is_seed: df.withColumn("_seed", F.lit(is_seed))
    return mark(own, False).unionByName(mark(fill, False)).unionByName(mark(seed, True))


def fold(rows: DataFrame, reducers: dict[str, str | Reducer], chain: bool = False, unhashed: bool = False, include_provisional: bool = False, graph: str | None = None, inputs: dict[str, list[str]] | None = None, convert: Callable[[str], str] | None = None) -> DataFrame:
    """The state of each run.

    ``rows``: run key, ``run_rank`` (order of runs of a workflow), ``seq``, ``step``, ``path``, ``kind``, ``status``,
    ``output_json``, ``input_snapshot`` (on seq 0), ``input_hash``, and of the run ``sealed``, ``final_state_hash``,
    ``node_count``. Deltas of a step are applied together, ordered by path and seq, one update for each channel; only
    channels that ``reducers`` names take part, in seeds as in deltas. Interrupts are no steps. Before a step, a node's
    input hash, if it is there, must be the hash of the channels that the node reads: those that ``inputs`` names for
    its ``node``, all channels for other nodes. ``convert`` is applied to each output (a payload converter).

    ``positions`` of a run that is not EXACT name every input that does not match, every gap between steps (not with
    ``chain``), and, of a GAP without any of these, the step after which a write is lost. ``reason`` says why.

    COMMITTED rows are folded, with ``include_provisional`` PROVISIONAL ones of the run as well, with ``graph`` those of
    that ``graph`` only. To fold another run than the latest with ``chain``, leave out the rows of later ones.

    With ``chain``, the latest run of a workflow is folded and filled from earlier ones: the seed is its own snapshot,
    else the earliest; a COMMITTED row of an earlier run (the latest that wrote the step and path) is applied if the
    run has no row of that path in the step and the row's input hash is the hash of the folded state. Rows without an
    input hash are applied only if ``unhashed``. A run's rows are one group: tens of nodes.
    """
    table = {name: REDUCERS[r] if isinstance(r, str) else r for name, r in reducers.items()}
    key = RUN[:2] if chain else RUN
    columns = [p.split()[0] for p in FOLDED.split(", ")]
    every = tuple(table)
    reads = {node: tuple(k for k in keys if k in table) for node, keys in (inputs or {}).items()}
    statuses = ("COMMITTED", "PROVISIONAL") if include_provisional else ("COMMITTED",)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["run_rank", "seq"])
        mine_ = group._own if chain else pd.Series(True, group.index)
        taken = group.step.notna() & ((group.status == "COMMITTED") | (mine_ & group.status.isin(statuses)))
        if graph is not None:
            taken &= group.graph == graph
        seeds = group[(group.seq == 0) & group.input_snapshot.notna() & (taken | (group._seed if chain else False))]
        if chain:
            mine = seeds[seeds._own]
            seeds = mine if len(mine) else seeds[seeds._seed]
            group = group[~group._seed | group.index.isin(seeds.index)]
            taken = taken[group.index]
        target = group[group._own].iloc[-1] if chain else group.iloc[-1]
        snapshot = json.loads(seeds.iloc[0].input_snapshot) if len(seeds) else {}
        state = State({k: v for k, v in snapshot.items() if k in table} if isinstance(snapshot, dict) else {})
        start = seeds.iloc[0].step if len(seeds) else 0
        used = group[taken & (group.kind != "INTERRUPT")]
        if chain:
            used = used[~used._seed]
        used = used[used.step >= (0 if pd.isna(start) else start)]
        used = used.drop_duplicates(["run_id", "step", "path", "seq"], keep="last").sort_values(["step", "path", "seq"])
        positions, before = [], None
        applied = filled = 0
        for step, part in used.groupby("step", sort=True):
            names = part.node if "node" in part else part.path
            expected = pd.Series([state.hash(reads.get(n, every)) for n in names], part.index)
            fits = part.input_hash == expected
            if chain:
                known = part.input_hash.map(lambda h: isinstance(h, str))
                part = part[part._own | (~part.path.isin(part.path[part._own]) & (fits | (~known & unhashed)))]
                if part.empty:
                    continue
            wrong = [(n, p) for n, p, h, e in zip(names[part.index], part.path, part.input_hash, expected[part.index]) if isinstance(h, str) and h != e]
            positions += [f"step {int(step)}: input of {n} ({p}) differs" for n, p in wrong]
            if before is not None and step > before + 1 and not chain:
                positions.append(f"no rows in steps {int(before) + 1} to {int(step) - 1}")
            before = step
            applied += int(part._own.sum()) if chain else len(part)
            filled += int((~part._own).sum()) if chain else 0
            writes: dict[str, list] = {}
            for kind, output in zip(part.kind, part.output_json):
                for channel, value in delta_of(kind, convert(output) if convert and output else output):
                    if channel in table:
                        writes.setdefault(channel, []).append(value)
            for channel, values in writes.items():
                state.write(channel, table[channel](state.values.get(channel), values))
        digest = state.hash(every)
        own = group[group._own] if chain else group
        if not target.sealed:
            label, reason = "OPEN", None
        elif isinstance(target.final_state_hash, str) and digest == target.final_state_hash:
            label, reason, positions = "EXACT", None, []
        else:
            lacking = int(target.node_count) - len(own) if not pd.isna(target.node_count) else 0
            why = ["the state's hash is not the sealed one" if isinstance(target.final_state_hash, str) else "the seal has no final hash"]
            why += ["the run has no rows"] if not len(used) else []
            why += [f"{lacking} rows are missing"] if lacking > 0 else []
            if not positions and before is not None:
                positions.append(f"a write is lost after step {int(before)}")
            label, reason = "GAP", "; ".join(why)
        shown = json.dumps(state.values, sort_keys=True, ensure_ascii=False)
        out = (target.namespace, target.workflow_id, target.run_id, shown, digest, label, reason, positions, applied, filled)
        return pd.DataFrame([out], columns=columns)

    return (chain_rows(rows) if chain else rows).groupBy(*key).applyInPandas(one, FOLDED)


def fold_lists(deltas: DataFrame, keep: Column | None = None) -> DataFrame:
    """``items`` (appended), ``last_path`` (last value) and ``total`` (added up) of each run, in order of step, path, seq."""
    rows = deltas if keep is None else deltas.where(keep)
    ordered = F.array_sort(F.collect_list(F.struct("step", "path", "seq", "item")))
    place = F.struct("step", "path", "seq")
    out = rows.groupBy(*RUN).agg(ordered.alias("_all"), F.max_by("path", place).alias("last_path"), F.sum("size").cast("bigint").alias("total"), F.count("*").alias("rows"))
    return out.withColumn("items", F.transform("_all", lambda s: s["item"])).drop("_all")


def gaps(deltas: DataFrame) -> DataFrame:
    """Steps whose predecessor is missing."""
    steps = deltas.select(*RUN, "step").distinct()
    before = F.lag("step").over(Window.partitionBy(*RUN).orderBy("step"))
    return steps.withColumn("before", before).where("step > before + 1")


def later_wins(rows: DataFrame) -> DataFrame:
    """Of rows of a workflow with the same step and path, the one of the latest run, then the largest seq."""
    order = Window.partitionBy("namespace", "workflow_id", "step", "path").orderBy(F.desc("run_rank"), F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def label(sealed: Column, state_hash: Column, final_hash: Column, node_count: Column, rows: Column) -> tuple[Column, Column]:
    """(label, number of missing rows) of a folded run."""
    exact = state_hash.eqNullSafe(final_hash)
    name = F.when(~sealed, "OPEN").when(exact, "EXACT").otherwise("GAP")
    return name, F.when(name == "GAP", F.greatest(node_count - rows, F.lit(0)))


def verdict(label_: Column, equal: Column) -> Column:
    """What a fold is worth against the run's own result."""
    return F.when(label_ == "OPEN", "open").when(label_ == "GAP", "gap").when(equal, "equal").otherwise("unequal")
