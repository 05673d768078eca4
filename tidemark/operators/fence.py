"""Fenced writes: which attempts were written, which row stands, what the audit trail says.

A write carries a fence, the pair (schedule time, attempt). A row is overwritten while it is PROVISIONAL and its fence
is not above the new one; ties overwrite. Without status changes in between, the largest fence accepted so far is the
largest seen so far, so both questions have a closed form: a running maximum, and a largest value per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.model import NODE, RUN
from tidemark.operators.fold import ordered_fold

#: What an overwrite leaves as the first write set it.
FIRST_WRITE = ("activity_type", "graph", "node", "lg_step", "lg_path", "lg_task_id", "checkpoint_ns")


def classify(attempts: DataFrame) -> DataFrame:
    """``attempts`` with ``outcome``: WROTE if no earlier arrival of the node has a larger fence, else FENCED_OUT.

    One shuffle by node key; state of a task is one running maximum.
    """
    before = Window.partitionBy(*NODE).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.coalesce(C.fence() >= F.max(C.fence()).over(before), F.lit(True))
    return attempts.withColumn("outcome", F.when(wrote, "WROTE").otherwise("FENCED_OUT"))


def snapshot(attempts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The row that stands for each node: the attempt of the largest fence. Partial maxima are taken before the
    shuffle, so a node with many attempts does not make a large task."""
    kept = [c for c in (columns or attempts.columns) if c not in NODE]
    best = attempts.groupBy(*NODE).agg(F.max_by(F.struct(*kept), C.fence()).alias("row"))
    return best.select(*NODE, *(F.col("row")[c].alias(c) for c in kept))


def of_node() -> WindowSpec:
    """All attempts of a node, in order of arrival: the window by which ``classify`` sorts."""
    return Window.partitionBy(*NODE).orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def with_row(log: DataFrame, columns: list[str]) -> DataFrame:
    """``log`` with ``row``: of each attempt's node the row that stands, as ``snapshot`` gives it. The log must hold all
    attempts; it is neither shuffled nor sorted again after ``classify``."""
    return log.withColumn("row", F.max_by(F.struct(*columns), C.fence()).over(of_node()))


def upsert(attempts: DataFrame, sealed_runs: DataFrame | None = None) -> DataFrame:
    """Rows after all writes of a batch without status changes: overwritten columns are those of the largest fence,
    the others those of the first arrival, ``input_snapshot`` the last one that is not null. Writes to sealed runs
    change nothing."""
    log = attempts if sealed_runs is None else attempts.join(sealed_runs.select(*RUN), RUN, "left_anti")
    log = classify(log).where("outcome = 'WROTE'")
    aggs: list[Column] = []
    for c in log.columns:
        if c in NODE or c == "outcome":
            continue
        if c in FIRST_WRITE:
            aggs.append(F.min_by(c, "arrival").alias(c))
        elif c == "input_snapshot":
            aggs.append(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c))
        else:
            aggs.append(F.max_by(c, F.col("arrival")).alias(c))
    return log.groupBy(*NODE).agg(*aggs).withColumn("status", F.lit("PROVISIONAL"))


FOLD_SCHEMA = (
    "namespace string, workflow_id string, run_id string, seq int, arrival long, op string, outcome string, "
    "status string, attempt int, fence_scheduled_at timestamp, output_hash string"
)


def fold_ops(ops: DataFrame) -> DataFrame:
    """The general form: writes (``w``), commits (``c``) and abandons (``a``) of each node in order of arrival.

    One row for each operation with its outcome and the row as it stands afterwards. A commit or abandon acts on a
    PROVISIONAL row only; a write to a row that is no longer PROVISIONAL is FENCED_OUT.
    """

    def step(row: dict, op: dict) -> dict:
        if op["op"] == "w":
            new = (op["fence_scheduled_at"], op["attempt"])
            wrote = not row or row["status"] == "PROVISIONAL" and row["fence"] <= new
            if wrote:
                row.update(status="PROVISIONAL", fence=new, output_hash=op["output_hash"])
            outcome = "WROTE" if wrote else "FENCED_OUT"
        else:
            changed = row.get("status") == "PROVISIONAL"
            if changed:
                row["status"] = "COMMITTED" if op["op"] == "c" else "ABANDONED"
            outcome = "CHANGED" if changed else "NOOP"
        at, attempt = row.get("fence", (None, None))
        return {"outcome": outcome, "status": row.get("status"), "attempt": attempt, "fence_scheduled_at": at, "output_hash": row.get("output_hash")}

    columns = [*NODE, "arrival", "op", "attempt", "fence_scheduled_at", "output_hash"]
    return ordered_fold(ops.select(*columns), NODE, ["arrival"], dict, step, FOLD_SCHEMA)


def last_status(ops: DataFrame) -> DataFrame:
    """The standing row of each node after ``fold_ops``."""
    kept = ["status", "attempt", "fence_scheduled_at", "output_hash"]
    done = fold_ops(ops).groupBy(*NODE).agg(F.max_by(F.struct(*kept), "arrival").alias("row"), F.count_if(F.col("outcome") == "FENCED_OUT").alias("fenced_out"))
    return done.select(*NODE, "row.*", "fenced_out")


def change_status(nodes: DataFrame, picked: DataFrame, to: str) -> DataFrame:
    """Commit or abandon: PROVISIONAL rows whose node is in ``picked`` become ``to``; running it again changes nothing."""
    if to not in ("COMMITTED", "ABANDONED"):
        raise ValueError(f"cannot change to {to!r}")
    marks = picked.select(*NODE).distinct().withColumn("_picked", F.lit(True))
    out = nodes.join(marks, NODE, "left")
    moved = (F.col("status") == "PROVISIONAL") & F.col("_picked")
    return out.withColumn("status", F.when(moved, to).otherwise(F.col("status"))).select(*nodes.columns)


def audit(log: DataFrame, sealed_runs: DataFrame | None = None) -> DataFrame:
    """The audit trail: one row for each classified attempt, refused ones too; ``note`` tells of sealed runs."""
    sealed = F.lit(False)
    if sealed_runs is not None:
        log = log.join(sealed_runs.select(*RUN).distinct().withColumn("_sealed", F.lit(True)), RUN, "left")
        sealed = F.coalesce(F.col("_sealed"), F.lit(False))
    out = log.withColumn("outcome", F.when(sealed, "FENCED_OUT").otherwise(F.col("outcome"))).withColumn("note", F.when(sealed, "run sealed"))
    return out.drop("_sealed")


def error_class(outcome: Column, status: Column, sealed: Column) -> Column:
    """What the writer of an attempt is told: a stale one may be retried while its row is open, else it is final."""
    stale = outcome == "FENCED_OUT"
    return F.when(stale & (status == "PROVISIONAL") & ~sealed, "FencedOut").when(stale, "FencedOutFinal")


def ensure_runs(writes: DataFrame) -> DataFrame:
    """A run for each run key among writes, first seen at its earliest write."""
    return writes.groupBy(*RUN).agg(F.min("fence_scheduled_at").alias("first_seen_at")).withColumn("status", F.lit("RUNNING"))


def last_by_arrival(attempts: DataFrame) -> DataFrame:
    """The naive sink that keeps whatever arrives last."""
    latest = attempts.groupBy(*NODE).agg(F.max_by(F.struct("attempt", "output_hash"), "arrival").alias("row"))
    return latest.select(*NODE, "row.attempt", "row.output_hash")
