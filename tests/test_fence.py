"""Fenced writes against a sequential model."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.model import NODE
from tidemark.operators import fence

START = dt.datetime(2026, 9, 26, 12)
OPS = "namespace string, workflow_id string, run_id string, seq int, arrival long, op string, attempt int, fence_scheduled_at timestamp, output_hash string"


def model(ops):
    """Outcomes and the final (status, hash) of one key, by the rules and nothing else."""
    row, out = None, []
    for op, offset, attempt, tag in ops:
        if op == "w":
            if row is None or row[0] == "PROVISIONAL" and row[1] <= (offset, attempt):
                row = ("PROVISIONAL", (offset, attempt), str(tag))
                out.append("WROTE")
            else:
                out.append("FENCED_OUT")
        elif row is not None and row[0] == "PROVISIONAL":
            row = ("COMMITTED" if op == "c" else "ABANDONED", *row[1:])
            out.append("CHANGED")
        else:
            out.append("NOOP")
    return out, (row[0], row[2]) if row else (None, None)


def frame(spark, sequences):
    rows = [
        ("default", "w", str(k), 0, i, op, attempt, START + dt.timedelta(seconds=offset), str(tag))
        for k, ops in enumerate(sequences)
        for i, (op, offset, attempt, tag) in enumerate(ops)
    ]
    return spark.createDataFrame(rows, OPS)


def op(rng):
    return rng.choice("wwwca"), rng.randrange(6), rng.randrange(1, 5), rng.randrange(1_000_000)


def test_fold_equals_model(spark):
    rng = random.Random(11)
    sequences = [[op(rng) for _ in range(rng.randrange(1, 13))] for _ in range(400)]
    got = {}
    for r in fence.fold_ops(frame(spark, sequences)).collect():
        got.setdefault(int(r.run_id), {})[r.arrival] = r.outcome
    last = {int(r.run_id): (r.status, r.output_hash) for r in fence.last_status(frame(spark, sequences)).collect()}
    for k, ops in enumerate(sequences):
        outcomes, row = model(ops)
        assert [got[k][i] for i in range(len(ops))] == outcomes
        assert last[k] == row


def test_closed_form_equals_model_without_status_changes(spark):
    rng = random.Random(12)
    sequences = [[("w", *op(rng)[1:]) for _ in range(rng.randrange(1, 13))] for _ in range(400)]
    df = frame(spark, sequences)
    got = {(int(r.run_id), r.arrival): r.outcome for r in fence.classify(df).collect()}
    rows = {int(r.run_id): r.output_hash for r in fence.upsert(df.drop("op")).collect()}
    for k, ops in enumerate(sequences):
        outcomes, row = model(ops)
        assert [got[k, i] for i in range(len(ops))] == outcomes
        assert rows[k] == row[1]


def test_race_leaves_the_highest_fence(spark):
    offsets = list(range(20))
    random.Random(3).shuffle(offsets)
    row = fence.last_status(frame(spark, [[("w", o, 1, o) for o in offsets]])).first()
    assert (row.status, row.output_hash) == ("PROVISIONAL", "19")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("wwwca"), st.integers(0, 5), st.integers(1, 4), st.integers(0, 99)), min_size=1, max_size=12))
def test_model_accepts_the_running_maximum(ops):
    """What makes the closed form exact: without status changes, accepted writes are those at or above the maximum."""
    writes = [o for o in ops if o[0] == "w"]
    outcomes, _ = model(writes)
    top = None
    for (_, offset, attempt, _), outcome in zip(writes, outcomes):
        assert (outcome == "WROTE") == (top is None or (offset, attempt) >= top)
        top = max(top or (offset, attempt), (offset, attempt))


def test_sealed_runs_refuse_writes(spark):
    df = frame(spark, [[("w", 0, 1, 5)], [("w", 0, 1, 6)]])
    sealed = df.where("run_id = '0'").select("namespace", "workflow_id", "run_id")
    assert [r.run_id for r in fence.upsert(df.drop("op"), sealed).collect()] == ["1"]
    notes = {r.run_id: (r.outcome, r.note) for r in fence.audit(fence.classify(df), sealed).collect()}
    assert notes == {"0": ("FENCED_OUT", "run sealed"), "1": ("WROTE", None)}


def test_change_status_twice_changes_nothing(spark):
    rows = frame(spark, [[("w", 0, 1, 5)], [("w", 0, 1, 6)]]).selectExpr(*NODE, "'PROVISIONAL' AS status")
    once = fence.change_status(rows, rows.where("run_id = '0'"), "COMMITTED")
    twice = fence.change_status(once, rows, "ABANDONED")
    assert {r.run_id: r.status for r in twice.collect()} == {"0": "COMMITTED", "1": "ABANDONED"}
