"""Streams equal batches, survive a restart, and replay to the same rows."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.model import NODE, RUN

from tidemark.operators import effects, fence, history, lifecycle
from tidemark.plans import fencing
from tidemark.plans.streams import operations, writes
from tidemark.sources import ledgerize as L
from tidemark.sources.manifest import Manifest
from tidemark.streaming import effects as effect_stream
from tidemark.streaming import history as history_stream
from tidemark.streaming import jobs, ledger, observe, retention, snapshot


def split_ops(spark, data, path, build, parts=3):
    """Operations in files by ranges of arrival, so that each micro-batch holds a later part."""
    ops = build(L.read(spark, data, "events").where("event_id < 900"))
    for i in range(parts):
        ops.where(f"arrival >= {i * 300} AND arrival < {i * 300 + 300}").coalesce(1).write.parquet(f"{path}/part{i}")
    return ops


def stream_of(spark, path, ops):
    return jobs.files_stream(spark, f"{path}/part*", ops.schema, files_per_batch=1)


def outcomes(df):
    return {(r.run_id, r.seq, r.arrival): r.outcome for r in df.collect()}


def test_stream_equals_batch(spark, data, tmp_path):
    jobs.use_rocksdb(spark)
    ops = split_ops(spark, data, tmp_path / "in", writes)
    got = jobs.drain(ledger.fenced(stream_of(spark, tmp_path / "in", ops)), str(tmp_path / "out"), str(tmp_path / "check"))
    batch = fence.classify(ops.withColumnRenamed("fence_us", "fence_scheduled_at"))
    assert outcomes(got) == outcomes(batch)
    assert got.where("outcome = 'FENCED_OUT'").count() > 0


def test_interleaved_stream_equals_fold(spark, data, tmp_path):
    jobs.use_rocksdb(spark)
    ops = split_ops(spark, data, tmp_path / "in", operations).where("op <> 's'")
    stream = stream_of(spark, tmp_path / "in", ops).where("op <> 's'")
    got = outcomes(jobs.drain(ledger.fenced(stream), str(tmp_path / "out"), str(tmp_path / "check")))
    stamped = ops.withColumn("fence_scheduled_at", F.timestamp_micros("fence_us")).withColumn("output_hash", F.lit("h"))
    assert got == outcomes(fence.fold_ops(stamped.select(*NODE, "arrival", "op", "attempt", "fence_scheduled_at", "output_hash")))


def test_seal_refuses_later_writes(spark, data, tmp_path):
    jobs.use_rocksdb(spark)
    ops = split_ops(spark, data, tmp_path / "in", operations)
    rows = jobs.drain(ledger.fenced(stream_of(spark, tmp_path / "in", ops)), str(tmp_path / "out"), str(tmp_path / "check")).collect()
    late = [r for r in rows if r.op == "w" and r.arrival % 80 > 70]
    assert late and all((r.outcome, r.note) == ("FENCED_OUT", "run sealed") for r in late)


def test_restart_and_replay(spark, data, tmp_path):
    """Draining again adds nothing; the same input with a new checkpoint gives the same rows."""
    jobs.use_rocksdb(spark)
    ops = split_ops(spark, data, tmp_path / "in", writes)
    once = outcomes(jobs.drain(ledger.fenced(stream_of(spark, tmp_path / "in", ops)), str(tmp_path / "out"), str(tmp_path / "check")))
    again = jobs.drain(ledger.fenced(stream_of(spark, tmp_path / "in", ops)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert again.count() == len(once)
    fresh = outcomes(jobs.drain(ledger.fenced(stream_of(spark, tmp_path / "in", ops)), str(tmp_path / "out2"), str(tmp_path / "check2")))
    assert fresh == once


def test_first_seen(spark, data, tmp_path):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.files_stream(spark, str(tmp_path / "in"), rows.schema)
    assert sorted(r.k for r in jobs.drain(ledger.first_seen(stream, ["k"]), str(tmp_path / "out"), str(tmp_path / "check")).collect()) == [1, 2]


# --- state by run, effect and node ----------------------------------------------------------------------------------


def in_parts(spark, rows, path, by, parts=3):
    """``rows`` as a stream of files by ranges of a column, one a micro-batch."""
    cuts = rows.stat.approxQuantile(by, [i / parts for i in range(parts + 1)], 0.0)
    for i in range(parts):
        low, high = cuts[i], cuts[i + 1] if i + 1 < parts else float("inf")
        rows.where((F.col(by) >= low) & (F.col(by) < high)).coalesce(1).write.parquet(f"{path}/part{i}")
    return jobs.files_stream(spark, f"{path}/part*", rows.schema, files_per_batch=1)


def test_observed_runs_over_batches(spark, data, tmp_path):
    jobs.use_rocksdb(spark)
    results = fencing.results(L.history_events(spark, data))
    got = jobs.drain(observe.observed(in_parts(spark, results, tmp_path / "in", "step")))
    rows = lambda df: {(r.run_id, r.step): (r.seq, r.accepted, tuple(r.commits), tuple(r.abandons)) for r in df.collect()}
    assert rows(got) == rows(lifecycle.observe(results)) and got.count() == results.count()


def test_runs_number_their_nodes_and_carry_ids(spark, tmp_path):
    """Three batches: nodes get the next numbers, headers carry what is pending, results settle what their node carried."""
    jobs.use_rocksdb(spark)
    events = [(1, None, "schedule"), (2, None, "schedule"), (3, 0, "ok"), (4, 1, "failed"), (5, None, "schedule"), (6, None, "schedule"), (7, 2, "ok"), (8, 3, "failed")]
    rows = spark.createDataFrame([("n", "w", "r", t, seq, what, None) for t, seq, what in events], "namespace string, workflow_id string, run_id string, step int, seq int, result string, carried array<int>")
    got = {r.step: (r.seq, r.accepted, r.commits, r.abandons) for r in jobs.drain(observe.observed(in_parts(spark, rows, tmp_path / "in", "step"))).collect()}
    assert got[2][0] == 1 and got[5] == (2, 1, [0], [1]) and got[6] == (3, 1, [0], [1])
    assert got[7] == (2, 2, [2], []) and got[8] == (3, 2, [2], [3])


def test_effects_over_batches_restart_and_repeats(spark, data, tmp_path):
    jobs.use_rocksdb(spark)
    log = L.effect_events(spark, data)
    stream = lambda: in_parts(spark, log, tmp_path / "in", "arrival")
    rows = lambda df: sorted(map(str, df.select("key", "arrival", "outcome", "status", "attempts", "duplicates_prevented", "resolution", "result").collect()))
    want = rows(effects.replay(log))
    assert rows(jobs.drain(effect_stream.replayed(stream()), str(tmp_path / "out"), str(tmp_path / "check"))) == want
    log.where("arrival % 3 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/part9")  # delivered again
    again = jobs.drain(effect_stream.replayed(jobs.files_stream(spark, f"{tmp_path}/in/part*", log.schema)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows(again) == want


def test_history_over_batches(spark, data, tmp_path):
    jobs.use_rocksdb(spark)
    events = L.history_events(spark, data)
    got = history_stream.project_stream(in_parts(spark, events, tmp_path / "in", "event_id", 4), str(tmp_path / "nodes"), str(tmp_path / "check"))
    rows = lambda df: sorted(map(str, df.select(*NODE, "scheduled_event_id", "attempt", F.col("started_at").cast("timestamp"), "status", "cancel_requested", "result_hash").collect()))
    assert rows(got) == rows(history.project(events))


# --- retention ------------------------------------------------------------------------------------------------------

HOUR = 3600_000


def touched(spark, path, batches):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for i, batch in enumerate(batches):
        rows = spark.createDataFrame([(k, start + dt.timedelta(hours=h)) for k, h in batch], "k string, seen_at timestamp")
        rows.coalesce(1).write.parquet(f"{path}/part{i}")
    return jobs.files_stream(spark, f"{path}/part*", rows.schema, files_per_batch=1)


def told(rows):
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 1000
    return sorted((r.k, (r.at_ms - start) // HOUR, r.what) for r in rows.collect())


@pytest.mark.parametrize("split", [1, 2, 5])
def test_keys_expire_and_late_writes_are_told(spark, tmp_path, split):
    """However the rows fall into batches: a expires at 12 and comes back at 15, b expires for good, c is forgotten."""
    jobs.use_rocksdb(spark)
    rows = [("a", 0), ("b", 1), ("a", 2), ("c", 3), ("a", 15), ("b", 5), ("d", 40), ("c", 41), ("d", 60)]
    rows.sort(key=lambda r: r[1])
    batches = [rows[i : i + split] for i in range(0, len(rows), split)] if split > 1 else [rows]
    got = told(jobs.drain(retention.retained(touched(spark, tmp_path / "in", batches), ["k"], 10 * HOUR, "1 hour", 20 * HOUR)))
    assert got == sorted([
        ("a", 0, "FIRST"), ("a", 2, "TOUCHED"), ("a", 12, "EXPIRED"), ("a", 15, "AFTER_EXPIRY"), ("a", 25, "EXPIRED"),
        ("b", 1, "FIRST"), ("b", 5, "TOUCHED"), ("b", 15, "EXPIRED"), ("c", 3, "FIRST"), ("c", 13, "EXPIRED"), ("c", 41, "FIRST"), ("c", 51, "EXPIRED"),
        ("d", 40, "FIRST"), ("d", 50, "EXPIRED"), ("d", 60, "AFTER_EXPIRY"),
    ])


# --- snapshot -------------------------------------------------------------------------------------------------------


def written_bytes(path):
    return {str(f): f.stat().st_size for f in Path(path).rglob("*.parquet")}


def test_snapshot_rewrites_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "snap")
    runs = spark.range(20_000).select(F.lit("n").alias("namespace"), F.lit("w").alias("workflow_id"), (F.col("id") % 100).cast("string").alias("run_id"), F.floor(F.col("id") / 100).cast("int").alias("seq"), F.lit(1).alias("fence"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    step = lambda rows, number: snapshot.merge(rows, number, path, NODE, ["fence"], RUN, 128)
    step(runs, 0)
    before = written_bytes(path)
    one = runs.where("run_id = '42'").withColumn("fence", F.lit(2)).withColumn("hash", F.lit("new"))  # one key in a hundred
    step(one, 1)
    new = {f: n for f, n in written_bytes(path).items() if f not in before}
    assert sum(new.values()) < 0.03 * sum(before.values())
    rows = snapshot.read_snapshot(spark, path, runs.schema)
    assert rows.count() == 20_000 and rows.where("hash = 'new'").count() == 200
    step(one.withColumn("hash", F.lit("again")), 1)  # the batch was committed: nothing happens
    assert snapshot.read_snapshot(spark, path, runs.schema).where("hash = 'again'").count() == 0
    for number in (2, 3):
        step(one.withColumn("fence", F.lit(number + 1)), number)
    assert sum(written_bytes(path).values()) < 1.1 * sum(before.values())  # old versions went


def test_crash_between_bucket_and_manifest(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    rows = spark.createDataFrame([("k1", 1, "a"), ("k2", 1, "b")], "k string, o int, v string")
    step = lambda df, number: snapshot.merge(df, number, path, ["k"], ["o"], ["k"], 4)
    read = lambda: sorted((r.k, r.v) for r in snapshot.read_snapshot(spark, path, rows.schema).collect())
    step(rows, 0)
    later = spark.createDataFrame([("k1", 2, "c"), ("k3", 1, "d")], rows.schema)
    monkeypatch.setattr(Manifest, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        step(later, 1)
    monkeypatch.undo()
    assert read() == [("k1", "a"), ("k2", "b")]
    step(later, 1)
    assert read() == [("k1", "c"), ("k2", "b"), ("k3", "d")]
    step(later, 2)
    named = Manifest(spark, path).read()
    folders = {str(p.parent.relative_to(path)) for p in Path(path).rglob("*.parquet")}
    assert folders == {*named.parts.values(), *named.before.values()}


def test_snapshot_of_a_stream(spark, data, tmp_path):
    ops = split_ops(spark, data, tmp_path / "in", writes)
    got = snapshot.upsert_snapshot(stream_of(spark, tmp_path / "in", ops).drop("op"), str(tmp_path / "snap"), str(tmp_path / "check"), NODE, ["fence_us", "attempt"], RUN)
    best = ops.groupBy(*NODE).agg(F.max_by("arrival", F.struct("fence_us", "attempt")).alias("arrival"))
    rows = lambda df: sorted(map(str, df.select(*NODE, "arrival").collect()))
    assert rows(got) == rows(best)
    assert Manifest(spark, str(tmp_path / "snap")).read().number == 2
