"""Chunks, manifests, retrieval and collection."""

import datetime as dt
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import storage as S

NOW = dt.datetime(2024, 6, 1)
REFS = "claim string, namespace string, workflow_id string, run_id string, created_at timestamp, last_ref_at timestamp"


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 200_000), st.integers(0, 10_000))
def test_chunks_join_to_the_data_and_keep_sizes(size, seed):
    data = random.Random(seed).randbytes(size)
    parts = S.chunk(data)
    assert b"".join(parts) == data
    assert all(len(p) <= 65536 for p in parts) and all(len(p) > 4096 for p in parts[:-1])
    assert S.chunk(b"") == [b""]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150_000), st.integers(0, 50_000), st.integers(0, 10_000))
def test_appending_keeps_all_chunks_but_the_last(size, more, seed):
    rng = random.Random(seed)
    prefix = rng.randbytes(size)
    before, after = S.chunk(prefix), S.chunk(prefix + rng.randbytes(more))
    assert after[: len(before) - 1] == before[:-1]


def test_chunks_repeat_after_an_insertion():
    data = random.Random(5).randbytes(400_000)
    before, after = set(S.chunk(data)), set(S.chunk(data[:1000] + b"x" + data[1000:]))
    assert len(before & after) > 0.7 * len(before)


def payloads(spark, rows):
    return spark.createDataFrame([(hashlib.sha256(d).hexdigest(), d, e) for d, e in rows], "claim string, data binary, encoding string")


def test_near_identical_payloads_share_chunks(spark):
    base = random.Random(7).randbytes(300_000)
    rows = payloads(spark, [(base[: i * 9000] + bytes([i]) + base[i * 9000 :], "json/plain") for i in range(12)])
    cut = S.cut(rows)
    logical = cut.agg(F.sum("size")).first()[0]
    assert S.distinct_chunks(cut).agg(F.sum("size")).first()[0] < logical / 4


def test_retrieve_checks_what_it_returns(spark):
    data = random.Random(8).randbytes(100_000)
    cut = S.cut(payloads(spark, [(data, "json/plain"), (b"", "json/plain")]))
    found = {r.claim: (bytes(r.data) if r.data is not None else None, r.problem) for r in S.retrieve(S.manifests(cut), S.distinct_chunks(cut)).collect()}
    assert found == {hashlib.sha256(data).hexdigest(): (data, None), hashlib.sha256(b"").hexdigest(): (b"", None)}
    first = cut.where("position = 0 AND size > 0").first()
    flipped = S.distinct_chunks(cut).withColumn("data", F.when(F.col("hash") == F.lit(bytes(first.hash)), F.lit(b"x")).otherwise(F.col("data")))
    assert {r.problem for r in S.retrieve(S.manifests(cut), flipped).where("problem IS NOT NULL").collect()} == {"hash differs"}
    lost = S.distinct_chunks(cut).where(F.col("hash") != F.lit(bytes(first.hash)))
    assert {r.problem for r in S.retrieve(S.manifests(cut), lost).where("problem IS NOT NULL").collect()} == {"missing chunk"}


def test_opaque_payloads_stay_whole(spark):
    data = random.Random(9).randbytes(200_000)
    assert S.cut(payloads(spark, [(data, "binary/encrypted")])).count() == 1
    assert S.cut(payloads(spark, [(data, "json/plain")]), dedupe=False).count() == 1


def sweep(spark, refs, states, only=None):
    at = lambda days: F.lit(NOW - dt.timedelta(days=days))
    refs = spark.createDataFrame(refs, REFS)
    states = spark.createDataFrame(states, "workflow_id string, status string, close_time timestamp, is_schedule_action boolean")
    verdicts = S.workflow_verdicts(refs, states, at(30), "default", only)
    expired = S.expired_refs(refs, verdicts, at(1), at(30), at(60), orphans=only is None)
    claims = refs.groupBy("claim").agg(F.max("last_ref_at").alias("last_ref_at"))
    table = claims.withColumn("chunks", F.array("claim", F.lit("shared")))
    dead = S.dead_manifests(table, refs, expired, at(1))
    chunks = table.select(F.explode("chunks").alias("hash"), "last_ref_at").groupBy("hash").agg(F.max("last_ref_at").alias("last_ref_at"))
    gone = S.dead_chunks(chunks, table, dead, at(1))
    return {r.workflow_id: r.verdict for r in verdicts.collect()}, {r.claim for r in dead.collect()}, {r.hash for r in gone.collect()}


def ref(claim, workflow, days, namespace="default"):
    t = NOW - dt.timedelta(days=days)
    return (claim, namespace, workflow, "", t, t)


def test_collection_cases(spark):
    refs = [ref("old", "closed", 90), ref("live", "running", 90), ref("kept", "recent", 90), ref("plan", "schedule", 90), ref("gone", "unknown", 90), ref("fired", "cron", 90), ref("else", "x", 90, "other"), ref("fresh", "closed", 0), ref("lost", "", 90)]
    long_ago, lately = NOW - dt.timedelta(days=80), NOW - dt.timedelta(days=3)
    states = [("closed", "COMPLETED", long_ago, False), ("running", "RUNNING", None, False), ("recent", "COMPLETED", lately, False), ("schedule", "COMPLETED", long_ago, True), ("cron-2024", "RUNNING", None, False)]
    verdicts, dead, chunks = sweep(spark, refs, states)
    assert verdicts == {"closed": "expired", "running": "open", "recent": "retained", "schedule": "schedule", "unknown": "expired", "cron": "open", "x": "skipped"}
    assert dead == {"old", "gone", "lost"}
    assert chunks == dead  # the shared chunk is listed by live payloads
    _, dead, _ = sweep(spark, refs, states, only=["closed"])
    assert dead == {"old"}


def test_age_alone_would_lose_live_data(spark):
    """A sweep by age takes what an open workflow still needs; the verdicts keep it."""
    refs = [ref("live", "running", 90)]
    assert sweep(spark, refs, [("running", "RUNNING", None, False)])[1] == set()
    assert sweep(spark, refs, [("other", "RUNNING", None, False)])[1] == {"live"}


LOG = "id long, claim string, data binary, encoding string, namespace string, workflow_id string, run_id string, created_at timestamp, last_ref_at timestamp"


def log_of(spark, rows):
    """``rows``: data, encoding, run, days ago."""
    at = lambda days: NOW - dt.timedelta(days=days)
    return spark.createDataFrame([(i, hashlib.sha256(d).hexdigest(), d, e, "default", "w", run, at(days), at(days)) for i, (d, e, run, days) in enumerate(rows)], LOG)


def empty_store(spark):
    times = "created_at timestamp, last_ref_at timestamp"
    return [
        spark.createDataFrame([], s)
        for s in (
            f"claim string, namespace string, workflow_id string, run_id string, {times}",
            f"claim string, chunks array<binary>, size bigint, encoding string, deduped boolean, {times}",
            f"hash binary, data binary, size int, {times}",
        )
    ]


def test_second_put_of_a_log_cuts_nothing(spark):
    rng = random.Random(3)
    base = rng.randbytes(120_000)
    rows = [(base, "json/plain", "1", 9), (base, "json/plain", "2", 8), (base + b"more", "json/plain", "1", 8), (base[:50_000], "binary/encrypted", "1", 7), (b"", None, "1", 7)]
    log = log_of(spark, rows)
    first = S.put(log, *empty_store(spark))
    counters = first.counters.first().asDict()
    distinct = {p for d, e, *_ in rows for p in (S.chunk(d) if e == "json/plain" else [d])}
    logical = sum(len(d) for d, *_ in rows)
    unique = sum(map(len, distinct))
    assert counters == {"stores": 5, "dedupe_hits": 1, "logical_bytes": logical, "unique_bytes": unique, "opaque": 2, "deduped_bytes": logical - unique}
    held = first.refs, first.payloads, first.chunks
    later = log.withColumn("last_ref_at", F.lit(NOW))
    second = S.put(later, *held)
    assert second.cut.count() == 0 and second.deltas.count() == 0
    assert second.counters.first().asDict() == {"stores": 5, "dedupe_hits": 5, "logical_bytes": logical, "unique_bytes": 0, "opaque": 0, "deduped_bytes": logical}
    same = lambda a, b, *drop: sorted(map(str, a.drop(*drop).collect())) == sorted(map(str, b.drop(*drop).collect()))
    for before, after in zip(held, (second.refs, second.payloads, second.chunks)):
        assert same(before, after, "last_ref_at")
        assert {r.last_ref_at for r in after.collect()} == {NOW}
    assert {bytes(r.data) for r in S.retrieve(second.payloads, second.chunks).collect()} == {d for d, *_ in rows}


def test_put_of_an_empty_log_and_touch_of_some(spark):
    log = log_of(spark, [(b"a" * 10, "json/plain", "1", 9), (b"b" * 10, "json/plain", "1", 9)])
    first = S.put(log, *empty_store(spark))
    held = first.refs, first.payloads, first.chunks
    nothing = S.put(log.limit(0), *held)
    assert nothing.payloads.count() == 2 and nothing.chunks.count() == 2 and nothing.refs.count() == 2
    assert set(nothing.counters.first()) == {0}
    some = S.put(log_of(spark, [(b"a" * 10, "json/plain", "2", 1), (b"c", "json/plain", "2", 1)]), *held)
    days = {bytes(r.data)[:1]: (NOW - r.last_ref_at).days for r in some.chunks.collect()}
    assert days == {b"a": 1, b"b": 9, b"c": 1}
    assert some.refs.count() == 4 and some.cut.count() == 1


def test_reference_counts_equal_lists_over_sweeps(spark):
    """Payloads share chunks; runs are swept one after the other, with a put between that takes up a chunk again."""
    rows = [(bytes([65 + i]) * 10, "json/plain", str(i % 3), 100 - i) for i in range(6)]
    cutter = lambda p: S.cut(p, 2, 4, 8)
    store, counts = S.put(log_of(spark, rows), *empty_store(spark), cutter), spark.createDataFrame([], "hash binary, listed long")
    counts = S.counted(counts, store.deltas)
    tables = [store.refs, store.payloads, store.chunks]
    states = spark.createDataFrame([("w", "COMPLETED", NOW - dt.timedelta(days=200), False)], "workflow_id string, status string, close_time timestamp, is_schedule_action boolean")
    at = lambda days: F.lit(NOW - dt.timedelta(days=days))
    for days in (99, 97, 0):
        if days == 97:
            again = S.put(log_of(spark, [rows[0], rows[4]]), *tables, cutter)
            tables, counts = [again.refs, again.payloads, again.chunks], S.counted(counts, again.deltas)
        by_lists = S.sweep(*tables, states, at(days), at(days), at(days))
        by_counts = S.sweep(*tables, states, at(days), at(days), at(days), counts=counts)
        assert {bytes(r.hash) for r in by_lists.lost.collect()} == {bytes(r.hash) for r in by_counts.lost.collect()}
        assert by_lists.report.first() == by_counts.report.first() and by_counts.report.first().chunks_deleted > 0
        tables, counts = [by_counts.refs, by_counts.payloads, by_counts.chunks], by_counts.counts
        listed = {bytes(r.hash): r.delta for r in S.count_deltas(tables[1]).collect()}
        assert {bytes(r.hash): r.listed for r in counts.collect() if r.listed} == listed
    assert not listed


def test_bytes_of_runs_count_shared_input_once(spark):
    """A run has its workflow's references without a run, too; what both have counts once."""
    payloads = spark.createDataFrame([("in", ["a", "b"], 5), ("x", ["b", "c", "c"], 9), ("y", ["d"], 4)], "claim string, chunks array<string>, size long")
    chunks = spark.createDataFrame([("a", 2), ("b", 3), ("c", 3), ("d", 4)], "hash string, size long")
    refs = spark.createDataFrame([(c, "n", w, r) for c, w, r in [("in", "w", ""), ("x", "w", "1"), ("in", "w", "1"), ("x", "w", "1"), ("y", "w", "2"), ("y", "v", "1")]], "claim string, namespace string, workflow_id string, run_id string")
    found = {(r.workflow_id, r.run_id): (r.payloads, r.whole_bytes, r.unique_bytes) for r in S.run_bytes(refs, payloads, chunks).collect()}
    assert found == {("w", ""): (1, 5, 5), ("w", "1"): (2, 14, 8), ("w", "2"): (2, 9, 9), ("v", "1"): (1, 4, 4)}
