"""The commands on a small store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import cli, model

AT = dt.datetime(2024, 5, 1)
KEY = {"namespace": "default", "workflow_id": "order-1", "run_id": "r1"}


def put(spark, store, name, rows, schema=None):
    frame = model.empty(spark, name) if schema is None else spark.createDataFrame([], schema)
    full = [tuple(r.get(c) for c in frame.columns) for r in rows]
    cli.Store(spark, store).replace(**{name: spark.createDataFrame(full, frame.schema)})


def read(spark, store, name):
    return cli.Store(spark, store).read(name)


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    cli.main([path, "init-db"], spark)
    put(spark, path, "runs", [{**KEY, "status": "RUNNING", "first_seen_at": AT, "degraded": False}])
    node = {**KEY, "activity_type": "g.plan", "node": "plan", "lg_path": "~1", "attempt": 1, "fence_scheduled_at": AT, "kind": "UPDATE", "tokens_in": 1200}
    put(spark, path, "nodes", [
        {**node, "seq": 0, "lg_step": 0, "status": "COMMITTED", "output_hash": "aa", "output_json": '{"result":{"items":[1]}}', "input_snapshot": '{"items":[0]}'},
        {**node, "seq": 1, "lg_step": 1, "status": "PROVISIONAL", "output_hash": "stale", "output_json": '{"result":{"items":[9]}}'},
        {**node, "seq": 2, "lg_step": 2, "status": "PROVISIONAL", "output_hash": "cc", "output_json": '{"result":{"items":[3]}}'},
    ])
    put(spark, path, "attempts", [{**KEY, "id": 1, "seq": 0, "attempt": 2, "fence_scheduled_at": AT, "outcome": "FENCED_OUT", "tokens_in": 5}])
    put(spark, path, "effects", [{**KEY, "key": "k1", "seq": 0, "name": "mail", "idx": 0, "status": "STARTED"}])
    history = "namespace string, workflow_id string, run_id string, seq int, status string, cancel_requested boolean, accepted boolean, attempt int, started_at timestamp, result_hash string, output_json string"
    event = {**KEY, "status": "COMPLETED", "cancel_requested": False, "accepted": True, "attempt": 3, "started_at": AT}
    put(spark, path, "history", [{**event, "seq": i, "result_hash": h, "output_json": f'{{"result":{{"items":[{i}]}}}}'} for i, h in enumerate(("aa", "bb", "cc", "dd"))], history)
    put(spark, path, "states", [{**KEY, "status": "COMPLETED", "found": True, "closed": True}], "namespace string, workflow_id string, run_id string, status string, found boolean, closed boolean")
    return path


def test_init_keeps_what_is_there(spark, store):
    cli.main([store, "init-db"], spark)
    assert read(spark, store, "runs").count() == 1 and read(spark, store, "meta").first().value == model.SCHEMA_VERSION


def test_status_and_ledger(spark, store):
    assert cli.main([store, "status"], spark).first().run_id == "r1"
    lines = [r.line for r in cli.main([store, "ledger", "order-1"], spark).collect()]
    assert lines[0] == "LEDGER  wf=order-1  run=r1  status=RUNNING  open  nodes=3 committed=0 abandoned=0"
    assert len(lines) == 6 and "stale attempt 2 fenced out" in lines[2] and "1,200" in lines[2]
    assert lines[5] == "effects: mail x1 (key k1...)    duplicates prevented: 0"
    assert cli.main([store, "ledger", "order-1", "--run", "r0"], spark).count() == 0


def test_resolve(spark, store):
    assert cli.main([store, "resolve", "k1", "done", "--result", "{}"], spark).first().status == "DONE"
    again = read(spark, store, "effects").first()
    assert (again.resolution, again.result) == ("manual:done", "{}") and again.done_at is not None
    with pytest.raises(Exception, match="no effect"):
        cli.main([store, "resolve", "k2", "done"], spark)


def test_reconcile(spark, store):
    report = cli.main([store, "reconcile"], spark).first()
    assert (report.action, report.inserted, report.rewritten, report.committed) == ("sealed", 1, 1, 2)
    rows = {r.seq: r for r in read(spark, store, "nodes").collect()}
    assert {s: r.status for s, r in rows.items()} == dict.fromkeys(range(4), "COMMITTED")
    assert (rows[1].output_hash, rows[1].output_json, rows[1].attempt) == ("bb", '{"result":{"items":[1]}}', 3)
    assert (rows[3].fence_scheduled_at, rows[3].kind, rows[3].attempt) == (AT, "UPDATE", 3)


def test_reconcile_is_kept(spark, store):
    """The run is sealed in the ledger, repairs are in the audit trail, and a second pass leaves all as it is."""
    put(spark, store, "states", [{**KEY, "status": "COMPLETED", "found": True, "closed": True, "final_state_hash": "ff", "workflow_type": "order"},
                                 {**KEY, "run_id": "new", "status": "FAILED", "found": True, "closed": True}, {**KEY, "run_id": "gone", "status": "UNKNOWN", "found": False, "closed": False}],
        "namespace string, workflow_id string, run_id string, status string, found boolean, closed boolean, final_state_hash string, workflow_type string")
    first = {r.run_id: r.action for r in cli.main([store, "reconcile"], spark).collect()}
    assert first == {"r1": "sealed", "new": "sealed", "gone": "history-gone"}
    runs = {r.run_id: r for r in read(spark, store, "runs").collect()}
    done = runs["r1"]
    assert set(runs) == {"r1", "new"} and model.RELATIONS["runs"].schema.names == list(done.asDict())
    assert (done.status, done.sealed_by, done.node_count, done.committed_count, done.degraded, done.final_state_hash, done.workflow_type, done.first_seen_at) == ("COMPLETED", "reconcile", 4, 4, False, "ff", "order", AT)
    assert runs["new"].status == "FAILED" and runs["new"].final_state_hash is None and runs["new"].sealed_at is not None
    audits = read(spark, store, "attempts").where("outcome = 'DIVERGENCE_REPAIRED'").collect()
    assert {(r.seq, r.worker, r.output_hash) for r in audits} == {(1, "reconcile", "bb"), (3, "reconcile", "dd")} and all(r.id > 1 for r in audits)
    before = sorted(map(str, read(spark, store, "nodes").collect()))
    second = {r.run_id: (r.action, r.inserted, r.committed) for r in cli.main([store, "reconcile"], spark).collect()}
    assert second == {"r1": ("skipped-sealed", 0, 0), "new": ("skipped-sealed", 0, 0), "gone": ("history-gone", 0, 0)}
    assert sorted(map(str, read(spark, store, "nodes").collect())) == before
    assert read(spark, store, "attempts").count() == 3 and read(spark, store, "runs").where("run_id = 'r1'").first() == done
    line = cli.main([store, "ledger", "order-1", "--run", "r1"], spark).first().line
    assert line == "LEDGER  wf=order-1  run=r1  status=COMPLETED  sealed (by reconcile)  nodes=4 committed=4 abandoned=0"


def test_degraded_run_names_what_is_missing(spark, store):
    """The history accepted a node that reconcile cannot see: rows of another seq stand in its place."""
    history = read(spark, store, "history")
    put(spark, store, "nodes", [{**KEY, "seq": 7, "status": "PROVISIONAL", "attempt": 1, "output_hash": "zz"}, {**KEY, "seq": 0, "status": "ABANDONED", "attempt": 1, "output_hash": "aa"}])
    cli.main([store, "reconcile"], spark)
    run = read(spark, store, "runs").first()
    assert history.count() == 4 and (run.degraded, run.committed_count, run.abandoned_count, run.missing_seqs) == (True, 3, 1, [])
    assert read(spark, store, "nodes").where("seq = 7").first().status == "PROVISIONAL"


def test_crash_before_the_manifest_changes_nothing(spark, store, monkeypatch):
    monkeypatch.setattr(cli.Manifest, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        cli.main([store, "reconcile"], spark)
    monkeypatch.undo()
    assert read(spark, store, "runs").first().sealed_at is None and read(spark, store, "nodes").count() == 3
    assert cli.main([store, "reconcile"], spark).first().action == "sealed"


def test_materialize(spark, store):
    row = cli.main([store, "materialize", "order-1", "--channel", "items=append"], spark).first()
    assert (row.state, row.label, row.rows_used) == ('{"items": [0, 1]}', "OPEN", 1)
    row = cli.main([store, "materialize", "order-1", "--channel", "items=append", "--include-provisional"], spark).first()
    assert row.state == '{"items": [0, 1, 9, 3]}'


def test_gc(spark, store):
    ref = {**KEY, "target_kind": "run", "created_at": AT, "last_ref_at": AT}
    put(spark, store, "payload_refs", [{**ref, "claim": "c1"}, {**ref, "claim": "c2", "workflow_id": "live"}])
    put(spark, store, "payloads", [{"claim": c, "chunks": [bytearray(c.encode())], "size": 2, "created_at": AT, "last_ref_at": AT} for c in ("c1", "c2")])
    put(spark, store, "chunks", [{"hash": bytearray(c.encode()), "size": 2, "created_at": AT, "last_ref_at": AT} for c in ("c1", "c2")])
    put(spark, store, "workflows", [{"workflow_id": "live", "status": "RUNNING", "is_schedule_action": False}], "workflow_id string, status string, close_time timestamp, is_schedule_action boolean")
    dry = cli.main([store, "gc"], spark).first()
    assert read(spark, store, "chunks").count() == 2
    assert cli.main([store, "gc", "--only", "live", "--execute"], spark).first().refs_expired == 0
    put(spark, store, "namespaces", [{"namespace": "default", "retention_days": 40}], "namespace string, retention_days int")
    with pytest.raises(ValueError, match="shorter"):
        cli.main([store, "gc", "--execute"], spark)
    assert cli.main([store, "gc", "--execute", "--retention-days", "40"], spark).first() == dry
    assert (dry.refs_expired, dry.manifests_deleted, dry.chunks_deleted, dry.chunk_bytes_deleted) == (1, 1, 1, 2)
    assert [r.claim for r in read(spark, store, "payloads").select(F.col("claim")).collect()] == ["c2"]


def test_margin_and_orphans_wait(spark, store):
    """Closed 33 days ago: within retention and margin. An orphan goes after 90 days, not before."""
    ago = lambda days: dt.datetime.now(dt.timezone.utc) - dt.timedelta(days=days)
    ref = {**KEY, "target_kind": "run"}
    put(spark, store, "payload_refs", [{**ref, "claim": "c1", "created_at": ago(60), "last_ref_at": ago(60)}] + [{**ref, "claim": f"o{n}", "workflow_id": "", "created_at": ago(n), "last_ref_at": ago(n)} for n in (80, 95)])
    put(spark, store, "workflows", [{"workflow_id": "order-1", "status": "COMPLETED", "close_time": ago(33), "is_schedule_action": False}], "workflow_id string, status string, close_time timestamp, is_schedule_action boolean")
    swept = cli.main([store, "gc"], spark).first()
    assert (swept.refs_expired, swept.orphan_refs_expired) == (0, 1)
    assert cli.main([store, "gc", "--margin-days", "2"], spark).first().refs_expired == 1


def test_bench(spark, data):
    assert [r.query for r in cli.main([data, "bench", "set3_distinct"], spark).collect()] == ["set3_distinct"]
