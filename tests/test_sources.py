"""Recorded histories, logs, and sinks."""

import base64
import json

from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.sources import files


def b64(text):
    return base64.b64encode(text.encode()).decode()


def recorded(path, workflow, cancel=False):
    events = [{"eventId": "1", "eventTime": "2026-09-26T17:01:57.997846Z", "eventType": "EVENT_TYPE_WORKFLOW_EXECUTION_STARTED"}]
    if workflow:
        events[0]["workflowExecutionStartedEventAttributes"] = {"workflowId": workflow, "workflowType": {"name": "T"}}
    events.append({"eventId": "5", "eventTime": "2026-09-26T17:01:58Z", "eventType": "EVENT_TYPE_ACTIVITY_TASK_SCHEDULED", "activityTaskScheduledEventAttributes": {"activityId": "a", "activityType": {"name": "g.n"}, "header": {"fields": {"seq": {"metadata": {}, "data": b64("0")}}}}})
    events.append({"eventId": "6", "eventTime": "2026-09-26T17:01:59Z", "eventType": "EVENT_TYPE_ACTIVITY_TASK_STARTED", "activityTaskStartedEventAttributes": {"scheduledEventId": "5", "attempt": 2}})
    if cancel:
        events.append({"eventId": "7", "eventTime": "2026-09-26T17:02:00Z", "eventType": "EVENT_TYPE_ACTIVITY_TASK_CANCEL_REQUESTED", "activityTaskCancelRequestedEventAttributes": {"scheduledEventId": "5"}})
    events.append({"eventId": "8", "eventTime": "2026-09-26T17:02:01Z", "eventType": "EVENT_TYPE_ACTIVITY_TASK_COMPLETED", "activityTaskCompletedEventAttributes": {"scheduledEventId": "5", "result": {"payloads": [{"metadata": {}, "data": b64('{"v":1}')}]}}})
    path.write_text(json.dumps({"events": events}, indent=1))


def test_history_json(spark, tmp_path):
    recorded(tmp_path / "plain.json", "wf-1")
    recorded(tmp_path / "named.json", None, cancel=True)
    events = files.history_json(spark, str(tmp_path))
    assert {r.workflow_id for r in events.select("workflow_id").distinct().collect()} == {"wf-1", "named"}
    scheduled = events.where("event_type = 'SCHEDULED' AND workflow_id = 'wf-1'").first()
    assert (scheduled.headers, scheduled.scheduled_event_id, scheduled.activity_type) == ({"seq": "0"}, 5, "g.n")
    keyed = events.selectExpr("'default' AS namespace", "workflow_id", "'r' AS run_id", "0 AS seq", "scheduled_event_id", "event_id", "event_time", "event_type", "attempt", "sha2(result, 256) AS result_hash")
    rows = {r.workflow_id: r for r in history.project(keyed.where("scheduled_event_id IS NOT NULL")).collect()}
    assert (rows["wf-1"].status, rows["wf-1"].attempt, rows["wf-1"].cancel_requested) == ("COMPLETED", 2, False)
    assert rows["named"].cancel_requested


def test_fault_log_skips_blank_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"fault":"F1"}\n\n{"fault":"F2"}\n')
    assert [r.fault for r in files.fault_log(spark, str(tmp_path / "log.jsonl"), "fault string").collect()] == ["F1", "F2"]


def test_results_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.5)], "n int, s double")
    files.write_results(rows, str(tmp_path / "out"), "bench", {"cpu": "8"})
    back = spark.read.json(str(tmp_path / "out")).first()
    assert (back.n, back.command, back.environment.cpu) == (1, "bench", "8")
    (tmp_path / "one.json").write_text('{"a": {"b": 1}}')
    assert files.results_json(spark, str(tmp_path / "one.json")).first().a.b == 1


def test_sinks(spark, tmp_path):
    run = spark.createDataFrame([("d", "w", "r", 1), ("d", "w", "r", 1)], "namespace string, workflow_id string, run_id string, n int")
    files.append(run, str(tmp_path / "log"))
    files.append(run, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    files.write_final_states(run, str(tmp_path / "final"))
    assert spark.read.parquet(str(tmp_path / "final")).count() == 1
    files.write_snapshot(run.limit(1), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
    chunks = spark.range(4).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit("x").alias("data"))
    files.write_chunks(chunks, run, run, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/chunks")).where("length(prefix) = 2").count() == 4
    files.reset_store(spark, str(tmp_path / "store"), {"refs": "claim string"})
    assert spark.read.parquet(str(tmp_path / "store/refs")).count() == 0
    assert files.optional(run, n=None, run_id="r").count() == 2
