"""Sources and sinks of files: written, read back, and compared with what was written."""

import uuid

from pyspark.sql import functions as F

from tidemark.model import NODE, RUN
from tidemark.operators import storage
from tidemark.plans.fencing import nodes
from tidemark.plans.prelude import sql
from tidemark.plans.registry import Registry
from tidemark.plans.streams import event_stream, writes
from tidemark.plans.storing import _sql, chunks, refs
from tidemark.sources import files
from tidemark.sources import ledgerize as L
from tidemark.streaming import jobs, snapshot

R = Registry()
_NODE = "namespace, workflow_id, run_id, seq"
_RUN = "namespace, workflow_id, run_id"


def folder(spark) -> str:
    """A new folder in the shared one."""
    return f"{jobs.shared_dir(spark)}/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


def written_lines(spark, d) -> str:
    """Events as JSON lines, every seventh followed by a blank line."""
    path = folder(spark)
    event = L.read(spark, d, "events").select("event_id", "event_type", "user_id")
    line = F.to_json(F.struct("event_id", "event_type", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("user_id")))
    event.select(F.concat(line, F.when(F.col("event_id") % 7 == 0, "\n\n").otherwise("")).alias("value")).write.text(path)
    return path


_LINES = "SELECT event_id, event_type, CASE WHEN user_id % 3 > 0 THEN user_id END AS user_id FROM events"
_LINE = "event_id bigint, event_type string, user_id bigint"


@R.add("src6_fault_log", _LINES)
def src6(spark, d):
    return files.fault_log(spark, written_lines(spark, d), _LINE)


@R.add("src2_tailed_log", _LINES)
def src2(spark, d):
    """The same lines as a stream over the folder, drained."""
    return jobs.drain(files.tail_log(spark, written_lines(spark, d), _LINE))


@R.add("src3_recorded_history", """
SELECT CAST(event_id // 80 AS VARCHAR) AS workflow_id, event_id, event_type, event_id // 8 AS scheduled_event_id FROM (
 SELECT event_id, CASE event_type WHEN 'view' THEN 'SCHEDULED' WHEN 'click' THEN 'STARTED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'CANCEL_REQUESTED' END AS event_type FROM events)
WHERE event_type <> 'SCHEDULED'""")
def src3(spark, d):
    """Histories written as one JSON document a run and read as recorded ones."""
    path = folder(spark)
    event = L.history_events(spark, d)
    name = {"STARTED": "Started", "COMPLETED": "Completed", "FAILED": "Failed", "CANCEL_REQUESTED": "CancelRequested"}
    kinds = {"STARTED": "STARTED", "COMPLETED": "COMPLETED", "FAILED": "FAILED", "CANCEL_REQUESTED": "CANCEL_REQUESTED"}
    of = F.struct(F.col("scheduled_event_id").cast("string").alias("scheduledEventId"), F.col("attempt"))
    fields = [F.when(F.col("event_type") == k, of).alias(f"activityTask{v}EventAttributes") for k, v in name.items()]
    kind = F.concat(F.lit("EVENT_TYPE_ACTIVITY_TASK_"), F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items())))
    begun = F.when(F.col("event_type") == "BEGUN", F.struct(F.col("run_id").alias("workflowId"))).alias("workflowExecutionStartedEventAttributes")
    one = F.struct(F.col("event_id").cast("string").alias("eventId"), kind.alias("eventType"), begun, *fields)
    first = event.groupBy("run_id").agg(F.lit(-1).cast("bigint").alias("event_id")).withColumns({"event_type": F.lit("BEGUN"), "scheduled_event_id": F.lit(None).cast("bigint"), "attempt": F.lit(None).cast("int")})
    rows = event.where("event_type <> 'SCHEDULED'").select(*first.columns).unionByName(first)
    documents = rows.groupBy("run_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("e")))), lambda x: x["e"]).alias("events"))).alias("value"))
    documents.select("value").write.text(path)
    read = spark.read.text(path).select("value")  # a document a line here; recorded files are read with multiLine
    parsed = files.history_events(read.select(F.from_json("value", files.HISTORY).alias("h"), F.lit("x.json").alias("file")).select("h.events", "file"))
    return parsed.where("scheduled_event_id IS NOT NULL").select("workflow_id", "event_id", "event_type", "scheduled_event_id")


@R.add("src5_results", "SELECT n_nationkey AS n, CAST(n_regionkey AS DOUBLE) AS s, 'bench' AS command, '8' AS cpus FROM nation")
def src5_snk6(spark, d):
    """Results with command and environment, written and read back."""
    path = folder(spark)
    files.write_results(L.read(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").cast("double").alias("s")), path, "bench", {"cpus": "8"})
    return spark.read.json(path).select("n", "s", "command", F.col("environment.cpus").alias("cpus"))


@R.add("snk1_snapshot_upsert", f"""
SELECT 'default' AS namespace, 'wf-' || ((event_id // 80) % 1000) AS workflow_id, CAST(event_id // 80 AS VARCHAR) AS run_id, CAST((event_id // 8) % 10 AS INTEGER) AS seq,
 arg_max(event_id, (event_id * 7919 % 1000003, user_id % 3 + 1)) AS arrival, CAST(arg_max(user_id % 3 + 1, (event_id * 7919 % 1000003, user_id % 3 + 1)) AS INTEGER) AS attempt
FROM events GROUP BY ALL""")
def snk1(spark, d):
    """A stream of fenced writes upserts the snapshot of standing rows."""
    path = folder(spark)
    rows = snapshot.upsert_snapshot(writes(event_stream(spark, d)).drop("op"), f"{path}/rows", f"{path}/checkpoint", NODE, ["fence_us", "attempt"], RUN)
    return rows.select(*NODE, "arrival", "attempt")


@R.add("snk2_appended_log", sql("nodes", then=f"SELECT {_NODE}, status FROM nodes UNION ALL SELECT {_NODE}, status FROM nodes WHERE seq = 0"))
def snk2(spark, d):
    """Two appends to one log."""
    path, rows = folder(spark), nodes(spark, d).select(*NODE, "status")
    files.append(rows, path)
    files.append(rows.where("seq = 0"), path)
    return spark.read.parquet(path)


@R.add("snk4_final_states_file", sql("runs", then=f"SELECT {_RUN}, status FROM runs"))
def snk4(spark, d):
    path, rows = folder(spark), L.runs(spark, d).select(*RUN, "status")
    files.write_final_states(rows.unionAll(rows), path)
    return spark.read.parquet(path)


@R.add("snk5_chunk_store", _sql("""
SELECT 'chunks' AS what, count(DISTINCT hash) AS rows FROM chunk UNION ALL SELECT 'manifests', count(DISTINCT claim) FROM chunk UNION ALL SELECT 'refs', count(*) FROM refs"""))
def snk5(spark, d):
    """A chunk store of files, written and read back."""
    path = folder(spark)
    cut = chunks(spark, d)
    files.write_chunks(storage.distinct_chunks(cut), storage.manifests(cut), refs(spark, d), path)
    count = lambda df, what: df.agg(F.count("*").alias("rows")).select(F.lit(what).alias("what"), "rows")
    stored = files.read_chunks(spark, path)
    return count(stored[0], "chunks").unionAll(count(stored[1], "manifests")).unionAll(count(stored[2], "refs"))


@R.add("snk8_reset_store", "SELECT CAST(0 AS BIGINT) AS rows")
def snk8(spark, d):
    path = folder(spark)
    refs(spark, d).write.parquet(f"{path}/refs")
    files.reset_store(spark, path, {"refs": "claim string"})
    return spark.read.parquet(f"{path}/refs").agg(F.count("*").alias("rows"))
