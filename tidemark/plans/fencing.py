"""Fenced writes, status changes, seals."""

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.model import NODE, RUN
from tidemark.operators import fence, lifecycle
from tidemark.plans.prelude import sql
from tidemark.plans.registry import Registry
from tidemark.sources import ledgerize as L

R = Registry()
_NODE = "namespace, workflow_id, run_id, seq"


def log(spark, d):
    return fence.classify(L.attempts(spark, d))


def status_of(op):
    return F.when(op == "commit", "COMMITTED").when(op == "abandon", "ABANDONED").otherwise("PROVISIONAL")


def with_row(spark, d, columns, **more):
    """The log with each node's standing row, dealt by run; ``columns``: those of the row, which are all that is read."""
    tried = L.attempts(spark, d, True, **more).withColumn("status", status_of(F.col("op")))
    needed = {*NODE, "arrival", "attempt", "fence_scheduled_at", "tokens_in", "tokens_out", *columns, *more}
    return fence.with_row(fence.classify(tried.select(*(c for c in tried.columns if c in needed))), columns)


def nodes(spark, d):
    """Standing rows with the status that their last operation gives."""
    rows = fence.snapshot(L.attempts(spark, d))
    return rows.withColumn("status", status_of(F.col("op"))).withColumn("committed_at", F.when(F.col("op") == "commit", F.col("commit_at"))).drop("op", "commit_at", "arrival")


@R.add("ups1_upsert", sql("log", then=f"""
SELECT {_NODE}, arg_max(attempt, arrival) AS attempt, arg_max(fence_scheduled_at, arrival) AS fence_scheduled_at, arg_max(output_hash, arrival) AS output_hash,
 arg_min(node, arrival) AS node, arg_min(lg_path, arrival) AS lg_path, 'PROVISIONAL' AS status FROM log WHERE outcome = 'WROTE' GROUP BY ALL"""))
def ups1(spark, d):
    rows = L.attempts(spark, d).select(*NODE, "arrival", "attempt", "fence_scheduled_at", "output_hash", "node", "lg_path")
    return fence.upsert(rows).drop("arrival")


@R.add("ups1_closed_form", sql("attempts", then=f"SELECT {_NODE}, attempt, fence_scheduled_at, output_hash FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY fence_scheduled_at DESC, attempt DESC) AS rn FROM attempts) WHERE rn = 1"))
def ups1_closed(spark, d):
    return fence.snapshot(L.attempts(spark, d), ["attempt", "fence_scheduled_at", "output_hash"])


def interleaved(spark, d):
    """Each node's writes followed by its commit or abandon, and once more a write."""
    tried = L.attempts(spark, d).select(*NODE, F.col("arrival").cast("bigint").alias("arrival"), "op", "attempt", F.col("fence_scheduled_at").cast("timestamp").alias("fence_scheduled_at"), "output_hash")
    writes = tried.withColumn("op", F.lit("w")).withColumn("arrival", F.col("arrival") * 2)
    changes = tried.where("op IS NOT NULL").withColumn("arrival", F.col("arrival") * 2 + 1).withColumn("op", F.when(F.col("op") == "commit", "c").otherwise("a"))
    return writes.unionByName(changes)


@R.add("ups1_fold")
def ups1_fold(spark, d):
    return fence.last_status(interleaved(spark, d))


@R.add("ups2_classify", sql("log", then=f"SELECT {_NODE}, attempt, arrival, outcome FROM log"))
def ups2(spark, d):
    return log(spark, d).select(*NODE, "attempt", "arrival", "outcome")


@R.add("ups3_commit", sql("nodes", then=f"SELECT {_NODE}, CASE WHEN status = 'PROVISIONAL' AND seq % 2 = 0 THEN 'COMMITTED' ELSE status END AS status FROM nodes"))
def ups3(spark, d):
    rows = nodes(spark, d).select(*NODE, "status")
    return fence.change_status(rows, L.attempts(spark, d).where("seq % 2 = 0"), "COMMITTED")


@R.add("ups4_abandon", sql("nodes", then=f"SELECT {_NODE}, CASE WHEN status = 'PROVISIONAL' AND seq % 3 = 1 THEN 'ABANDONED' ELSE status END AS status FROM nodes"))
def ups4(spark, d):
    rows = nodes(spark, d).select(*NODE, "status")
    return fence.change_status(rows, L.attempts(spark, d).where("seq % 3 = 1"), "ABANDONED")


@R.add("ups5_audit", sql("log", "runs", then=f"""
SELECT {_NODE}, attempt, CASE WHEN r.run_id IS NOT NULL THEN 'FENCED_OUT' ELSE outcome END AS outcome, CASE WHEN r.run_id IS NOT NULL THEN 'run sealed' END AS note
FROM log l LEFT JOIN (SELECT namespace, workflow_id, run_id FROM runs WHERE status = 'FAILED') r USING (namespace, workflow_id, run_id)"""))
def ups5(spark, d):
    trail = fence.audit(log(spark, d), L.runs(spark, d).where("status = 'FAILED'"))
    return trail.select(*NODE, "attempt", "outcome", "note")


@R.add("ups6_error_class", sql("log", "nodes", then=f"""
SELECT {_NODE}, l.attempt, CASE WHEN outcome <> 'FENCED_OUT' THEN NULL WHEN n.status = 'PROVISIONAL' THEN 'FencedOut' ELSE 'FencedOutFinal' END AS error_class
FROM log l JOIN (SELECT namespace, workflow_id, run_id, seq, status FROM nodes) n USING (namespace, workflow_id, run_id, seq)"""))
def ups6(spark, d):
    both = log(spark, d).select(*NODE, "attempt", "outcome").join(nodes(spark, d).select(*NODE, "status"), NODE)
    return both.select(*NODE, "attempt", fence.error_class(F.col("outcome"), F.col("status"), F.lit(False)).alias("error_class"))


@R.add("ups7_ensure_run", sql("attempts", then="SELECT namespace, workflow_id, run_id, min(fence_scheduled_at) AS first_seen_at, 'RUNNING' AS status FROM attempts GROUP BY ALL"))
def ups7(spark, d):
    return fence.ensure_runs(L.attempts(spark, d))


@R.add("flt3_row_value_le", sql("attempts", then=f"SELECT {_NODE}, arrival, (fence_scheduled_at, attempt) <= (TIMESTAMP '1998-06-01', 2) AS early FROM attempts"))
def flt3(spark, d):
    bound = F.struct(F.lit("1998-06-01").cast("timestamp_ntz").alias("fence_scheduled_at"), F.lit(2).alias("attempt"))
    return L.attempts(spark, d).select(*NODE, "arrival", (C.fence() <= bound).alias("early"))


@R.add("flt6_transition_guards", sql("nodes", then="SELECT status, CAST(count(*) AS BIGINT) AS rows FROM nodes WHERE status <> 'COMMITTED' AND status IN ('PROVISIONAL', 'ABANDONED') GROUP BY 1"))
def flt6(spark, d):
    return nodes(spark, d).where((F.col("status") != "COMMITTED") & F.col("status").isin("PROVISIONAL", "ABANDONED")).groupBy("status").agg(F.count("*").alias("rows"))


@R.add("snk2_naive_append", sql("attempts", then=f"SELECT {_NODE}, output_hash FROM attempts"))
def snk2(spark, d):
    return L.attempts(spark, d).select(*NODE, "output_hash")


@R.add("snk3_last_by_arrival", sql("attempts", then=f"SELECT {_NODE}, arg_max(attempt, arrival) AS attempt, arg_max(output_hash, arrival) AS output_hash FROM attempts GROUP BY ALL"))
def snk3(spark, d):
    return fence.last_by_arrival(L.attempts(spark, d))


@R.add("snk4_final_state", sql("nodes", then="SELECT namespace, workflow_id, run_id, CAST(count(*) AS BIGINT) AS nodes, arg_max(output_hash, seq) AS state FROM nodes GROUP BY ALL"))
def snk4(spark, d):
    return nodes(spark, d).groupBy(*RUN).agg(F.count("*").alias("nodes"), F.max_by("output_hash", "seq").alias("state"))


_SEAL = """
c AS (SELECT namespace, workflow_id, run_id, count(*) FILTER (status = 'COMMITTED') AS committed, count(*) FILTER (status = 'PROVISIONAL') AS provisional,
  count(*) FILTER (status = 'ABANDONED') AS abandoned, list(DISTINCT seq) AS seqs FROM nodes GROUP BY ALL),
s AS (SELECT r.*, coalesce(committed, 0) AS committed, coalesce(provisional, 0) AS provisional, coalesce(abandoned, 0) AS abandoned, coalesce(seqs, []) AS seqs,
  coalesce(committed, 0) < accepted_count AS degraded FROM runs r LEFT JOIN c USING (namespace, workflow_id, run_id))"""


def seals(spark, d):
    requests = L.runs(spark, d).select(*RUN, "status", "node_count", "accepted_count")
    return lifecycle.seal(requests, nodes(spark, d).select(*NODE, "status"))


@R.add("seal1_seal_run", sql("nodes", "runs", then=f""", {_SEAL}
SELECT namespace, workflow_id, run_id, status, node_count, CAST(committed AS BIGINT) AS committed_count,
 CAST(abandoned + CASE WHEN degraded THEN 0 ELSE provisional END AS BIGINT) AS abandoned_count, degraded,
 CASE WHEN degraded THEN array_to_string(list_sort(list_filter(range(node_count), lambda x: NOT list_contains(seqs, x))), ',') END AS missing_seqs, status = 'RUNNING' AS refused
FROM s""").replace("\n, \nc AS", ",\nc AS"))
def seal1(spark, d):
    return seals(spark, d).withColumn("missing_seqs", F.array_join("missing_seqs", ",")).drop("sealed_by")


@R.add("seal1_settle", sql("nodes", "runs", then=f""", {_SEAL}
SELECT namespace, workflow_id, run_id, n.seq, CASE WHEN n.status = 'PROVISIONAL' AND NOT s.degraded AND s.status <> 'RUNNING' THEN 'ABANDONED' ELSE n.status END AS status
FROM nodes n LEFT JOIN s USING (namespace, workflow_id, run_id)""").replace("\n, \nc AS", ",\nc AS"))
def seal1_settle(spark, d):
    return lifecycle.settle(nodes(spark, d).select(*NODE, "status"), seals(spark, d))


@R.add("seal2_exit_status", """
SELECT event_id, CASE WHEN k = 'continue_as_new' THEN 'CONTINUED_AS_NEW' WHEN k = 'cancel_error' AND c THEN 'CANCELLED' WHEN k IN ('bare_cancel', 'failure') THEN 'FAILED'
 WHEN k = 'return' THEN 'COMPLETED' END AS status
FROM (SELECT event_id, ['continue_as_new', 'cancel_error', 'bare_cancel', 'failure', 'return', 'other'][event_id % 6 + 1] AS k, user_id % 2 = 0 AS c FROM events)""")
def seal2(spark, d):
    exits = F.element_at(F.array(*map(F.lit, lifecycle.EXITS)), (F.col("event_id") % 6 + 1).cast("int"))
    return L.read(spark, d, "events").select("event_id", lifecycle.exit_status(exits, F.col("user_id") % 2 == 0).alias("status"))


@R.add("seal3_mark_degraded", sql("runs", "nodes", then="""
SELECT namespace, workflow_id, run_id, status, run_id IN (SELECT run_id FROM nodes WHERE cost_usd IS NULL AND status = 'COMMITTED') AS degraded FROM runs
UNION ALL SELECT DISTINCT namespace, workflow_id, run_id, NULL, true FROM nodes WHERE cost_usd IS NULL AND status = 'COMMITTED' AND run_id NOT IN (SELECT run_id FROM runs)"""))
def seal3(spark, d):
    runs = L.runs(spark, d).select(*RUN, "status").withColumn("degraded", F.lit(False))
    return lifecycle.mark_degraded(runs, nodes(spark, d).where("cost_usd IS NULL AND status = 'COMMITTED'"))


@R.add("join8_missing_seqs", sql("runs", "nodes", then="""
SELECT namespace, workflow_id, run_id, CAST(s AS INTEGER) AS seq FROM (SELECT namespace, workflow_id, run_id, unnest(range(node_count)) AS s FROM runs) w
WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.run_id = w.run_id AND n.seq = w.s)"""))
def join8(spark, d):
    return lifecycle.missing_seqs(nodes(spark, d), L.runs(spark, d))


def results(event):
    """Results of nodes as a run sees them; each node carries the id of the one before it."""
    kept = event.where("event_type IN ('COMPLETED', 'FAILED')")
    result = F.when(F.col("event_type") == "COMPLETED", "ok").otherwise("failed")
    carried = F.when(F.col("seq") > 0, F.array(F.col("seq") - 1))
    return kept.select(*RUN, F.col("event_id").cast("int").alias("step"), "seq", result.alias("result"), carried.alias("carried"))


def listed(observed):
    return observed.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("commits", "abandons")})


#: An id is pending after a step if its last result of the kind came before, and no success since has carried it.
OBSERVED_SQL = sql("events_", then="""
, r AS (SELECT namespace, workflow_id, run_id, CAST(event_id AS INTEGER) AS step, seq, CASE event_type WHEN 'COMPLETED' THEN 'ok' ELSE 'failed' END AS result FROM events_ WHERE event_type IN ('COMPLETED', 'FAILED')),
told AS (SELECT run_id, step, seq - 1 AS id FROM r WHERE result = 'ok' AND seq > 0),
last AS (SELECT t.run_id, t.step, p.seq, p.result, max(p.step) AS since FROM r t JOIN r p ON p.run_id = t.run_id AND p.step <= t.step GROUP BY ALL),
pending AS (SELECT * FROM last l WHERE NOT EXISTS (SELECT 1 FROM told k WHERE k.run_id = l.run_id AND k.id = l.seq AND k.step > l.since AND k.step <= l.step)),
lists AS (SELECT run_id, step, string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (result = 'ok') AS commits, string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (result = 'failed') AS abandons FROM pending GROUP BY ALL)
SELECT namespace, workflow_id, run_id, step, seq, result, CAST(count(*) FILTER (result = 'ok') OVER (PARTITION BY run_id ORDER BY step) AS INTEGER) AS accepted,
 coalesce(commits, '') AS commits, coalesce(abandons, '') AS abandons FROM r LEFT JOIN lists USING (run_id, step)""").replace("\n\n, r AS", ",\nr AS")


@R.add("obs1_observe", OBSERVED_SQL)
def obs1(spark, d):
    return listed(lifecycle.observe(results(L.history_events(spark, d))))


@R.add("obs2_header_codec", """
SELECT conv_id, array_to_string(list_sort(list_distinct(list(turn % 3))), ',') AS ids, CAST(max(turn) AS VARCHAR) ~ '^(0|[1-9][0-9]*)$' AS valid FROM conversations GROUP BY 1""")
def obs2(spark, d):
    talk = L.read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn") % 3).alias("ids"), F.max("turn").cast("string").alias("top"))
    return talk.select("conv_id", F.array_join(C.sorted_ids(F.col("ids")), ",").alias("ids"), C.is_sequence_number(F.col("top")).alias("valid"))
