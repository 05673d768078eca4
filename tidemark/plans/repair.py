"""Histories, reconciliation, invariants."""

from pyspark.sql import functions as F

from tidemark.model import NODE, RUN
from tidemark.operators import fence, history, reconcile
from tidemark.plans import fencing
from tidemark.plans.prelude import sql
from tidemark.plans.registry import Registry
from tidemark.sources import ledgerize as L

R = Registry()
_NODE = "namespace, workflow_id, run_id, seq"
_ACCEPTED = "status = 'COMPLETED' AND NOT cancel_requested"


def hist(spark, d):
    return history.project(L.history_events(spark, d))


def judged(spark, d):
    rows = hist(spark, d)
    return rows.withColumn("accepted", history.accepted_under("TRY_CANCEL", F.col("status"), F.col("cancel_requested")))


def run_states(spark, d):
    """What is known of each run: found, closed, sealed, degraded; derived from its number."""
    n = F.col("run_id").cast("bigint")
    return L.history_events(spark, d).select(*RUN).distinct().select(*RUN, (n % 11 != 10).alias("found"), (n % 7 != 6).alias("closed"), (n % 5 == 0).alias("sealed"), (n % 10 == 0).alias("degraded"))


_STATES = """
st AS (SELECT DISTINCT namespace, workflow_id, run_id, CAST(run_id AS BIGINT) % 11 <> 10 AS found, CAST(run_id AS BIGINT) % 7 <> 6 AS closed,
  CAST(run_id AS BIGINT) % 5 = 0 AS sealed, CAST(run_id AS BIGINT) % 10 = 0 AS degraded FROM events_)"""

_ACTIONS = f"""{_STATES},
v AS (SELECT *, CASE WHEN NOT found THEN 'history-gone' WHEN sealed AND NOT degraded THEN 'skipped-sealed' WHEN NOT closed THEN 'open' END AS skipped FROM st),
h AS (SELECT *, {_ACCEPTED} AS accepted, true AS there FROM hist WHERE run_id IN (SELECT run_id FROM v WHERE skipped IS NULL)),
w AS (SELECT *, true AS there FROM rows_ WHERE run_id IN (SELECT run_id FROM v WHERE skipped IS NULL)),
a AS (SELECT {_NODE}, CASE
   WHEN h.there AND accepted AND w.there IS NULL THEN 'insert'
   WHEN h.there AND accepted AND w.status = 'PROVISIONAL' AND w.output_hash IS DISTINCT FROM h.result_hash THEN 'rewrite'
   WHEN h.there AND accepted AND w.status = 'PROVISIONAL' THEN 'commit'
   WHEN h.there AND NOT coalesce(accepted, false) AND w.status = 'PROVISIONAL' THEN 'abandon' ELSE 'none' END AS action
  FROM h FULL JOIN w USING (namespace, workflow_id, run_id, seq)),
actions AS (SELECT * FROM a UNION ALL SELECT namespace, workflow_id, run_id, NULL, skipped FROM v WHERE skipped IS NOT NULL)"""


def _with(text: str) -> str:
    return text.replace("\n,\nst AS", ",\nst AS")


@R.add("his1_project", sql("hist", then="SELECT * FROM hist"))
def his1(spark, d):
    return hist(spark, d)


@R.add("his2_accepted_under", sql("hist", then=f"SELECT {_NODE}, {_ACCEPTED} AS try_cancel, status = 'COMPLETED' AS wait FROM hist"))
def his2(spark, d):
    status, cancel = F.col("status"), F.col("cancel_requested")
    return hist(spark, d).select(*NODE, history.accepted_under("TRY_CANCEL", status, cancel).alias("try_cancel"), history.accepted_under("WAIT", status, cancel).alias("wait"))


def actions(spark, d):
    return reconcile.decide(judged(spark, d), L.history_rows(spark, d), run_states(spark, d))


@R.add("rec1_decide", _with(sql("hist", "rows_", then=f",{_ACTIONS} SELECT * FROM actions")))
def rec1(spark, d):
    return actions(spark, d)


@R.add("rec1_idempotent")
def rec1_again(spark, d):
    """A second pass over the repaired rows: nothing is left to do."""
    done = reconcile.apply_actions(judged(spark, d), L.history_rows(spark, d), actions(spark, d))
    return reconcile.decide(judged(spark, d), done, run_states(spark, d)).groupBy("action").agg(F.count("*").alias("nodes"))


@R.add("rec2_rec3_apply", _with(sql("hist", "rows_", then=f""",{_ACTIONS}
SELECT {_NODE}, CASE WHEN action IN ('commit', 'rewrite') THEN 'COMMITTED' WHEN action = 'abandon' THEN 'ABANDONED' ELSE r.status END AS status,
 CASE WHEN action = 'rewrite' THEN h.result_hash ELSE r.output_hash END AS output_hash, CASE WHEN action = 'rewrite' THEN coalesce(h.attempt, 1) ELSE r.attempt END AS attempt
FROM rows_ r LEFT JOIN (SELECT * FROM actions WHERE seq IS NOT NULL) a USING ({_NODE}) LEFT JOIN (SELECT {_NODE}, result_hash, attempt FROM hist) h USING ({_NODE})
UNION ALL SELECT {_NODE}, 'COMMITTED', h.result_hash, coalesce(h.attempt, 1) FROM actions a JOIN (SELECT {_NODE}, result_hash, attempt FROM hist) h USING ({_NODE}) WHERE action = 'insert'""")))
def rec23(spark, d):
    return reconcile.apply_actions(judged(spark, d), L.history_rows(spark, d), actions(spark, d))


@R.add("rec3_repairs", _with(sql("hist", "rows_", then=f""",{_ACTIONS}
SELECT {_NODE}, 'DIVERGENCE_REPAIRED' AS outcome, CASE action WHEN 'insert' THEN 'row inserted from history' ELSE 'row rewritten from history' END AS note
FROM actions WHERE action IN ('insert', 'rewrite')""")))
def rec3(spark, d):
    return reconcile.repairs(actions(spark, d))


def full_hist(spark, d):
    """Histories with what the events of a node carry besides: activity, output, times."""
    of, seq = F.col("scheduled_event_id"), F.col("seq").cast("string")
    output = F.concat(F.lit('{"result":{"v":'), (of % 7).cast("string"), F.lit('},"langgraph_command":'), F.when(of % 5 == 1, '{"update":1}').otherwise("null"), F.lit("}"))
    return judged(spark, d).select(
        "*", F.concat(F.lit("a"), seq).alias("activity_id"), F.when(of % 4 == 0, F.concat(F.lit("n"), seq)).otherwise(F.concat(F.lit("g.sub.n"), seq)).alias("activity_type"),
        F.when(F.col("result_hash").isNotNull(), output).alias("output_json"), F.lit("json/plain").alias("output_encoding"),
    )


def full_rows(spark, d):
    fixed = {"output_json": "old", "output_encoding": "old", "activity_id": "old", "activity_type": "old", "graph": "old", "kind": "UPDATE"}
    rows = L.history_rows(spark, d).withColumns({c: F.lit(v) for c, v in fixed.items()})
    return rows.withColumn("fence_scheduled_at", F.lit("2024-01-01").cast("timestamp"))


_FULL = f"""{_ACTIONS},
hf AS (SELECT *, {_ACCEPTED} AS accepted, 'a' || seq AS activity_id, CASE WHEN scheduled_event_id % 4 = 0 THEN 'n' || seq ELSE 'g.sub.n' || seq END AS activity_type,
  CASE WHEN result_hash IS NOT NULL THEN '{{"result":{{"v":' || (scheduled_event_id % 7) || '}},"langgraph_command":' || CASE WHEN scheduled_event_id % 5 = 1 THEN '{{"update":1}}' ELSE 'null' END || '}}' END AS output_json FROM hist),
done AS (
 SELECT {_NODE}, CASE WHEN action IN ('commit', 'rewrite') THEN 'COMMITTED' WHEN action = 'abandon' THEN 'ABANDONED' ELSE r.status END AS status,
  CASE WHEN action = 'rewrite' THEN hf.result_hash ELSE r.output_hash END AS output_hash, CASE WHEN action = 'rewrite' THEN coalesce(hf.attempt, 1) ELSE r.attempt END AS attempt,
  CASE WHEN action = 'rewrite' THEN hf.output_json ELSE 'old' END AS output_json, CASE WHEN action = 'rewrite' THEN 'json/plain' ELSE 'old' END AS output_encoding,
  'old' AS activity_id, 'old' AS activity_type, 'old' AS graph, 'UPDATE' AS kind, TIMESTAMP '2024-01-01' AS fence_scheduled_at
 FROM rows_ r LEFT JOIN (SELECT * FROM actions WHERE seq IS NOT NULL) a USING ({_NODE}) LEFT JOIN hf USING ({_NODE})
 UNION ALL SELECT {_NODE}, 'COMMITTED', result_hash, coalesce(attempt, 1), output_json, 'json/plain', activity_id, activity_type,
  CASE WHEN scheduled_event_id % 4 <> 0 THEN 'g.sub' END, CASE WHEN scheduled_event_id % 5 = 1 AND output_json IS NOT NULL THEN 'COMMAND' ELSE 'UPDATE' END, started_at
 FROM actions JOIN hf USING ({_NODE}) WHERE action = 'insert'),
n AS (SELECT namespace, workflow_id, run_id, count(*) AS node_count, count(*) FILTER (accepted) AS accepted_count FROM hf GROUP BY ALL),
c AS (SELECT run_id, count(*) FILTER (status = 'COMMITTED') AS committed FROM done GROUP BY ALL),
sealing AS (SELECT st.*, node_count, accepted_count, coalesce(committed, 0) < accepted_count AS short FROM st JOIN n USING (namespace, workflow_id, run_id) LEFT JOIN c USING (run_id)
  WHERE found AND closed AND NOT sealed)"""


def reconciled(spark, d):
    return reconcile.reconcile(full_hist(spark, d), full_rows(spark, d), run_states(spark, d).withColumn("status", F.lit("COMPLETED")))


@R.add("rec3_full_rows", _with(sql("hist", "rows_", then=f""",{_FULL}
SELECT done.* REPLACE (CASE WHEN status = 'PROVISIONAL' AND run_id IN (SELECT run_id FROM sealing WHERE NOT short) THEN 'ABANDONED' ELSE status END AS status) FROM done""")))
def rec3_full(spark, d):
    """All columns of the rows after a pass: rewritten and inserted ones, and those that sealing abandons."""
    return reconciled(spark, d).rows


@R.add("rec1_report", _with(sql("hist", "rows_", then=f""",{_FULL}
SELECT namespace, workflow_id, run_id, CASE WHEN skipped IS NOT NULL THEN skipped WHEN run_id IN (SELECT run_id FROM sealing) THEN 'sealed'
  WHEN coalesce(i + w + k + b, 0) > 0 THEN 'repaired' ELSE 'none' END AS action, coalesce(i, 0) AS inserted, coalesce(w, 0) AS rewritten, coalesce(k, 0) AS committed, coalesce(b, 0) AS abandoned
FROM v LEFT JOIN (SELECT run_id, count(*) FILTER (action = 'insert') AS i, count(*) FILTER (action = 'rewrite') AS w,
  count(*) FILTER (action IN ('commit', 'rewrite')) AS k, count(*) FILTER (action = 'abandon') AS b FROM actions GROUP BY ALL) USING (run_id)""")))
def rec1_report(spark, d):
    return reconciled(spark, d).report


@R.add("rec1_run_states", _with(sql("hist", "rows_", then=f""",{_FULL}
SELECT st.*, st.sealed OR sealing.run_id IS NOT NULL AS sealed_now, st.degraded OR coalesce(short, false) AS degraded_now
FROM st LEFT JOIN (SELECT run_id, short FROM sealing) sealing USING (run_id)""").replace("st.*,", "namespace, workflow_id, run_id,")))
def rec1_states(spark, d):
    return reconciled(spark, d).runs.select(*RUN, F.col("sealed").alias("sealed_now"), F.col("degraded").alias("degraded_now"))


@R.add("rec1_second_pass", _with(sql("hist", "rows_", then=f""",{_FULL}
SELECT CASE WHEN v.skipped = 'history-gone' THEN v.skipped WHEN (v.sealed OR s.run_id IS NOT NULL) AND NOT (v.degraded OR coalesce(short, false)) THEN 'skipped-sealed'
  WHEN NOT v.closed THEN 'open' ELSE 'none' END AS action, count(*) AS runs
FROM v LEFT JOIN (SELECT run_id, short FROM sealing) s USING (run_id) GROUP BY ALL""")))
def rec1_second(spark, d):
    """What a second pass over the rows and run states of the first one says: sealed runs are skipped, nothing changes."""
    first = reconciled(spark, d)
    second = reconcile.reconcile(full_hist(spark, d), first.rows, first.runs)
    return second.report.groupBy("action").agg(F.count("*").alias("runs"))


@R.add("rec4_targets", _with(sql("events_", "rows_", then=f""",{_STATES}
SELECT DISTINCT namespace, workflow_id, run_id FROM st WHERE NOT sealed OR (degraded AND run_id IN (SELECT run_id FROM rows_ WHERE status = 'PROVISIONAL'))""")))
def rec4(spark, d):
    return reconcile.targets(run_states(spark, d), L.history_rows(spark, d))


@R.add("join11_full_diff", sql("hist", "rows_", then=f"""
SELECT {_NODE}, h.t IS NOT NULL AS in_history, w.t IS NOT NULL AS in_ledger, w.output_hash IS DISTINCT FROM h.result_hash AS differs
FROM (SELECT *, 1 AS t FROM hist) h FULL JOIN (SELECT *, 1 AS t FROM rows_) w USING ({_NODE})"""))
def join11(spark, d):
    both = reconcile.compare(hist(spark, d), L.history_rows(spark, d))
    return both.select(*NODE, "in_history", "in_ledger", (~F.col("row_output_hash").eqNullSafe(F.col("result_hash"))).alias("differs"))


@R.add("chk1_invariants", _with(sql("hist", "rows_", then=f""",{_STATES},
e AS (SELECT {_NODE}, count(*) AS times, arg_min({_ACCEPTED}, scheduled_event_id) AS accepted, arg_min(result_hash, scheduled_event_id) AS result_hash FROM hist GROUP BY ALL),
r AS (SELECT {_NODE}, count(*) AS n, max(status) AS row_status, arg_max(output_hash, status) AS row_hash, count(*) FILTER (status = 'PROVISIONAL') AS open FROM rows_ GROUP BY ALL),
b AS (SELECT *, run_id IN (SELECT run_id FROM st WHERE sealed) AS is_sealed FROM e FULL JOIN r USING ({_NODE}))
SELECT namespace, workflow_id, run_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS rows,
 CAST(sum(greatest(coalesce(n, 0) - 1, 0) + greatest(coalesce(times, 0) - 1, 0) + CASE WHEN n IS NOT NULL AND times IS NULL THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows,
 count(*) FILTER (accepted AND row_status = 'COMMITTED' AND row_hash IS DISTINCT FROM result_hash) AS divergent_rows,
 count(*) FILTER (accepted AND (n IS NULL OR row_status = 'ABANDONED')) AS lost_rows, CAST(sum(CASE WHEN is_sealed THEN coalesce(open, 0) ELSE 0 END) AS BIGINT) AS orphan_rows,
 count(*) FILTER (times IS NOT NULL AND NOT accepted AND row_status = 'COMMITTED') AS wrongly_committed
FROM b GROUP BY ALL""")))
def chk1(spark, d):
    return reconcile.invariants(judged(spark, d), L.history_rows(spark, d), run_states(spark, d).where("sealed"))


_CHK2 = """
calls AS (SELECT 'default' AS namespace, 'wf-' || (o_custkey % 20) AS workflow_id, CAST(o_custkey % 50 AS VARCHAR) AS run_id, o_orderpriority AS name,
  sha256(o_orderpriority || CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE '' END) AS request_hash FROM orders)"""


@R.add("chk2_repeated_effects", f"""WITH {_CHK2}
SELECT namespace, workflow_id, CAST(sum(n) AS BIGINT) AS duplicate_side_effects FROM (SELECT namespace, workflow_id, count(*) - 1 AS n FROM calls GROUP BY namespace, workflow_id, run_id, name, request_hash HAVING count(*) > 1)
GROUP BY ALL""")
def chk2(spark, d):
    return reconcile.repeated_effects(L.effect_events(spark, d))


@R.add("agg7_having_surplus", f"""WITH {_CHK2}
SELECT run_id, name, CAST(count(*) - 1 AS BIGINT) AS surplus FROM calls GROUP BY ALL HAVING count(*) > 1""")
def agg7(spark, d):
    return L.effect_events(spark, d).groupBy("run_id", "name").agg((F.count("*") - 1).alias("surplus")).where("surplus > 0")


@R.add("agg12_counter_merge", sql("hist", "rows_", then="""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (status = 'PROVISIONAL') AS BIGINT) AS open, CAST(count(DISTINCT run_id) AS BIGINT) AS runs FROM rows_"""))
def agg12(spark, d):
    by_run = L.history_rows(spark, d).groupBy(*RUN).agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "PROVISIONAL").alias("open"))
    return by_run.agg(F.sum("rows").alias("rows"), F.sum("open").alias("open"), F.count("*").alias("runs"))


def naive_rows(spark, d):
    event = L.history_events(spark, d)
    return event.where("event_type IN ('STARTED', 'COMPLETED')").select(*NODE, F.col("result_hash").alias("output_hash"))


_NAIVE = f"""
nr AS (SELECT {_NODE}, result_hash AS output_hash FROM events_ WHERE event_type IN ('STARTED', 'COMPLETED')),
nh AS (SELECT {_NODE}, {_ACCEPTED} AS accepted, result_hash FROM hist),
nb AS (SELECT * FROM nh LEFT JOIN (SELECT {_NODE}, output_hash, count(*) AS n FROM nr GROUP BY ALL) USING ({_NODE}))
SELECT * FROM (SELECT namespace, workflow_id, run_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS rows,
  CAST(sum(CASE WHEN accepted AND n IS NOT NULL AND output_hash IS DISTINCT FROM result_hash THEN n ELSE 0 END) AS BIGINT) AS divergent_rows,
  count(*) FILTER (accepted AND n IS NULL) AS lost_rows, CAST(sum(CASE WHEN NOT accepted THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS orphan_rows FROM nb GROUP BY ALL)
LEFT JOIN (SELECT namespace, workflow_id, run_id, CAST(sum(c) AS BIGINT) AS duplicate_rows FROM (SELECT {_NODE}, count(*) - 1 AS c FROM nr GROUP BY ALL) GROUP BY ALL) USING (namespace, workflow_id, run_id)"""


@R.add("b1_naive_counters", sql("hist", then="," + _NAIVE).replace("\n,\nnr AS", ",\nnr AS"))
def b1(spark, d):
    return history.naive_counters(naive_rows(spark, d), judged(spark, d))


@R.add("join9_stuck_runs", sql("nodes", "runs", then="""
SELECT DISTINCT r.namespace, r.workflow_id, r.run_id FROM runs r WHERE status = 'RUNNING' OR EXISTS (SELECT 1 FROM nodes n WHERE n.run_id = r.run_id AND n.status = 'PROVISIONAL')"""))
def join9(spark, d):
    runs = L.runs(spark, d)
    stuck = runs.join(fencing.nodes(spark, d).where("status = 'PROVISIONAL'"), RUN, "left_semi").select(*RUN)
    return runs.where("status = 'RUNNING'").select(*RUN).unionByName(stuck).distinct()


@R.add("set2_set_difference", sql("hist", "rows_", then=f"SELECT {_NODE} FROM rows_ EXCEPT SELECT {_NODE} FROM hist"))
def set2(spark, d):
    return L.history_rows(spark, d).select(*NODE).subtract(hist(spark, d).select(*NODE))


@R.add("flt4_distinct_from", sql("attempts", "nodes", then=f"""
SELECT {_NODE}, a.arrival, (a.fence_scheduled_at, a.attempt) IS DISTINCT FROM (n.fence_scheduled_at, n.attempt) AS other
FROM attempts a JOIN (SELECT {_NODE}, fence_scheduled_at, attempt FROM nodes) n USING ({_NODE})"""))
def flt4(spark, d):
    from tidemark.functions import columns as C

    row = fence.snapshot(L.attempts(spark, d), ["fence_scheduled_at", "attempt"]).select(*NODE, C.fence().alias("row"))
    both = L.attempts(spark, d).select(*NODE, "arrival", C.fence().alias("own")).join(row, NODE)
    return both.select(*NODE, "arrival", C.distinct_from(F.col("own"), F.col("row")).alias("other"))
