"""Plain relational operators, windows and bench analytics."""

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.model import NODE, RUN
from tidemark.operators import growth as G
from tidemark.operators import text as T
from tidemark.plans.fencing import log, nodes
from tidemark.plans.prelude import sql
from tidemark.plans.registry import Registry
from tidemark.sources import ledgerize as L
from tidemark.sources.files import optional

R = Registry()
_NODE = "namespace, workflow_id, run_id, seq"
_RUN = "namespace, workflow_id, run_id"


@R.add("prj1_null_safe_sum", sql("nodes", then=f"SELECT {_NODE}, coalesce(tokens_in, 0) + coalesce(tokens_out, 0) AS tokens FROM nodes"))
def prj1(spark, d):
    return nodes(spark, d).select(*NODE, C.tokens().alias("tokens"))


@R.add("prj2_is_not_null", sql("nodes", then=f"SELECT {_NODE}, committed_at IS NOT NULL AS committed FROM nodes"))
def prj2(spark, d):
    return nodes(spark, d).select(*NODE, F.col("committed_at").isNotNull().alias("committed"))


@R.add("prj3_duration_ms", sql("nodes", then=f"SELECT {_NODE}, CAST(round((epoch_us(finished_at) - epoch_us(started_at)) / 1000.0) AS BIGINT) AS duration_ms FROM nodes"))
def prj3(spark, d):
    return nodes(spark, d).select(*NODE, C.duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"))


@R.add("prj4_graph_name", sql("nodes", then=f"SELECT {_NODE}, nullif(regexp_extract(activity_type, '^(.*)\\.[^.]*$', 1), '') AS graph FROM nodes"))
def prj4(spark, d):
    return nodes(spark, d).select(*NODE, C.graph_of(F.col("activity_type")).alias("graph"))


@R.add("prj5_kind", sql("nodes", then=f"""
SELECT {_NODE}, CASE WHEN json_extract_string(output_json, '$.langgraph_interrupts') IS NOT NULL THEN 'INTERRUPT' WHEN json_extract_string(output_json, '$.langgraph_command') IS NOT NULL THEN 'COMMAND' ELSE 'UPDATE' END AS kind FROM nodes"""))
def prj5(spark, d):
    return nodes(spark, d).select(*NODE, C.kind_of(F.col("output_json")).alias("kind"))


@R.add("prj6_short_hash", sql("nodes", then=f"SELECT {_NODE}, output_hash[:8] || '...' AS short, run_id[:12] AS run FROM nodes"))
def prj6(spark, d):
    return nodes(spark, d).select(*NODE, C.short(F.col("output_hash")).alias("short"), F.left("run_id", F.lit(12)).alias("run"))


@R.add("flt1_membership", sql("nodes", then=f"SELECT {_NODE}, status FROM nodes WHERE seq IN (1, 3, 5)"))
def flt1(spark, d):
    return nodes(spark, d).where(F.col("seq").isin(1, 3, 5)).select(*NODE, "status")


@R.add("flt2_optional_filter", sql("nodes", then=f"SELECT {_NODE}, node FROM nodes WHERE node = 'n3'"))
def flt2(spark, d):
    return optional(nodes(spark, d), node="n3", status=None).select(*NODE, "node")


@R.add("flt5_prefix", sql("runs", then=f"SELECT {_RUN} FROM runs WHERE starts_with(workflow_id, 'wf-1')"))
def flt5(spark, d):
    return L.runs(spark, d).where(C.starts_with(F.col("workflow_id"), "wf-1")).select(*RUN)


@R.add("join1_attempts_nodes", sql("log", "nodes", then=f"SELECT {_NODE}, l.attempt, l.outcome, n.status FROM (SELECT {_NODE}, attempt, outcome FROM log) l JOIN (SELECT {_NODE}, status FROM nodes) n USING ({_NODE})"))
def join1(spark, d):
    return log(spark, d).select(*NODE, "attempt", "outcome").join(nodes(spark, d).select(*NODE, "status"), NODE)


@R.add("join2_runs_left_nodes", sql("runs", "nodes", then=f"SELECT {_RUN}, seq FROM (SELECT {_RUN} FROM runs) r LEFT JOIN (SELECT {_NODE} FROM nodes) n USING ({_RUN})"))
def join2(spark, d):
    return L.runs(spark, d).select(*RUN).join(nodes(spark, d).select(*NODE), RUN, "left")


@R.add("join3_scalar_subqueries", sql("runs", "nodes", then="""
SELECT run_id, (SELECT count(*) FROM nodes n WHERE n.run_id = r.run_id) AS rows, (SELECT CAST(coalesce(sum(n.tokens_out), 0) AS BIGINT) FROM nodes n WHERE n.run_id = r.run_id) AS tokens FROM runs r"""))
def join3(spark, d):
    counts = nodes(spark, d).groupBy("run_id").agg(F.count("*").alias("rows"), F.sum("tokens_out").alias("tokens"))
    return L.runs(spark, d).select("run_id").join(counts, "run_id", "left").na.fill(0)


@R.add("join10_multi_column_in", sql("log", then=f"SELECT {_NODE}, attempt FROM log WHERE (run_id, seq) IN (SELECT run_id, seq FROM log GROUP BY ALL HAVING count(*) > 2)"))
def join10(spark, d):
    several = log(spark, d).groupBy("run_id", "seq").count().where("count > 2")
    return log(spark, d).join(several, ["run_id", "seq"], "left_semi").select(*NODE, "attempt")


def points(spark, d):
    """Bytes stored by size class and number of nodes, in two modes."""
    orders = L.read(spark, d, "orders")
    mode = F.when(F.col("o_orderkey") % 2 == 0, "B3").otherwise("B4")
    return orders.groupBy(mode.alias("mode"), (F.col("o_custkey") % 4 * 20).alias("kb"), (F.col("o_custkey") % 3 * 10).alias("nodes")).agg(F.round(F.sum("o_totalprice")).cast("bigint").alias("bytes"))


_POINTS = """WITH points AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'B3' ELSE 'B4' END AS mode, o_custkey % 4 * 20 AS kb, o_custkey % 3 * 10 AS nodes, CAST(round(sum(o_totalprice)) AS BIGINT) AS bytes FROM orders GROUP BY ALL)"""


@R.add("join15_mode_ratio", f"""{_POINTS}
SELECT a.kb, a.nodes, a.bytes AS over, b.bytes AS under, round_even(a.bytes / b.bytes, 1) AS ratio FROM points a JOIN points b USING (kb, nodes) WHERE a.mode = 'B3' AND b.mode = 'B4'""")
def join15(spark, d):
    return G.ratio(points(spark, d), "B3", "B4")


@R.add("agg14_relative_gap", f"""{_POINTS}
SELECT round(max(abs((a.bytes - b.bytes) / CAST(b.bytes AS DOUBLE))), 9) AS gap FROM points a JOIN points b USING (kb, nodes) WHERE a.mode = 'B3' AND b.mode = 'B4'""")
def agg14(spark, d):
    p = points(spark, d)
    return G.relative_gap(p.where("mode = 'B3'"), p.where("mode = 'B4'"), ["kb", "nodes"], "bytes")


@R.add("win2_marginal_slope", f"""{_POINTS}
SELECT series, nodes, round((bytes - b) / (nodes - n), 3) AS slope FROM (SELECT mode || kb AS series, nodes, bytes, lag(bytes) OVER w AS b, lag(nodes) OVER w AS n FROM points WINDOW w AS (PARTITION BY mode || kb ORDER BY nodes)) WHERE n IS NOT NULL""")
def win2(spark, d):
    series = F.concat("mode", F.col("kb").cast("string"))
    return G.slopes(points(spark, d).select(series.alias("series"), "nodes", "bytes"))


@R.add("agg1_filtered_aggregates", sql("log", then="SELECT workflow_id, count(*) FILTER (outcome = 'WROTE') AS wrote, CAST(sum(tokens_out) FILTER (outcome = 'FENCED_OUT') AS BIGINT) AS stale_tokens FROM log GROUP BY 1"))
def agg1(spark, d):
    stale = F.col("outcome") == "FENCED_OUT"
    return log(spark, d).groupBy("workflow_id").agg(F.count_if(~stale).alias("wrote"), F.sum(F.when(stale, F.col("tokens_out"))).alias("stale_tokens"))


@R.add("agg2_count_over_left", sql("runs", "nodes", then=f"SELECT {_RUN}, count(seq) AS rows FROM (SELECT {_RUN} FROM runs) r LEFT JOIN (SELECT {_NODE} FROM nodes) n USING ({_RUN}) GROUP BY ALL"))
def agg2(spark, d):
    return L.runs(spark, d).select(*RUN).join(nodes(spark, d).groupBy(*RUN).agg(F.count("seq").alias("rows")), RUN, "left").na.fill(0, ["rows"])


@R.add("agg3_null_sums", sql("nodes", then="SELECT node, CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost FROM nodes GROUP BY 1"))
def agg3(spark, d):
    return nodes(spark, d).groupBy("node").agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens"), F.sum("cost_usd").cast("double").alias("cost"))


@R.add("agg4_string_agg_distinct", sql("nodes", then="SELECT workflow_id, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM nodes GROUP BY 1"))
def agg4(spark, d):
    return nodes(spark, d).groupBy("workflow_id").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


@R.add("agg5_min_key", sql("nodes", then="SELECT node, min(output_hash) AS key, min(seq) AS first_seq, count(*) AS rows FROM nodes GROUP BY 1 ORDER BY min(seq), 1"))
def agg5(spark, d):
    return nodes(spark, d).groupBy("node").agg(F.min("output_hash").alias("key"), F.min("seq").alias("first_seq"), F.count("*").alias("rows")).orderBy("first_seq", "node")


@R.add("agg6_count_distinct_struct", sql("log", then="SELECT workflow_id, count(DISTINCT (node, attempt, tokens_in)) AS kinds FROM log GROUP BY 1"))
def agg6(spark, d):
    return log(spark, d).groupBy("workflow_id").agg(F.count_distinct(F.struct("node", "attempt", "tokens_in")).alias("kinds"))


@R.add("agg8_nearest_rank", sql("nodes", then="""
SELECT node, round(v[CAST(round_even(0.5 * (len(v) - 1), 0) AS INTEGER) + 1], 3) AS p50, round(v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1], 3) AS p95, len(v) AS samples
FROM (SELECT node, list_sort(list(CAST(input_bytes AS DOUBLE))) AS v FROM nodes GROUP BY 1)"""))
def agg8(spark, d):
    return G.percentiles(nodes(spark, d).withColumn("v", F.col("input_bytes").cast("double")), ["node"], "v")


@R.add("agg9_median_mean", sql("nodes", then="SELECT node, median(tokens_out) AS median, round(avg(tokens_out), 6) AS mean FROM nodes GROUP BY 1"))
def agg9(spark, d):
    return nodes(spark, d).groupBy("node").agg(F.median("tokens_out").alias("median"), F.round(F.avg("tokens_out"), 6).alias("mean"))


@R.add("agg11_union_totals", sql("log", "nodes", then="SELECT 'attempts' AS what, count(*) AS rows, CAST(sum(tokens_out) AS BIGINT) AS tokens FROM log UNION ALL SELECT 'nodes', count(*), CAST(sum(tokens_out) AS BIGINT) FROM nodes"))
def agg11(spark, d):
    total = lambda df, what: df.agg(F.count("*").alias("rows"), F.sum("tokens_out").alias("tokens")).select(F.lit(what).alias("what"), "rows", "tokens")
    return total(log(spark, d), "attempts").unionByName(total(nodes(spark, d), "nodes"))


_RUNNING = """
run_ AS (SELECT *, sum(size) OVER w AS history_bytes, count(*) FILTER (event_type = 'SCHEDULED') OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nodes_before
 FROM events_ WINDOW w AS (PARTITION BY run_id ORDER BY event_id))"""


@R.add("win1_limit_crossed", sql("events_", then="@@").replace("\n@@", f",{_RUNNING}\nSELECT namespace, workflow_id, run_id, min(event_id) AS event_id, arg_min(nodes_before, event_id) AS nodes FROM run_ WHERE history_bytes > 40000 GROUP BY ALL"))
def win1(spark, d):
    return G.limit_crossed(L.history_events(spark, d), 40000)


@R.add("win3_largest_payload", sql("events_", then=f"SELECT {_RUN}, max(size) AS size, arg_max(event_id, (size, -event_id)) AS event_id FROM events_ GROUP BY ALL"))
def win3(spark, d):
    return G.largest(L.history_events(spark, d))


@R.add("win6_attempt_regression", sql("attempts", then=f"""
SELECT {_NODE}, attempt, highest_before FROM (SELECT *, max(attempt) OVER (PARTITION BY run_id, seq ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before,
 row_number() OVER (PARTITION BY run_id, seq ORDER BY arrival DESC) AS n FROM attempts) WHERE n = 1 AND attempt < highest_before"""))
def win6(spark, d):
    return G.attempt_regressions(L.attempts(spark, d))


@R.add("win7_clock_inversion", sql("attempts", "nodes", then=f"""
SELECT {_NODE}, bool_or(a.attempt <> n.attempt AND a.worker_time > n.worker_time) AS inverted FROM (SELECT {_NODE}, attempt, worker_time FROM attempts) a JOIN (SELECT {_NODE}, attempt, worker_time FROM nodes) n USING ({_NODE})
GROUP BY {_NODE} HAVING count(DISTINCT a.attempt) > 1"""))
def win7(spark, d):
    return G.clock_inversions(log(spark, d), nodes(spark, d))


@R.add("win9_first_wall", sql("events_", then="@@").replace("\n@@", f""",{_RUNNING}
SELECT {_RUN}, CASE WHEN max(size) > 15000 THEN 'payload' WHEN max(history_bytes) > 120000 THEN 'history' WHEN count(*) FILTER (event_type = 'SCHEDULED') > 40 THEN 'nodes' ELSE 'none' END AS wall FROM run_ GROUP BY ALL"""))
def win9(spark, d):
    run = G.running_bytes(L.history_events(spark, d)).groupBy(*RUN).agg(
        F.max("history_bytes").alias("bytes"), F.max("size").alias("size"), F.count_if(F.col("event_type") == "SCHEDULED").alias("nodes")
    )
    return run.select(*RUN, G.wall(F.col("bytes"), F.col("size"), F.col("nodes"), 120000, 15000, 40).alias("wall"))


@R.add("ben1_wall_by_events", sql("events_", then=f"SELECT {_RUN}, CASE WHEN max(size) > 9000 THEN 'payload' WHEN sum(size) > 100000 THEN 'history' WHEN count(*) > 79 THEN 'nodes' ELSE 'none' END AS wall FROM events_ GROUP BY ALL"))
def ben1(spark, d):
    run = L.history_events(spark, d).groupBy(*RUN).agg(F.max("size").alias("size"), F.sum("size").alias("bytes"), F.count("*").alias("nodes"))
    return run.select(*RUN, G.wall(F.col("bytes"), F.col("size"), F.col("nodes"), 100000, 9000, 79).alias("wall"))


@R.add("ben2_stop_outcome", sql("events_", then=f"""
SELECT {_RUN}, CASE WHEN CAST(run_id AS BIGINT) % 3 = 0 THEN 'COMPLETED' WHEN arg_max(event_type, event_id) = 'FAILED' THEN 'STUCK' ELSE 'OPEN' END AS outcome FROM events_ GROUP BY {_RUN}"""))
def ben2(spark, d):
    run = L.history_events(spark, d).groupBy(*RUN).agg(F.max_by("event_type", "event_id").alias("last"))
    status = F.when(F.col("run_id").cast("bigint") % 3 == 0, "COMPLETED").otherwise("RUNNING")
    return run.select(*RUN, G.stop_outcome(status, F.col("last"), F.lit(None).cast("string")).alias("outcome"))


@R.add("ben3_header_bytes", sql("events_", then=f"""
SELECT {_RUN}, CAST(count(*) * 2 AS BIGINT) AS fields, CAST(sum(length('seq') + length(CAST(seq AS VARCHAR)) + length('type') + length(event_type)) AS BIGINT) AS header_bytes FROM events_ WHERE event_type = 'SCHEDULED' GROUP BY {_RUN}"""))
def ben3(spark, d):
    event = L.history_events(spark, d).where("event_type = 'SCHEDULED'")
    fields = F.create_map(F.lit("seq"), F.col("seq").cast("string"), F.lit("type"), F.col("event_type"))
    return G.header_bytes(event.select(*RUN, fields.alias("fields")))


def number_texts(spark, d):
    """Reports that state a number of 0 to 6 places each, some with thousands, beside numbers that are quoted."""
    n = F.col("o_orderkey")
    places = (n % 7).cast("int")
    digits = F.lpad((n * 31 % F.pow(F.lit(10), places).cast("bigint")).cast("string"), places, "0")
    value = F.when(places == 0, (n % 3).cast("string")).otherwise(F.concat(F.lit("0."), digits))
    large = F.when(n % 5 == 0, F.concat(F.lit(" of 1,0"), F.lpad((n % 20).cast("string"), 2, "0")))
    text = F.concat(F.lit("Took "), value, F.lit(" s"), F.coalesce(large, F.lit("")), F.lit(" (see [run 7](x/9.9) `k=8` and <b id=5>r-6</b>)."))
    return L.read(spark, d, "orders").select("o_orderkey", text.alias("text"))


def number_sources(spark, d):
    """JSON with a number of six places at some depth, and the keys 1000 to 1009."""
    k = F.col("p_partkey") * 7919 % 100000 * 10 + 1
    value = F.concat(F.floor(k / 1000000).cast("string"), F.lit("."), F.lpad((k % 1000000).cast("string"), 6, "0"))
    return L.read(spark, d, "part").select(F.concat(F.lit('{"a":[true,{"v":'), value, F.lit('}],"'), (1000 + F.col("p_partkey") % 10).cast("string"), F.lit('":"3"}')).alias("json"))


@R.add("ben5_untraceable_numbers", """
WITH s AS (SELECT o_orderkey, o_orderkey % 7 AS places, o_orderkey * 31 % CAST(pow(10, o_orderkey % 7) AS BIGINT) AS m FROM orders),
t AS (SELECT o_orderkey, places, CASE WHEN places = 0 THEN o_orderkey % 3 ELSE m END AS m FROM s UNION SELECT o_orderkey, 0, 1000 + o_orderkey % 20 FROM s WHERE o_orderkey % 5 = 0 UNION SELECT o_orderkey, 0, 7 FROM s),
k AS (SELECT DISTINCT (p_partkey * 7919 % 100000) * 10 + 1 AS k FROM part),
near AS (SELECT DISTINCT places, (k + 5 * CAST(pow(10, 5 - places) AS BIGINT)) // CAST(pow(10, 6 - places) AS BIGINT) AS m FROM k, (SELECT unnest(range(6)) AS places) UNION SELECT DISTINCT 6, k FROM k
 UNION SELECT DISTINCT 0, 1000 + p_partkey % 10 FROM part)
SELECT o_orderkey, CAST(m / pow(10, places) AS DOUBLE) AS number, CAST(places AS INTEGER) AS places FROM t WHERE (places, m) NOT IN (SELECT places, m FROM near)""")
def ben5(spark, d):
    return T.untraceable(T.numbers(number_texts(spark, d), "o_orderkey", "text"), T.json_numbers(number_sources(spark, d), "json"))


@R.add("ben5_numbers_of_documents")
def ben5_documents(spark, d):
    """Numbers of all documents that the event properties do not know."""
    return T.untraceable(T.numbers(L.read(spark, d, "documents"), "doc_id", "text"), T.json_numbers(L.read(spark, d, "events"), "props"))


@R.add("ben5_json_numbers", "SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number FROM events")
def ben5_json(spark, d):
    return T.json_numbers(L.read(spark, d, "events"), "props").distinct()


@R.add("ben6_bare_claims", r"""
SELECT conv_id, turn, sentence FROM (SELECT conv_id, turn, trim(unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'))) AS sentence FROM conversations)
WHERE sentence <> '' AND regexp_matches(sentence, '(?i)(?:^|[^\p{L}\p{N}])(?:the|und)(?:[^\p{L}\p{N}]|$)') AND NOT regexp_matches(sentence, '(?i)(?:^|[^\p{L}\p{N}])(?:of|die)(?:[^\p{L}\p{N}]|$)')""")
def ben6(spark, d):
    talk = L.read(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return T.bare_claims(talk, "key", "text", ["the", "und"], ["of", "die"]).select("key.conv_id", "key.turn", "sentence")


@R.add("ben7_fault_plan", """
SELECT o_orderkey, o_custkey % 3 = 1 AND o_orderkey % 2 = 0 AS hit, 'F' || (o_orderkey % 6 + 1) AS fault FROM orders""")
def ben7(spark, d):
    plan = F.concat(F.lit("F"), (F.col("o_orderkey") % 6 + 1).cast("string"), F.lit(":wf=1:seq=0"))
    fault, selectors = T.parse_fault(plan)
    hit = T.fault_matches(selectors, {"wf": F.col("o_custkey") % 3, "seq": F.col("o_orderkey") % 2, "run": F.col("o_orderkey")})
    return L.read(spark, d, "orders").select("o_orderkey", hit.alias("hit"), fault.alias("fault"))


@R.add("srt1_order", sql("nodes", then=f"SELECT {_NODE}, lg_step, lg_path FROM nodes WHERE lg_step IS NOT NULL ORDER BY lg_step, lg_path, seq"))
def srt1(spark, d):
    return nodes(spark, d).where("lg_step IS NOT NULL").select(*NODE, "lg_step", "lg_path").orderBy("lg_step", "lg_path", "seq")


@R.add("srt2_recent", sql("runs", then=f"SELECT {_RUN}, first_seen_at FROM runs ORDER BY first_seen_at DESC, {_RUN} LIMIT 50"))
def srt2(spark, d):
    return L.runs(spark, d).select(*RUN, "first_seen_at").orderBy(F.desc("first_seen_at"), *RUN).limit(50)


@R.add("srt3_nulls_last", sql("nodes", then=f"SELECT {_NODE}, CAST(cost_usd AS DOUBLE) AS cost FROM nodes ORDER BY cost_usd DESC NULLS LAST, {_NODE} LIMIT 1"))
def srt3(spark, d):
    return nodes(spark, d).orderBy(F.desc_nulls_last("cost_usd"), *NODE).limit(1).select(*NODE, F.col("cost_usd").cast("double").alias("cost"))


@R.add("set1_union_all", sql("runs", "attempts", then=f"SELECT {_RUN} FROM runs UNION ALL SELECT {_RUN} FROM attempts"))
def set1(spark, d):
    return L.runs(spark, d).select(*RUN).unionByName(L.attempts(spark, d).select(*RUN))


@R.add("set3_distinct", sql("attempts", then="SELECT DISTINCT workflow_id, node FROM attempts"))
def set3(spark, d):
    return L.attempts(spark, d).select("workflow_id", "node").distinct()


@R.add("mdl_violations", sql("nodes", then="SELECT 'check' AS rule, 'status' AS \"column\", status AS value, count(*) AS rows FROM (SELECT CASE WHEN seq = 6 THEN 'LOST' ELSE status END AS status FROM nodes) WHERE status = 'LOST' GROUP BY ALL"))
def mdl(spark, d):
    from tidemark.model import violations

    rows = nodes(spark, d).withColumn("status", F.when(F.col("seq") == 6, "LOST").otherwise(F.col("status")))
    return violations(rows.select(*NODE, "status"), "nodes")
