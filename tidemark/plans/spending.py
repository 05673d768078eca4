"""Effects, model-call journal, prices, waste."""

from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.model import NODE, RUN
from tidemark.operators import effects as E
from tidemark.plans import fencing
from tidemark.plans.prelude import sql
from tidemark.plans.registry import Registry
from tidemark.sources import ledgerize as L

R = Registry()
_NODE = "namespace, workflow_id, run_id, seq"


def replayed(spark, d):
    return E.replay(L.effect_events(spark, d))


def _replayed_sql() -> str:
    """The state machine over the events that the log has, as a fold over each effect's list of events: every step
    appends the state after it."""
    s, called = "acc[len(acc)]", "x[1].event = 'call'"
    first, same, over = f"{s}.status IS NULL", f"x[1].request_hash IS NOT DISTINCT FROM {s}.request_hash", f"coalesce({s}.status, '') = 'DONE'"
    again = f"({called} AND {same} AND {s}.status = 'RESOLVED')"
    moved = f"(NOT {first} AND NOT {over})"
    fields = {
        "arrival": "x[1].arrival", "event": "x[1].event",
        "outcome": f"""CASE WHEN {called} THEN CASE WHEN {first} THEN 'called' WHEN NOT {same} THEN 'divergence' WHEN {over} THEN 'replayed' WHEN {again} THEN 'called' ELSE 'unknown' END
          WHEN {first} THEN 'ignored' WHEN x[1].event = 'crash' THEN 'lost' WHEN {over} THEN 'ignored' WHEN x[1].event = 'done' THEN 'recorded' ELSE 'resolved' END""",
        "status": f"""CASE WHEN {called} THEN CASE WHEN {first} OR {again} THEN 'STARTED' WHEN NOT {same} OR {over} THEN {s}.status ELSE 'UNKNOWN' END
          WHEN {moved} AND x[1].event IN ('done', 'resolve-done') THEN 'DONE' WHEN {moved} AND x[1].event = 'resolve-not-done' THEN 'RESOLVED' ELSE {s}.status END""",
        "request_hash": f"CASE WHEN {called} AND {first} THEN x[1].request_hash ELSE {s}.request_hash END",
        "result": f"CASE WHEN x[1].event = 'done' AND {moved} THEN x[1].result ELSE {s}.result END",
        "attempts": f"CASE WHEN {called} AND {first} THEN 1 WHEN {called} AND {same} THEN {s}.attempts + 1 ELSE {s}.attempts END",
        "duplicates_prevented": f"CASE WHEN {called} AND {same} AND {over} THEN {s}.duplicates_prevented + 1 ELSE {s}.duplicates_prevented END",
        "resolution": f"CASE WHEN {again} THEN NULL WHEN {moved} AND x[1].event = 'resolve-done' THEN 'manual:done' WHEN {moved} AND x[1].event = 'resolve-not-done' THEN 'not-done' ELSE {s}.resolution END",
    }
    kinds = {"arrival": "BIGINT", "attempts": "INTEGER", "duplicates_prevented": "INTEGER"}
    packed = lambda values: "struct_pack(" + ", ".join(f"{n} := CAST({v} AS {kinds.get(n, 'VARCHAR')})" for n, v in values.items()) + ")"
    start = packed({n: "0" if n in kinds else "NULL" for n in fields})
    given = packed({n: n if n in ("arrival", "event", "request_hash", "result") else "0" if n in kinds else "NULL" for n in fields})
    key = f"{_NODE}, name, idx"
    return sql("effect_log", then=f"""
, lists AS (SELECT {key}, list([{given}] ORDER BY arrival) AS events FROM effect_log GROUP BY ALL),
folded AS (SELECT {key}, unnest(list_reduce(events, lambda acc, x: list_append(acc, {packed(fields)}), [{start}])[2:]) AS row FROM lists)
SELECT {key}, sha256(namespace || chr(31) || workflow_id || chr(31) || run_id || chr(31) || seq || chr(31) || name || chr(31) || idx) AS key, row.* FROM folded""").replace("\n\n, lists", ",\nlists")


REPLAYED_SQL = _replayed_sql()


@R.add("eff1_replay", REPLAYED_SQL)
def eff1(spark, d):
    return replayed(spark, d)


@R.add("eff1_outcomes", f"SELECT event, outcome, count(*) AS events FROM ({REPLAYED_SQL}) GROUP BY ALL")
def eff1_outcomes(spark, d):
    return replayed(spark, d).groupBy("event", "outcome").agg(F.count("*").alias("events"))


@R.add("eff2_resolve")
def eff2(spark, d):
    table = E.effects(replayed(spark, d))
    decisions = table.where("seq < 2").select("key", F.when(F.col("seq") == 0, "done").otherwise("not-done").alias("outcome"))
    return E.resolve(table, decisions).select(*E.EFFECT_KEY, "status", "resolution")


@R.add("eff3_keys", sql("effect_log", then=f"""
SELECT arrival, sha256(namespace || chr(31) || workflow_id || chr(31) || run_id || chr(31) || seq || chr(31) || name || chr(31) || idx) AS effect_key,
 sha256(namespace || chr(31) || workflow_id || chr(31) || run_id || chr(31) || seq || chr(31) || 0 || chr(31) || request_hash) AS llm_key FROM effect_log"""))
def eff3(spark, d):
    log = L.effect_events(spark, d).withColumn("call_idx", F.lit(0))
    return log.select("arrival", H.effect_key().alias("effect_key"), H.llm_key().alias("llm_key"))


@R.add("eff3_canonical_hash", sql("effect_log", then="SELECT arrival, sha256(result) AS chash FROM effect_log"))
def eff3_chash(spark, d):
    return L.effect_events(spark, d).select("arrival", H.content_hash("result").alias("chash"))


@R.add("eff3_run_lock", sql("runs", then="""
, crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i)) AS steps),
k AS (SELECT *, hex(encode(namespace || '|' || workflow_id || '|' || run_id)) AS code FROM runs)
SELECT namespace, workflow_id, run_id, xor(list_reduce(list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, (2 * i + 1)::INT, 2))::BIGINT),
  lambda x, b: xor(x >> 8, steps[xor(x & 255, b) + 1]), 4294967295::BIGINT), 4294967295) & 2147483647 AS lock FROM k, crc""").replace("\n\n, crc", ",\ncrc"))
def eff3_lock(spark, d):
    return L.runs(spark, d).select(*RUN, H.run_lock().alias("lock"))


@R.add("llm1_journal", sql("calls", then=f"""
SELECT sha256(namespace || chr(31) || workflow_id || chr(31) || run_id || chr(31) || seq || chr(31) || call_idx || chr(31) || request_hash) AS key, {_NODE}, call_idx, request_hash,
 min(attempt) AS first_attempt, CAST(count(*) - 1 AS INTEGER) AS replays, arg_min(tokens_in, attempt) AS tokens_in, arg_min(tokens_out, attempt) AS tokens_out FROM calls GROUP BY ALL"""))
def llm1(spark, d):
    return E.journal(L.model_calls(spark, d))


@R.add("llm2_message_hash")
def llm2(spark, d):
    talk = L.read(spark, d, "conversations")
    message = F.to_json(F.array(F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), "role", "text")))
    return talk.select("conv_id", "turn", H.message_hash(message).alias("request_hash"))


_PRICED = """
best AS (SELECT model, arg_max(price_in, length(prefix)) AS price_in, arg_max(price_out, length(prefix)) AS price_out
 FROM (SELECT DISTINCT model FROM calls) m JOIN prices ON starts_with(model, prefix) GROUP BY 1),
priced AS (SELECT c.*, price_in, price_out FROM calls c LEFT JOIN best USING (model))"""


def _priced(then: str, *names: str) -> str:
    return sql("calls", "prices", *names, then="@@").replace("\n@@", f",{_PRICED}\n{then}")


@R.add("join14_longest_prefix", _priced("SELECT DISTINCT model, CAST(price_in AS DOUBLE) AS price_in, CAST(price_out AS DOUBLE) AS price_out FROM priced"))
def join14(spark, d):
    calls = E.priced(L.model_calls(spark, d), L.prices(spark))
    return calls.select("model", F.col("price_in").cast("double"), F.col("price_out").cast("double")).distinct()


@R.add("cost1_usage", _priced("""
SELECT workflow_id, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, bool_or(price_in IS NULL) AS unpriced,
 CAST(CASE WHEN NOT bool_or(price_in IS NULL) THEN sum(price_in * tokens_in + price_out * tokens_out) * 100 END AS BIGINT) AS cost_e8 FROM priced GROUP BY 1"""))
def cost1(spark, d):
    calls = E.priced(L.model_calls(spark, d), L.prices(spark))
    used = E.usage(calls, ["workflow_id"])
    cost = F.col("price_in") * F.col("tokens_in").cast("decimal(12,0)") + F.col("price_out") * F.col("tokens_out").cast("decimal(12,0)")
    exact = calls.groupBy("workflow_id").agg(F.bool_or(F.col("price_in").isNull()).alias("unpriced"), (F.sum(cost) * 100).cast("bigint").alias("cost_e8"))
    return used.drop("cost_usd").join(exact.withColumn("cost_e8", F.when(~F.col("unpriced"), F.col("cost_e8"))), "workflow_id")


@R.add("cost1_usage_by_model", _priced("""
SELECT model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
 CAST(CASE WHEN NOT bool_or(price_in IS NULL) THEN round(sum(price_in * tokens_in + price_out * tokens_out), 0) END AS BIGINT) AS micro_usd FROM priced GROUP BY 1"""))
def cost1_model(spark, d):
    used = E.usage(E.priced(L.model_calls(spark, d), L.prices(spark)), ["model"])
    return used.select("model", "tokens_in", "tokens_out", (F.col("cost_usd") * 1000000).cast("bigint").alias("micro_usd"))


_WASTED = f"""
j AS (SELECT {_NODE}, call_idx, request_hash, min(attempt) AS first_attempt FROM calls GROUP BY ALL),
x AS (SELECT c.*, n.attempt AS accepted_attempt, first_attempt FROM calls c LEFT JOIN (SELECT {_NODE}, attempt FROM nodes WHERE status = 'COMMITTED') n USING ({_NODE}) LEFT JOIN j USING ({_NODE}, call_idx, request_hash)),
y AS (SELECT *, accepted_attempt IS NOT NULL AND accepted_attempt <> attempt AND first_attempt IS DISTINCT FROM attempt AS wasted,
  accepted_attempt IS NOT NULL AND accepted_attempt <> attempt AND first_attempt IS NOT DISTINCT FROM attempt AS replayed FROM x)"""


def wasted(spark, d):
    calls = L.model_calls(spark, d)
    accepted = fencing.nodes(spark, d).where("status = 'COMMITTED'")
    return E.wasted_calls(calls, accepted, E.journal(calls))


@R.add("cost2_wasted_calls", sql("calls", "nodes", then="@@").replace("\n@@", f",{_WASTED}\nSELECT {_NODE}, attempt, wasted, replayed FROM y"))
def cost2(spark, d):
    return wasted(spark, d).select(*NODE, "attempt", "wasted", "replayed")


@R.add("join13_bill_accepted_journal", sql("calls", "nodes", then="@@").replace("\n@@", f",{_WASTED}\nSELECT {_NODE}, attempt, accepted_attempt, first_attempt FROM y"))
def join13(spark, d):
    return wasted(spark, d).select(*NODE, "attempt", "accepted_attempt", "first_attempt")


@R.add("cost3_waste_cut", sql("calls", "nodes", then="@@").replace("\n@@", f""",{_WASTED}
SELECT b AS before, a AS after, round((b - a) * 100.0 / b, 1) AS cut_percent FROM (SELECT CAST(sum(tokens_in) FILTER (accepted_attempt <> attempt) AS BIGINT) AS b, CAST(sum(tokens_in) FILTER (wasted) AS BIGINT) AS a FROM y)"""))
def cost3(spark, d):
    other = F.col("accepted_attempt") != F.col("attempt")
    sums = wasted(spark, d).agg(F.sum(F.when(other, F.col("tokens_in"))).alias("before"), F.sum(F.when(F.col("wasted"), F.col("tokens_in"))).alias("after"))
    return sums.withColumn("cut_percent", E.cut_percent(F.col("before"), F.col("after")).cast("double"))


@R.add("join12_call_paths", sql("nodes", "calls", then=f"""
SELECT {_NODE}, c.attempt, json_extract_string(output_json, '$.result.v') = CAST(c.tokens_out % 10 AS VARCHAR) AS same
FROM (SELECT {_NODE}, output_json FROM nodes) n JOIN calls c USING ({_NODE})"""))
def join12(spark, d):
    both = fencing.nodes(spark, d).select(*NODE, "output_json").join(L.model_calls(spark, d), NODE)
    return both.select(*NODE, "attempt", (F.get_json_object("output_json", "$.result.v") == (F.col("tokens_out") % 10).cast("string")).alias("same"))


@R.add("ben4_surplus_effects", sql("effect_log", then="SELECT namespace, workflow_id, CAST(count(*) - count(DISTINCT (name, idx, request_hash)) AS BIGINT) AS surplus FROM effect_log GROUP BY ALL"))
def ben4(spark, d):
    return E.surplus_effects(L.effect_events(spark, d))


@R.add("win10_occurrence", sql("effect_log", then=f"SELECT arrival, CAST(row_number() OVER (PARTITION BY namespace, workflow_id, run_id, seq, arrival % 3, name ORDER BY arrival) - 1 AS INTEGER) AS idx FROM effect_log"))
def win10(spark, d):
    calls = L.effect_events(spark, d).withColumn("attempt", F.col("arrival") % 3)
    return E.occurrence(calls).select("arrival", "idx")
