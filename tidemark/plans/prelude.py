"""The relations of ``sources.ledgerize`` in DuckDB SQL, as common table expressions."""

from __future__ import annotations

_RUN = "'default' AS namespace, 'wf-' || CAST({0} % 1000 AS VARCHAR) AS workflow_id, CAST({0} AS VARCHAR) AS run_id"
_PLUS = "({0} + to_microseconds(CAST({1} AS BIGINT)))"


def _run(x: str) -> str:
    return _RUN.format(x)


def _plus(ts: str, micros: str) -> str:
    return _PLUS.format(ts, micros)


_FINISHED = _plus("l_shipdate", "CAST(l_quantity AS BIGINT) * 1234500")

CTES: dict[str, str] = {
    "attempts": f"""
SELECT {_run('l_orderkey')}, CAST(l_linenumber - 1 AS INTEGER) AS seq,
 CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS attempt,
 l_shipdate AS fence_scheduled_at,
 CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS INTEGER) AS arrival,
 CASE WHEN l_partkey % 17 <> 0 THEN CAST(l_quantity AS INTEGER) END AS tokens_in, CAST(l_partkey % 100 AS INTEGER) AS tokens_out,
 CASE WHEN l_suppkey % 10 <> 0 THEN CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) * 100 AS DECIMAL(20,6)) * CAST('0.000001' AS DECIMAL(7,6)) AS DECIMAL(14,6)) END AS cost_usd,
 sha256((l_partkey % 10) || ':' || (l_suppkey % 2)) AS output_hash,
 {_plus('l_shipdate', '(l_suppkey * 37 % 600 - 300) * 1000000')} AS worker_time,
 'a' || l_linenumber AS activity_id,
 CASE WHEN l_partkey % 11 = 0 THEN 'n' || (l_suppkey % 7) ELSE 'g' || (l_partkey % 5) || '.sub.n' || (l_suppkey % 7) END AS activity_type,
 'n' || (l_suppkey % 7) AS node,
 CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_linenumber AS INTEGER) END AS lg_step, '~' || lpad(CAST(l_partkey % 3 AS VARCHAR), 10, '0') AS lg_path,
 '{{"result":{{"v":' || (l_partkey % 10) || '}},"langgraph_command":' || CASE WHEN l_partkey % 7 = 0 THEN '{{"update":1}}' ELSE 'null' END
   || ',"langgraph_interrupts":' || CASE WHEN l_partkey % 5 = 0 THEN '[1]' ELSE 'null' END || '}}' AS output_json,
 CAST(l_partkey % 4000 AS INTEGER) AS input_bytes, l_shipdate AS started_at, {_FINISHED} AS finished_at,
 {_plus(_FINISHED, 'l_suppkey * 1000 + 500')} AS commit_at,
 CASE WHEN l_linestatus = 'F' THEN 'commit' WHEN l_returnflag = 'R' THEN 'abandon' END AS op
FROM lineitem""",
    "log": """
SELECT *, CASE WHEN coalesce((fence_scheduled_at, attempt) >= max((fence_scheduled_at, attempt)) OVER (
   PARTITION BY run_id, seq ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 'WROTE' ELSE 'FENCED_OUT' END AS outcome
FROM attempts""",
    "nodes": """
SELECT * EXCLUDE (rn, op, commit_at, arrival), CASE op WHEN 'commit' THEN 'COMMITTED' WHEN 'abandon' THEN 'ABANDONED' ELSE 'PROVISIONAL' END AS status,
 CASE WHEN op = 'commit' THEN commit_at END AS committed_at
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY fence_scheduled_at DESC, attempt DESC) AS rn FROM attempts) WHERE rn = 1""",
    "runs": f"""
SELECT {_run('o_orderkey')}, o_orderpriority AS workflow_type,
 CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status, o_orderdate AS first_seen_at,
 CAST(o_custkey % 8 AS INTEGER) AS node_count, CAST(o_custkey % 4 AS INTEGER) AS accepted_count
FROM orders""",
    "sealed": """
SELECT * EXCLUDE (node_count, accepted_count, by_), by_ AS sealed_by, CASE WHEN by_ IS NOT NULL THEN first_seen_at END AS sealed_at,
 n % 6 = 1 AND by_ IS NOT NULL AS degraded, CASE WHEN n % 6 = 1 AND by_ IS NOT NULL AND n % 5 <> 0 THEN [CAST(n % 3 AS INTEGER), CAST(n % 3 + 2 AS INTEGER)] END AS missing_seqs,
 CASE WHEN by_ IS NOT NULL THEN CAST(n % 9 AS INTEGER) END AS node_count, CASE WHEN by_ IS NOT NULL THEN CAST(n % 7 AS INTEGER) END AS committed_count,
 CASE WHEN by_ IS NOT NULL THEN CAST(n % 2 AS INTEGER) END AS abandoned_count
FROM (SELECT *, CASE WHEN n % 4 = 1 THEN 'reconcile' WHEN n % 4 <> 0 THEN 'seal' END AS by_ FROM (SELECT *, CAST(run_id AS BIGINT) AS n FROM runs))""",
    "run_effects": f"""
SELECT {_run('l_orderkey')}, CAST(l_linenumber - 1 AS INTEGER) AS seq, 'send-' || lower(l_returnflag) AS name,
 sha256(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS key,
 CASE WHEN l_linestatus = 'F' THEN 'DONE' ELSE 'STARTED' END AS status, CAST(l_partkey % 3 AS INTEGER) AS duplicates_prevented
FROM lineitem""",
    "events_": f"""
SELECT {_run('(event_id // 80)')}, CAST((event_id // 8) % 10 AS INTEGER) AS seq, event_id // 8 AS scheduled_event_id, event_id, ts AS event_time,
 CASE event_type WHEN 'view' THEN 'SCHEDULED' WHEN 'click' THEN 'STARTED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'CANCEL_REQUESTED' END AS event_type,
 CAST(user_id % 3 + 1 AS INTEGER) AS attempt, sha256(CAST(user_id % 5 AS VARCHAR)) AS result_hash, CAST(round(value * 100) AS BIGINT) AS size
FROM events""",
    "hist": """
SELECT namespace, workflow_id, run_id, seq, scheduled_event_id,
 arg_max(attempt, event_id) FILTER (event_type = 'STARTED' AND event_id > opened) AS attempt,
 max(event_time) FILTER (event_type = 'STARTED' AND event_id > opened) AS started_at,
 coalesce(arg_max(event_type, event_id) FILTER (event_type IN ('COMPLETED', 'FAILED') AND event_id > opened), 'SCHEDULED') AS status,
 coalesce(min(event_id) FILTER (event_type = 'CANCEL_REQUESTED' AND event_id > opened)
   < coalesce(min(event_id) FILTER (event_type IN ('COMPLETED', 'FAILED') AND event_id > opened), 9223372036854775807), false) AS cancel_requested,
 arg_max(result_hash, event_id) FILTER (event_type = 'COMPLETED' AND event_id > opened) AS result_hash
FROM (SELECT *, min(event_id) FILTER (event_type = 'SCHEDULED') OVER (PARTITION BY scheduled_event_id) AS opened FROM events_)
WHERE opened IS NOT NULL GROUP BY ALL""",
    "rows_": """
SELECT namespace, workflow_id, run_id, CAST(CASE WHEN scheduled_event_id % 17 = 0 THEN seq + 100 ELSE seq END AS INTEGER) AS seq,
 CASE scheduled_event_id % 3 WHEN 0 THEN 'PROVISIONAL' WHEN 1 THEN 'COMMITTED' ELSE 'ABANDONED' END AS status,
 CASE WHEN scheduled_event_id % 11 = 0 THEN sha256('tampered') ELSE h END AS output_hash, CAST(scheduled_event_id % 4 + 1 AS INTEGER) AS attempt
FROM (SELECT namespace, workflow_id, run_id, seq, scheduled_event_id, arg_max(result_hash, event_id) AS h FROM events_ GROUP BY ALL)
WHERE scheduled_event_id % 5 <> 0""",
    "deltas": f"""
SELECT {_run('conv_id')}, CAST(turn AS INTEGER) AS seq, CAST(turn AS INTEGER) AS step, role AS path, CAST(length(text) AS INTEGER) AS size, sha256(text) AS item
FROM conversations""",
    "payload_log": f"""
SELECT doc_id AS id, coalesce(text, '') AS data, CASE WHEN doc_id % 29 = 0 THEN 'other' ELSE 'default' END AS namespace,
 CASE WHEN doc_id % 13 = 0 THEN '' ELSE coalesce(source, '') END AS workflow_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE CAST(doc_id % 5 AS VARCHAR) END AS run_id,
 CASE WHEN doc_id % 7 = 0 THEN 'binary/encrypted' ELSE 'json/plain' END AS encoding,
 {_plus("TIMESTAMP '2024-01-01'", 'doc_id % 1000 * 3600000000')} AS created_at,
 {_plus("TIMESTAMP '2024-01-01'", '(doc_id % 1000 + doc_id % 100) * 3600000000')} AS last_ref_at
FROM documents""",
    "states": f"""
SELECT workflow_id, CASE WHEN n % 3 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
 CASE WHEN n % 3 <> 0 THEN {_plus("TIMESTAMP '2024-01-01'", 'n * 86400000000')} END AS close_time, n = 7 AS is_schedule_action
FROM (SELECT DISTINCT workflow_id, coalesce(TRY_CAST(regexp_replace(workflow_id, '[^0-9]', '', 'g') AS BIGINT), 0) AS n FROM payload_log WHERE workflow_id <> '')
WHERE n % 5 <> 4""",
    "calls": f"""
SELECT {_run('l_orderkey')}, CAST(l_linenumber - 1 AS INTEGER) AS seq,
 CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS attempt, 0 AS call_idx,
 ['gpt-4o', 'gpt-4o-mini', 'gpt-4o-mini-2024', 'claude-3', 'local'][l_partkey % 5 + 1] AS model,
 CAST(l_quantity AS BIGINT) AS tokens_in, CAST(l_partkey % 100 AS BIGINT) AS tokens_out, sha256(CAST(l_partkey % 3 AS VARCHAR)) AS request_hash
FROM lineitem""",
    "prices": """
SELECT * FROM (VALUES ('gpt-4o', CAST(2.5 AS DECIMAL(10,4)), CAST(10 AS DECIMAL(10,4))), ('gpt-4o-mini', CAST(0.15 AS DECIMAL(10,4)), CAST(0.6 AS DECIMAL(10,4))),
 ('claude-3', CAST(3 AS DECIMAL(10,4)), CAST(15 AS DECIMAL(10,4)))) AS p(prefix, price_in, price_out)""",
    "effect_log": """
SELECT 'default' AS namespace, 'wf-' || (o_custkey % 20) AS workflow_id, CAST(o_custkey % 50 AS VARCHAR) AS run_id, CAST(o_custkey % 3 AS INTEGER) AS seq,
 o_orderpriority AS name, 0 AS idx, o_orderkey AS arrival,
 ['call', 'done', 'call', 'crash', 'resolve-not-done', 'call', 'resolve-done'][o_orderkey % 7 + 1] AS event,
 sha256(o_orderpriority || CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE '' END) AS request_hash, '{"id":' || o_orderkey || '}' AS result
FROM orders""",
}

_NEEDS = {"sealed": ["runs"], "log": ["attempts"], "nodes": ["attempts"], "hist": ["events_"], "rows_": ["events_"], "states": ["payload_log"]}


def sql(*names: str, then: str) -> str:
    """A statement over the named relations and those that they need."""
    order: list[str] = []
    for name in names:
        for part in (*_NEEDS.get(name, []), name):
            if part not in order:
                order.append(part)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + then
