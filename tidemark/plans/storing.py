"""Chunk storage and its collection."""

import re

from pyspark.sql import functions as F

from tidemark.model import RUN
from tidemark.operators import storage as S
from tidemark.plans.prelude import sql
from tidemark.plans.registry import Registry
from tidemark.sources import ledgerize as L
from tidemark.streaming.jobs import written

R = Registry()
#: The time of a sweep and what it keeps.
SWEEP = "2024-02-10 00:00:00"
_TOUCHED, _CUTOFF, _ORPHAN = "TIMESTAMP '2024-02-08'", "TIMESTAMP '2024-01-25'", "TIMESTAMP '2024-01-20'"

_STORE = f"""
stored AS (SELECT sha256(data) AS claim, any_value(data) AS data, arg_min(encoding, id) AS encoding, min(created_at) AS created_at, max(last_ref_at) AS last_ref_at FROM payload_log GROUP BY 1),
cut AS (SELECT *, unnest(range(CASE WHEN encoding = 'json/plain' THEN greatest(1, CAST(ceil(length(data) / {L.CHUNK}.0) AS INTEGER)) ELSE 1 END)) AS position FROM stored),
parts AS (SELECT claim, CAST(position AS INTEGER) AS position, CASE WHEN encoding = 'json/plain' THEN substring(data, CAST(position * {L.CHUNK} + 1 AS BIGINT), {L.CHUNK}) ELSE data END AS data FROM cut),
chunk AS (SELECT claim, position, sha256(data) AS hash, data, CAST(octet_length(encode(data)) AS BIGINT) AS size FROM parts),
uniq AS (SELECT hash, any_value(size) AS size FROM chunk GROUP BY 1),
refs AS (SELECT sha256(data) AS claim, namespace, workflow_id, run_id, min(created_at) AS created_at, max(last_ref_at) AS last_ref_at FROM payload_log GROUP BY ALL)"""
_VERDICTS = f"""
ids AS (SELECT DISTINCT namespace, workflow_id FROM refs WHERE workflow_id <> ''),
verdicts AS (SELECT namespace, workflow_id, CASE WHEN namespace <> 'default' THEN 'skipped' WHEN coalesce(is_schedule_action, false) THEN 'schedule' WHEN status = 'RUNNING' THEN 'open'
  WHEN close_time > {_CUTOFF} THEN 'retained' ELSE 'expired' END AS verdict FROM ids LEFT JOIN states USING (workflow_id))"""
_SWEEP = f"""
gone AS (SELECT r.* FROM refs r LEFT JOIN verdicts v USING (namespace, workflow_id)
  WHERE (v.verdict = 'expired' AND r.last_ref_at < {_TOUCHED} AND r.created_at < {_CUTOFF}) OR (workflow_id = '' AND r.last_ref_at < {_ORPHAN})),
live AS (SELECT claim FROM (SELECT claim, namespace, workflow_id, run_id FROM refs EXCEPT SELECT claim, namespace, workflow_id, run_id FROM gone)),
deadm AS (SELECT claim, last_ref_at FROM stored WHERE last_ref_at < {_TOUCHED} AND claim NOT IN (SELECT claim FROM live)),
cseen AS (SELECT hash, any_value(size) AS size, max(s.last_ref_at) AS last_ref_at FROM chunk JOIN (SELECT claim, last_ref_at FROM stored) s USING (claim) GROUP BY 1),
deadc AS (SELECT hash, size FROM cseen WHERE last_ref_at < {_TOUCHED} AND hash NOT IN (SELECT hash FROM chunk WHERE claim NOT IN (SELECT claim FROM deadm)))"""


def _sql(then: str, sweep: bool = False) -> str:
    more = f"{_STORE}" + (f",{_VERDICTS},{_SWEEP}" if sweep else "")
    names = ("payload_log", "states") if sweep else ("payload_log",)
    return sql(*names, then="@@").replace("\n@@", f",{more}\n{then}")


def stored(spark, d):
    log = L.payloads(spark, d).withColumn("claim", F.sha2("data", 256))
    return log.groupBy("claim").agg(F.any_value("data").alias("data"), F.min_by("encoding", "id").alias("encoding"), F.min("created_at").alias("created_at"), F.max("last_ref_at").alias("last_ref_at"))


def chunks(spark, d):
    return S.cut_fixed(stored(spark, d), L.CHUNK)


def refs(spark, d):
    return S.references(L.payloads(spark, d).withColumn("claim", F.sha2("data", 256)))


def payloads(spark, d):
    return S.manifests(chunks(spark, d)).join(stored(spark, d).select("claim", "created_at", "last_ref_at"), "claim")


def chunk_table(spark, d):
    seen = stored(spark, d).select("claim", "last_ref_at")
    return chunks(spark, d).join(seen, "claim").groupBy("hash").agg(F.any_value("size").alias("size"), F.max("last_ref_at").alias("last_ref_at"))


_at = lambda text: F.expr(text.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


def verdicts(spark, d):
    return S.workflow_verdicts(refs(spark, d), L.workflow_states(spark, d), _at(_CUTOFF), "default")


def expired(spark, d):
    return S.expired_refs(refs(spark, d), verdicts(spark, d), _at(_TOUCHED), _at(_CUTOFF), _at(_ORPHAN))


def dead(spark, d):
    return S.dead_manifests(payloads(spark, d), refs(spark, d), expired(spark, d), _at(_TOUCHED))


def dead_chunks(spark, d):
    return S.dead_chunks(chunk_table(spark, d), payloads(spark, d), dead(spark, d), _at(_TOUCHED))


@R.add("sto1_fastcdc")
def sto1(spark, d):
    """Content-defined chunks of small size, so that texts of a few KB are cut."""
    data = stored(spark, d).withColumn("data", F.col("data").cast("binary"))
    return S.cut(data, 256, 1024, 4096).select("claim", "position", F.lower(F.hex("hash")).alias("hash"), "size")


@R.add("sto1_chunk_sizes")
def sto1_sizes(spark, d):
    """What content-defined chunking saves: logical and unique bytes."""
    cut = sto1(spark, d)
    unique = cut.groupBy("hash").agg(F.first("size").alias("size"))
    return unique.agg(F.sum("size").alias("unique_bytes"), F.count("*").alias("chunks"))


@R.add("sto2_store_fixed", _sql("SELECT claim, position, hash, size FROM chunk"))
def sto2(spark, d):
    return chunks(spark, d).drop("data")


@R.add("sto2_manifests", _sql("SELECT claim, array_to_string(list(hash ORDER BY position), ',') AS chunks, CAST(sum(size) AS BIGINT) AS size FROM chunk GROUP BY 1"))
def sto2_manifests(spark, d):
    return S.manifests(chunks(spark, d)).withColumn("chunks", F.array_join("chunks", ","))


@R.add("sto3_touch", _sql("SELECT claim, created_at, last_ref_at FROM stored"))
def sto3(spark, d):
    return S.touched(L.payloads(spark, d).withColumn("claim", F.sha2("data", 256)))


@R.add("sto4_put_new_bytes", _sql("""
SELECT count(*) AS new_chunks, CAST(coalesce(sum(size), 0) AS BIGINT) AS new_bytes FROM uniq WHERE hash NOT IN (SELECT c.hash FROM chunk c JOIN stored s USING (claim) WHERE s.created_at < TIMESTAMP '2024-01-15')"""))
def sto4(spark, d):
    early = stored(spark, d).where(F.col("created_at") < _at("TIMESTAMP '2024-01-15'")).select("claim")
    cut = chunks(spark, d)
    known = cut.join(early, "claim", "left_semi").select("hash")
    return S.new_chunks(cut, known).agg(F.count("*").alias("new_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("new_bytes"))


@R.add("sto5_retrieve", _sql("""
SELECT claim, CASE WHEN problem IS NULL THEN sha256(data) END AS data_sha256, problem FROM (SELECT s.claim, s.data, CASE WHEN bool_or(c.hash LIKE '0%') THEN 'missing chunk' END AS problem
 FROM stored s JOIN chunk c USING (claim) GROUP BY s.claim, s.data)"""))
def sto5(spark, d):
    """Retrieval from a store that lost the chunks whose hash starts with 0."""
    store = S.distinct_chunks(chunks(spark, d)).where("NOT startswith(hash, '0')")
    return S.retrieve(S.manifests(chunks(spark, d)), store).select("claim", F.sha2("data", 256).alias("data_sha256"), "problem")


@R.add("sto6_references", _sql("SELECT * FROM refs"))
def sto6(spark, d):
    return refs(spark, d)


_TOTALS = """SELECT CAST(sum(stores) AS BIGINT) AS stores, CAST(sum(stores) - count(*) FILTER (fresh) AS BIGINT) AS dedupe_hits, CAST(sum(bytes) AS BIGINT) AS logical_bytes,
 count(*) FILTER (fresh AND encoding <> 'json/plain') AS opaque, {unique} AS unique_bytes, CAST(sum(bytes) AS BIGINT) - {unique} AS deduped_bytes FROM met"""


@R.add("sto7_metrics", _sql("@@").replace("\n@@", """
, met AS (SELECT sha256(data) AS claim, count(*) AS stores, sum(octet_length(encode(data))) AS bytes, arg_min(encoding, id) AS encoding, true AS fresh FROM payload_log GROUP BY 1)
""" + _TOTALS.format(unique="(SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM uniq)")))
def sto7(spark, d):
    return S.metrics(L.payloads(spark, d).withColumn("claim", F.sha2("data", 256)), chunks(spark, d))


_EARLY = "TIMESTAMP '2024-01-15'"
#: The store after two puts: payloads of the first days, then the whole log.
_PUTS = f"""
early AS (SELECT sha256(data) AS claim, arg_min(encoding, id) AS encoding, min(created_at) AS created_at, max(last_ref_at) AS seen_at FROM payload_log WHERE created_at < {_EARLY} GROUP BY 1),
met AS (SELECT sha256(data) AS claim, any_value(data) AS data, count(*) AS stores, sum(octet_length(encode(data))) AS bytes, arg_min(encoding, id) AS encoding, min(created_at) AS created_at, max(last_ref_at) AS seen_at,
  sha256(data) NOT IN (SELECT claim FROM early) AS fresh FROM payload_log GROUP BY 1),
held AS (SELECT m.claim, m.data, coalesce(e.encoding, m.encoding) AS encoding, coalesce(e.created_at, m.created_at) AS created_at, m.seen_at, m.fresh FROM met m LEFT JOIN early e USING (claim)),
pieces AS (SELECT *, unnest(range(CASE WHEN encoding = 'json/plain' THEN greatest(1, CAST(ceil(length(data) / {L.CHUNK}.0) AS INTEGER)) ELSE 1 END)) AS position FROM held),
listed AS (SELECT claim, position, created_at, seen_at, fresh, CASE WHEN encoding = 'json/plain' THEN substring(data, CAST(position * {L.CHUNK} + 1 AS BIGINT), {L.CHUNK}) ELSE data END AS part FROM pieces),
kept AS (SELECT sha256(part) AS hash, CAST(any_value(octet_length(encode(part))) AS BIGINT) AS size, min(created_at) FILTER (NOT fresh) AS made_early, min(created_at) AS made, max(seen_at) AS last_ref_at, bool_and(fresh) AS new, count(DISTINCT claim) AS listed FROM listed GROUP BY 1)"""


def _puts(then: str) -> str:
    return sql("payload_log", then="@@").replace("\n@@", f",{_PUTS}\n{then}")


def two_puts(spark, d):
    """The whole log put into a store that has the payloads of its first days. ``counts`` are kept along."""
    log = L.payloads(spark, d).withColumn("claim", F.sha2("data", 256))
    cutter = lambda rows: S.cut_fixed(rows, L.CHUNK)
    when = log.schema["created_at"].dataType.simpleString()
    empty = lambda fields: spark.createDataFrame([], f"{fields}, created_at {when}, last_ref_at {when}")
    first = S.put(
        log.where(F.col("created_at") < _at(_EARLY)),
        empty("claim string, namespace string, workflow_id string, run_id string"),
        empty("claim string, chunks array<string>, size bigint, encoding string, deduped boolean"),
        empty("hash string, data string, size bigint"),
        cutter,
    )
    held = [written(t) for t in (first.refs, first.payloads, first.chunks)]
    second = S.put(log, *held, cutter)
    none = spark.createDataFrame([], "hash string, listed long")
    return second, S.counted(S.counted(none, first.deltas), second.deltas)


@R.add("sto2_put_again", _puts("""
SELECT m.claim, array_to_string(list(sha256(l.part) ORDER BY l.position), ',') AS chunks, any_value(CAST(octet_length(encode(m.data)) AS BIGINT)) AS size, any_value(m.encoding) AS encoding, any_value(m.encoding = 'json/plain') AS deduped,
 any_value(m.created_at) AS created_at, any_value(m.seen_at) AS last_ref_at FROM held m JOIN listed l USING (claim) GROUP BY 1"""))
def sto2_again(spark, d):
    """Manifests after both puts: known payloads are touched, the others cut."""
    return two_puts(spark, d)[0].payloads.withColumn("chunks", F.array_join("chunks", ","))


@R.add("sto2_cut_by_second_put", _puts("SELECT count(*) AS chunks, count(DISTINCT claim) AS payloads FROM listed WHERE fresh"))
def sto2_cut(spark, d):
    """What the second put had to cut: payloads that the first one had not seen."""
    return two_puts(spark, d)[0].cut.agg(F.count("*").alias("chunks"), F.count_distinct("claim").alias("payloads"))


@R.add("sto4_chunks_after_puts", _puts("SELECT hash, size, CASE WHEN new THEN made ELSE made_early END AS created_at, last_ref_at, listed FROM kept"))
def sto4_chunks(spark, d):
    """Chunks after both puts, touched by every payload that lists them, with their reference counts."""
    second, counts = two_puts(spark, d)
    return second.chunks.drop("data").join(counts, "hash")


@R.add("sto7_counters_of_put", _puts(_TOTALS.format(unique="(SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM kept WHERE new)")))
def sto7_put(spark, d):
    return two_puts(spark, d)[0].counters


@R.add("sto8_dedupe_by_run", _sql("""
SELECT namespace, workflow_id, run_id, payloads, whole_bytes, unique_bytes, round(whole_bytes / nullif(unique_bytes, 0), 3) AS ratio FROM (
 SELECT namespace, workflow_id, run_id, (SELECT count(*) FROM (SELECT DISTINCT claim FROM refs WHERE namespace = r.namespace AND workflow_id = r.workflow_id AND run_id IN (r.run_id, ''))) AS payloads,
  (SELECT CAST(coalesce(sum(octet_length(encode(data))), 0) AS BIGINT) FROM (SELECT DISTINCT claim, data FROM refs JOIN stored USING (claim) WHERE namespace = r.namespace AND workflow_id = r.workflow_id AND run_id IN (r.run_id, ''))) AS whole_bytes,
  (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM (SELECT DISTINCT hash, size FROM refs JOIN chunk USING (claim) WHERE namespace = r.namespace AND workflow_id = r.workflow_id AND run_id IN (r.run_id, ''))) AS unique_bytes
 FROM (SELECT DISTINCT namespace, workflow_id, run_id FROM refs) r)"""))
def sto8(spark, d):
    """Bytes of each run stored whole and as chunks."""
    stats = S.run_bytes(refs(spark, d), payloads(spark, d), chunk_table(spark, d))
    return stats.withColumn("ratio", F.round(F.col("whole_bytes") / F.nullif(F.col("unique_bytes"), F.lit(0)), 3))


@R.add("join4_payload_refs", _sql("SELECT DISTINCT s.claim FROM stored s JOIN refs r USING (claim) WHERE r.run_id IN ('3', '')"))
def join4(spark, d):
    wanted = refs(spark, d).where("run_id IN ('3', '')").select("claim")
    return stored(spark, d).join(wanted, "claim", "left_semi").select("claim")


@R.add("join5_chunk_fetch", _sql("SELECT claim, array_to_string(list(data ORDER BY position), '|') AS data FROM chunk GROUP BY 1"))
def join5(spark, d):
    """Texts through their manifests: lists are exploded, meet the distinct chunks by hash and are joined in order."""
    cut = chunks(spark, d)
    return S.fetch(S.manifests(cut), S.distinct_chunks(cut), "|")


@R.add("agg10_distinct_chunk_bytes", _sql("SELECT count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes FROM uniq"))
def agg10(spark, d):
    return S.distinct_chunks(chunks(spark, d)).agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


@R.add("flt7_externalize", _sql("SELECT id, CAST(octet_length(encode(data)) AS INTEGER) AS bytes FROM payload_log WHERE octet_length(encode(data)) >= 4096"))
def flt7(spark, d):
    return S.externalize(L.payloads(spark, d), 4096).select("id", F.octet_length("data").alias("bytes"))


@R.add("gc1_verdicts", _sql("SELECT * FROM verdicts", True))
def gc1(spark, d):
    return verdicts(spark, d)


@R.add("gc2_expired_refs", _sql("SELECT * FROM gone", True))
def gc2(spark, d):
    return expired(spark, d)


@R.add("gc3_dead_manifests", _sql("SELECT claim FROM deadm", True))
def gc3(spark, d):
    return dead(spark, d).select("claim")


@R.add("gc4_dead_chunks", _sql("SELECT hash, size FROM deadc", True))
def gc4(spark, d):
    return dead_chunks(spark, d).select("hash", "size")


#: Times of three sweeps in a row.
_SWEEPS = tuple({"touched": f"TIMESTAMP '{a}'", "cutoff": f"TIMESTAMP '{b}'", "orphan": f"TIMESTAMP '{c}'"} for a, b, c in (
    ("2024-01-20", "2024-01-12", "2024-01-10"), ("2024-02-01", "2024-01-20", "2024-01-15"), ("2024-02-08", "2024-01-25", "2024-01-20")))


def _three() -> str:
    """Dead chunks as of each time, from the tables as they were: what may go at one time may go at all later ones."""

    def one(number: int, t: dict[str, str]) -> str:
        at = {_TOUCHED: t["touched"], _CUTOFF: t["cutoff"], _ORPHAN: t["orphan"]}
        text = re.sub("|".join(at), lambda m: at[m.group()], f"{_VERDICTS},{_SWEEP}")  # all at once: the times overlap
        return re.sub(r"\b(verdicts|gone|live|deadm|cseen|deadc|ids)\b", rf"\1_{number}", text)

    dead = " UNION ALL ".join(f"SELECT *, {i} AS sweep FROM deadc_{i}" for i in (1, 2, 3))
    return ",".join(one(i, t) for i, t in enumerate(_SWEEPS, 1)) + f"\nSELECT hash, any_value(size) AS size, CAST(min(sweep) AS INTEGER) AS sweep FROM ({dead}) GROUP BY 1"


@R.add("gc4_three_sweeps", sql("payload_log", "states", then="@@").replace("\n@@", f",{_STORE},{_three()}"))
def gc4_sweeps(spark, d):
    """Chunks by the sweep that takes them, by reference counts: each sweep opens the lists of payloads that go."""
    tables, states = [written(refs(spark, d)), written(payloads(spark, d)), written(chunk_table(spark, d))], L.workflow_states(spark, d)
    counts = S.count_deltas(tables[1]).withColumnRenamed("delta", "listed")
    taken = []
    for number, t in enumerate(_SWEEPS, 1):
        left = S.sweep(*tables, states, _at(t["touched"]), _at(t["cutoff"]), _at(t["orphan"]), counts=counts)
        tables, counts = [left.refs, left.payloads, left.chunks], left.counts
        taken.append(left.lost.withColumn("sweep", F.lit(number)))
    return taken[0].unionAll(taken[1]).unionAll(taken[2])


@R.add("gc5_dry_run", _sql("""
SELECT (SELECT count(*) FROM gone WHERE workflow_id <> '') AS refs_expired, (SELECT count(*) FROM gone WHERE workflow_id = '') AS orphan_refs_expired, (SELECT count(*) FROM deadm) AS manifests_deleted,
 (SELECT count(*) FROM deadc) AS chunks_deleted, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM deadc) AS chunk_bytes_deleted""", True))
def gc5(spark, d):
    return swept(spark, d).report


def swept(spark, d):
    """A sweep over tables that are written once."""
    tables = (written(refs(spark, d)), written(payloads(spark, d)), written(chunk_table(spark, d)))
    return S.sweep(*tables, L.workflow_states(spark, d), _at(_TOUCHED), _at(_CUTOFF), _at(_ORPHAN))


@R.add("gc5_sweep", _sql("""
SELECT 'refs' AS what, (SELECT count(*) FROM refs) - (SELECT count(*) FROM gone) AS rows UNION ALL SELECT 'payloads', (SELECT count(*) FROM stored) - (SELECT count(*) FROM deadm)
UNION ALL SELECT 'chunks', (SELECT count(DISTINCT hash) FROM chunk) - (SELECT count(*) FROM deadc)""", True))
def gc5_sweep(spark, d):
    """What a sweep leaves."""
    left = swept(spark, d)
    count = lambda df, what: df.agg(F.count("*").alias("rows")).select(F.lit(what).alias("what"), "rows")
    return count(left.refs, "refs").unionAll(count(left.payloads, "payloads")).unionAll(count(left.chunks, "chunks"))


@R.add("join6_anti_join", _sql("SELECT claim FROM stored WHERE claim NOT IN (SELECT claim FROM refs WHERE namespace = 'default')"))
def join6(spark, d):
    return stored(spark, d).join(refs(spark, d).where("namespace = 'default'"), "claim", "left_anti").select("claim")


@R.add("join7_containment_anti", _sql("SELECT hash FROM uniq WHERE hash NOT IN (SELECT hash FROM chunk c JOIN stored s USING (claim) WHERE s.encoding = 'json/plain')"))
def join7(spark, d):
    plain = stored(spark, d).where("encoding = 'json/plain'").select("claim")
    listed = S.manifests(chunks(spark, d)).join(plain, "claim", "left_semi").select(F.explode("chunks").alias("hash"))
    return S.distinct_chunks(chunks(spark, d)).join(listed, "hash", "left_anti").select("hash")
