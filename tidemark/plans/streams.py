"""Streams over the event table, drained; each must equal its batch form."""

import uuid

from pyspark.sql import functions as F

from tidemark.model import NODE
from tidemark.operators.effects import FOLDED
from tidemark.plans import fencing, spending
from tidemark.plans.prelude import sql
from tidemark.plans.registry import Registry
from tidemark.sources import ledgerize as L
from tidemark.streaming import effects, history, jobs, ledger, observe, retention

R = Registry()
_NODE = "namespace, workflow_id, run_id, seq"


def event_stream(spark, d):
    """The event table as a stream of files."""
    table = L.read(spark, d, "events")
    return jobs.files_stream(spark, f"{d}/events.parquet*", table.schema)


def writes(rows):
    """Every event as a write; schedule times are permuted, so many writes are stale."""
    of = F.col("event_id")
    return rows.select(
        *L.run_key(F.floor(of / 80).cast("bigint")),
        (F.floor(of / 8) % 10).cast("int").alias("seq"),
        of.alias("arrival"),
        F.lit("w").alias("op"),
        (F.col("user_id") % 3 + 1).cast("int").alias("attempt"),
        (of * 7919 % 1000003).alias("fence_us"),
    )


def operations(rows):
    """Writes, commits, abandons and a seal at the end of each run."""
    kind = F.when(F.col("arrival") % 80 == 70, "s").when(F.col("arrival") % 8 == 5, "c").when(F.col("arrival") % 8 == 6, "a").otherwise("w")
    return writes(rows).withColumn("op", kind)


@R.add("str1_stream_fence", f"""
WITH w AS (SELECT 'default' AS namespace, 'wf-' || ((event_id // 80) % 1000) AS workflow_id, CAST(event_id // 80 AS VARCHAR) AS run_id, CAST((event_id // 8) % 10 AS INTEGER) AS seq, event_id AS arrival,
 CAST(user_id % 3 + 1 AS INTEGER) AS attempt, event_id * 7919 % 1000003 AS fence_us FROM events)
SELECT {_NODE}, arrival, attempt, CASE WHEN coalesce((fence_us, attempt) >= max((fence_us, attempt)) OVER (PARTITION BY run_id, seq ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
 THEN 'WROTE' ELSE 'FENCED_OUT' END AS outcome FROM w""")
def str1(spark, d):
    jobs.use_rocksdb(spark)
    return jobs.drain(ledger.fenced(writes(event_stream(spark, d)))).select(*NODE, "arrival", "attempt", "outcome")


@R.add("str3_stream_seal")
def str3(spark, d):
    jobs.use_rocksdb(spark)
    return jobs.drain(ledger.fenced(operations(event_stream(spark, d))))


@R.add("str5_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def str5(spark, d):
    stream = event_stream(spark, d).select("user_id", "event_type")
    return jobs.drain(ledger.first_seen(stream, ["user_id", "event_type"]))


@R.add("str2_stream_observe", fencing.OBSERVED_SQL)
def str2(spark, d):
    """What runs know of their nodes, as keyed state."""
    jobs.use_rocksdb(spark)
    return fencing.listed(jobs.drain(observe.observed(fencing.results(L.history_of(event_stream(spark, d))))))


#: Milliseconds after which a key that nobody touches expires, and for which its expiry is remembered.
RETENTION, GRACE, MEMORY = 24 * 3600_000, "6 hours", 12 * 3600_000


@R.add("str4_stream_expiry", f"""
WITH t AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER w AS before, lead(epoch_us(ts) // 1000) OVER w AS after, max(epoch_us(ts) // 1000) OVER () AS latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, CASE WHEN before IS NULL OR ms > before + {RETENTION + MEMORY} THEN 'FIRST' WHEN ms > before + {RETENTION} THEN 'AFTER_EXPIRY' ELSE 'TOUCHED' END AS what, ms AS at_ms FROM t
UNION ALL SELECT user_id, 'EXPIRED', ms + {RETENTION} FROM t WHERE after > ms + {RETENTION} OR after IS NULL AND ms + {RETENTION} < latest - 6 * 3600000""")
def str4(spark, d):
    """Users who are not seen for a day expire; who comes back within the next half day is known to be late."""
    jobs.use_rocksdb(spark)
    touches = event_stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("seen_at"))
    return jobs.drain(retention.retained(touches, ["user_id"], RETENTION, GRACE, MEMORY))


@R.add("eff1_stream", spending.REPLAYED_SQL)
def eff1_stream(spark, d):
    """The effect log as a stream."""
    jobs.use_rocksdb(spark)
    log = L.effect_log(jobs.files_stream(spark, f"{d}/orders.parquet*", L.read(spark, d, "orders").schema))
    return jobs.drain(effects.replayed(log)).select(*(part.split()[0] for part in FOLDED.split(", ")))


@R.add("src2_stream_history", sql("hist", then="SELECT * FROM hist"))
def src2_stream(spark, d):
    """Histories tailed as a stream, nodes kept in a snapshot: the rows of ``his1_project``."""
    path = f"{jobs.shared_dir(spark)}/{spark.sparkContext.applicationId}/history-{uuid.uuid4().hex}"
    return history.project_stream(L.history_of(event_stream(spark, d)), f"{path}/nodes", f"{path}/checkpoint")
