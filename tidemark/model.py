"""Ledger relations: schemas, allowed values, keys, and a check that rows keep them.

Spark enforces neither primary keys nor CHECK constraints, so ``violations`` reports rows that break them. Tables are
immutable: an update is a new snapshot made from an operation log and the snapshot before.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = "1"

#: A run, and a node execution of a run.
RUN = ["namespace", "workflow_id", "run_id"]
NODE = [*RUN, "seq"]
FENCE = ["fence_scheduled_at", "attempt"]

RUN_STATUS = ("RUNNING", "COMPLETED", "FAILED", "CANCELLED", "TERMINATED", "TIMED_OUT", "CONTINUED_AS_NEW", "UNKNOWN")
TERMINAL = tuple(s for s in RUN_STATUS if s not in ("RUNNING", "UNKNOWN"))
NODE_STATUS = ("PROVISIONAL", "COMMITTED", "ABANDONED")
NODE_KIND = ("UPDATE", "COMMAND", "INTERRUPT")
OUTCOME = ("WROTE", "FENCED_OUT", "DB_ERROR", "DIVERGENCE_REPAIRED")
EFFECT_STATUS = ("STARTED", "DONE", "UNKNOWN", "RESOLVED")
SEALED_BY = ("seal", "reconcile")

_RUN_KEY = "namespace string, workflow_id string, run_id string"


@dataclass(frozen=True)
class Relation:
    ddl: str
    key: tuple[str, ...]
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


RELATIONS = {
    "meta": Relation("key string, value string", ("key",)),
    "runs": Relation(
        f"{_RUN_KEY}, workflow_type string, status string, node_count int, committed_count int, abandoned_count int, "
        "final_state_hash string, first_seen_at timestamp, sealed_at timestamp, sealed_by string, degraded boolean, missing_seqs array<int>",
        tuple(RUN),
        {"status": RUN_STATUS, "sealed_by": SEALED_BY},
    ),
    "nodes": Relation(
        f"{_RUN_KEY}, seq int, activity_id string, activity_type string, graph string, node string, lg_step int, lg_path string, "
        "lg_task_id string, checkpoint_ns string, attempt int, fence_scheduled_at timestamp, status string, kind string, output_json string, "
        "output_bytes binary, output_encoding string, output_hash string, input_snapshot string, input_hash string, input_bytes int, tokens_in int, "
        "tokens_out int, cost_usd decimal(14,6), started_at timestamp, finished_at timestamp, committed_at timestamp",
        tuple(NODE),
        {"status": NODE_STATUS, "kind": NODE_KIND},
    ),
    "attempts": Relation(
        f"id bigint, {_RUN_KEY}, seq int, attempt int, fence_scheduled_at timestamp, output_hash string, outcome string, tokens_in int, "
        "tokens_out int, cost_usd decimal(14,6), write_ms float, worker string, note string, at timestamp, worker_time timestamp",
        ("id",),
        {"outcome": OUTCOME},
    ),
    "effects": Relation(
        f"key string, {_RUN_KEY}, seq int, name string, idx int, request_hash string, status string, result string, started_at timestamp, "
        "done_at timestamp, attempts int, duplicates_prevented int, resolution string",
        ("key",),
        {"status": EFFECT_STATUS},
    ),
    "llm_calls": Relation(
        f"key string, request_hash string, response string, {_RUN_KEY}, seq int, call_idx int, tokens_in int, tokens_out int, "
        "cost_usd decimal(14,6), first_attempt int, replays int, created_at timestamp",
        ("key",),
    ),
    "chunks": Relation("hash binary, data binary, size int, created_at timestamp, last_ref_at timestamp", ("hash",)),
    "payloads": Relation(
        "claim string, chunks array<binary>, size bigint, encoding string, deduped boolean, created_at timestamp, last_ref_at timestamp", ("claim",)
    ),
    "payload_refs": Relation(
        f"claim string, {_RUN_KEY}, target_kind string, created_at timestamp, last_ref_at timestamp", ("claim", *RUN)
    ),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A relation without rows."""
    return spark.createDataFrame([], RELATIONS[name].schema)


def init_views(spark: SparkSession, prefix: str = "ledger_") -> list[str]:
    """Temporary views of all relations, empty but for the schema version; running it again changes nothing else."""
    for name in RELATIONS:
        rows = spark.range(1).selectExpr("'schema_version' AS key", f"'{SCHEMA_VERSION}' AS value") if name == "meta" else empty(spark, name)
        rows.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in RELATIONS]


def violations(df: DataFrame, name: str) -> DataFrame:
    """``rule, column, value, rows`` for every broken rule of a relation: null or repeated keys, values not allowed.

    One aggregate over the key and one over the checked columns; rows are counted, never listed.
    """
    relation = RELATIONS[name]
    keys = [c for c in relation.key if c in df.columns]
    shown = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in keys))
    repeated = (
        df.groupBy(*keys).count().where("count > 1").select(F.lit("unique").alias("rule"), F.lit(",".join(keys)).alias("column"), shown.alias("value"), F.col("count").alias("rows"))
    )
    parts = [repeated]
    for c in keys:
        missing = df.where(F.col(c).isNull()).groupBy().count().where("count > 0")
        parts.append(missing.select(F.lit("not null").alias("rule"), F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), F.col("count").alias("rows")))
    for c, values in relation.allowed.items():
        if c in df.columns:
            odd = df.where(F.col(c).isNotNull() & ~F.col(c).isin(*values)).groupBy(c).count()
            parts.append(odd.select(F.lit("check").alias("rule"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col("count").alias("rows")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
