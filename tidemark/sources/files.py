"""Readers of histories, results and logs, and the sinks of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import RUN

HISTORY = (
    "events ARRAY<STRUCT<eventId: STRING, eventTime: STRING, eventType: STRING, "
    "workflowExecutionStartedEventAttributes: STRUCT<workflowId: STRING, workflowType: STRUCT<name: STRING>>, "
    "activityTaskScheduledEventAttributes: STRUCT<activityId: STRING, activityType: STRUCT<name: STRING>, "
    "header: STRUCT<fields: MAP<STRING, STRUCT<metadata: MAP<STRING,STRING>, data: STRING>>>>, "
    + ", ".join(
        f"activityTask{k}EventAttributes: STRUCT<scheduledEventId: STRING, attempt: INT, result: STRUCT<payloads: ARRAY<STRUCT<metadata: MAP<STRING,STRING>, data: STRING>>>>"
        for k in ("Started", "Completed", "Failed", "TimedOut", "CancelRequested", "Canceled")
    )
    + ">>"
)
_KINDS = {
    "EVENT_TYPE_ACTIVITY_TASK_SCHEDULED": "SCHEDULED", "EVENT_TYPE_ACTIVITY_TASK_STARTED": "STARTED", "EVENT_TYPE_ACTIVITY_TASK_COMPLETED": "COMPLETED",
    "EVENT_TYPE_ACTIVITY_TASK_FAILED": "FAILED", "EVENT_TYPE_ACTIVITY_TASK_TIMED_OUT": "TIMED_OUT", "EVENT_TYPE_ACTIVITY_TASK_CANCEL_REQUESTED": "CANCEL_REQUESTED",
    "EVENT_TYPE_ACTIVITY_TASK_CANCELED": "CANCELED",
}


def history_json(spark: SparkSession, path: str) -> DataFrame:
    """Events of recorded histories (one JSON file each): ``workflow_id`` of the first event, or else the file's name,
    ``event_id``, ``event_time``, ``event_type``, ``scheduled_event_id``, ``attempt``, ``activity_type``, ``headers``,
    ``result``. Base64 is decoded."""
    return history_events(spark.read.schema(HISTORY).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name")))


def history_events(files: DataFrame) -> DataFrame:
    """The same out of documents in columns ``events`` and ``file``."""
    first = F.col("events")[0]["workflowExecutionStartedEventAttributes"]["workflowId"]
    each = files.select(F.coalesce(first, F.regexp_replace("file", r"\.json$", "")).alias("workflow_id"), "file", F.explode("events").alias("e"))
    e = F.col("e")
    kinds = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    parts = [e[f"activityTask{k}EventAttributes"] for k in ("Started", "Completed", "Failed", "TimedOut", "CancelRequested", "Canceled")]
    kind = F.try_element_at(kinds, e["eventType"])
    of = F.coalesce(*(p["scheduledEventId"] for p in parts), F.when(kind == "SCHEDULED", e["eventId"]))
    scheduled = e["activityTaskScheduledEventAttributes"]
    decoded = F.transform_values(scheduled["header"]["fields"], lambda _, v: F.decode(F.unbase64(v["data"]), "UTF-8"))
    return each.select(
        "workflow_id",
        "file",
        e["eventId"].cast("bigint").alias("event_id"),
        F.to_timestamp(e["eventTime"]).alias("event_time"),
        F.coalesce(kind, e["eventType"]).alias("event_type"),
        of.cast("bigint").alias("scheduled_event_id"),
        parts[0]["attempt"].alias("attempt"),
        scheduled["activityType"]["name"].alias("activity_type"),
        decoded.alias("headers"),
        F.decode(F.unbase64(parts[1]["result"]["payloads"][0]["data"]), "UTF-8").alias("result"),
    )


def results_json(spark: SparkSession, path: str) -> DataFrame:
    """Result files: whole JSON documents."""
    return spark.read.option("multiLine", True).json(path)


def fault_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; blank lines are skipped, lines whose fields are all null are not."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("line")).select("line.*")


def tail_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same log as a stream of the files that come into a folder."""
    lines = spark.readStream.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("line")).select("line.*")


def run_nodes(nodes: DataFrame, workflow_id: str, run_id: str) -> DataFrame:
    """The rows of one run; both conditions reach the scan."""
    return nodes.where((F.col("workflow_id") == workflow_id) & (F.col("run_id") == run_id))


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Rows that match every condition that is not None."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


# --- sinks ----------------------------------------------------------------------------------------------------------


def append(rows: DataFrame, path: str) -> None:
    """Append to an operation log."""
    rows.write.mode("append").parquet(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Replace a snapshot; a reader of the old one must have finished."""
    rows.write.mode("overwrite").parquet(path)


def write_final_states(states: DataFrame, path: str) -> None:
    """One row for each run."""
    states.dropDuplicates(RUN).write.mode("append").parquet(path)


def write_chunks(chunks: DataFrame, manifests: DataFrame, refs: DataFrame, path: str) -> None:
    """A chunk store as files: chunks in folders by the first two digits of their hash, manifests, references. Rows
    of a prefix are brought together first, so a folder gets few files."""
    prefix: Column = F.left(F.col("hash").cast("string") if dict(chunks.dtypes)["hash"] == "string" else F.lower(F.hex("hash")), F.lit(2))
    chunks.withColumn("prefix", prefix).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{path}/chunks")
    manifests.write.mode("append").parquet(f"{path}/manifests")
    refs.write.mode("append").parquet(f"{path}/refs")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, manifests, references) of a store of files. Chunks are read without their folder; a condition on
    ``prefix`` would prune folders."""
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/manifests"), spark.read.parquet(f"{path}/refs")


def write_results(rows: DataFrame, path: str, command: str, environment: dict[str, str]) -> None:
    """Results with the command and environment that made them."""
    env = F.create_map(*(F.lit(x) for pair in sorted(environment.items()) for x in pair)) if environment else F.expr("cast(map() as map<string,string>)")
    rows.withColumn("command", F.lit(command)).withColumn("environment", env).write.mode("overwrite").json(path)


def reset_store(spark: SparkSession, path: str, tables: dict[str, str]) -> None:
    """Empty the tables of a store: name to schema."""
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")
