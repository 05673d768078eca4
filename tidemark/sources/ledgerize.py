"""Ledger relations out of plain tables (orders, line items, events, conversations, documents).

The mapping is deterministic, so that the same rows can be made by any SQL engine: an order is a run, a line of an
order a node execution, lines that share order and number the attempts of one node. Each function reads only the
columns it names, so scans stay narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.model import NODE, RUN

#: Workflows that runs are dealt to.
WORKFLOWS = 1000
#: Characters of a fixed-size chunk, and the base of made-up times.
CHUNK = 512
EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_key(order: Column) -> list[Column]:
    return [
        F.lit("default").alias("namespace"),
        F.concat(F.lit("wf-"), (order % WORKFLOWS).cast("string")).alias("workflow_id"),
        order.cast("string").alias("run_id"),
    ]


def plus_micros(ts: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros.cast("bigint"), ts)


def dealt(rows: DataFrame, order: str) -> DataFrame:
    """Rows of a table dealt by the run that their order is. Done before keys and other texts are made of them, numbers
    go through the shuffle; what is grouped or joined by run or node afterwards, with others so dealt, stays in place."""
    return rows.repartition(*run_key(F.col(order))[1:])  # the namespace is the same in all


def attempts(spark: SparkSession, sf_dir: str, by_run: bool = False, **more: Column) -> DataFrame:
    """Write attempts in order of arrival, with what each attempt knows of its node.

    The windows are by the node's key, as everything that follows, so one shuffle serves them all; it is by run, see
    ``dealt``, if ``by_run`` is set. ``more``: further columns, of the line's numbers.
    """
    code = F.when(F.col("l_linestatus") == "F", 1).when(F.col("l_returnflag") == "R", 2).cast("byte")
    numbers = {
        "_code": code, "_percent": F.round(F.col("l_discount") * 100).cast("bigint"), "_tokens": F.col("l_quantity").cast("int"), "_seconds": F.col("l_quantity").cast("bigint"),
    }
    line = read(spark, sf_dir, "lineitem").withColumns(numbers)
    line = (dealt(line, "l_orderkey") if by_run else line).select("*", *run_key(F.col("l_orderkey")), (F.col("l_linenumber") - 1).cast("int").alias("seq"))
    group = Window.partitionBy(*NODE)
    micro = F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.col("_percent") * 100
    cost = F.when(F.col("l_suppkey") % 10 != 0, (micro.cast("decimal(20,6)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(14,6)"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    node = F.concat(F.lit("n"), (supp % 7).cast("string"))
    finished = plus_micros(F.col("l_shipdate"), F.col("_seconds") * 1234500)
    status = F.when(F.col("_code") == 1, "commit").when(F.col("_code") == 2, "abandon")
    return line.select(
        *NODE,
        F.row_number().over(group.orderBy("l_partkey", "l_suppkey", "l_extendedprice")).alias("attempt"),
        F.col("l_shipdate").alias("fence_scheduled_at"),
        F.row_number().over(group.orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey")).alias("arrival"),
        F.when(part % 17 != 0, F.col("_tokens")).alias("tokens_in"),
        (part % 100).cast("int").alias("tokens_out"),
        cost.alias("cost_usd"),
        F.sha2(F.concat_ws(":", (part % 10).cast("string"), (supp % 2).cast("string")), 256).alias("output_hash"),
        plus_micros(F.col("l_shipdate"), (supp * 37 % 600 - 300) * 1000000).alias("worker_time"),
        F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("activity_id"),
        F.when(part % 11 == 0, node).otherwise(F.concat(F.lit("g"), (part % 5).cast("string"), F.lit(".sub."), node)).alias("activity_type"),
        node.alias("node"),
        F.when(part % 13 != 0, F.col("l_linenumber").cast("int")).alias("lg_step"),
        F.concat(F.lit("~"), F.lpad((part % 3).cast("string"), 10, "0")).alias("lg_path"),
        F.concat(
            F.lit('{"result":{"v":'), (part % 10).cast("string"), F.lit('},"langgraph_command":'), F.when(part % 7 == 0, '{"update":1}').otherwise("null"),
            F.lit(',"langgraph_interrupts":'), F.when(part % 5 == 0, "[1]").otherwise("null"), F.lit("}"),
        ).alias("output_json"),
        (part % 4000).cast("int").alias("input_bytes"),
        F.col("l_shipdate").alias("started_at"),
        finished.alias("finished_at"),
        plus_micros(finished, supp * 1000 + 500).alias("commit_at"),
        status.alias("op"),
        *(column.alias(name) for name, column in more.items()),
    )


def runs(spark: SparkSession, sf_dir: str, by_run: bool = False) -> DataFrame:
    """Runs with the numbers that a seal request carries; running ones have none. ``by_run``: see ``dealt``."""
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("RUNNING")
    order = read(spark, sf_dir, "orders")
    return (dealt(order, "o_orderkey") if by_run else order).select(
        *run_key(F.col("o_orderkey")),
        F.col("o_orderpriority").alias("workflow_type"),
        status.alias("status"),
        F.col("o_orderdate").alias("first_seen_at"),
        (F.col("o_custkey") % 8).cast("int").alias("node_count"),
        (F.col("o_custkey") % 4).cast("int").alias("accepted_count"),
    )


def sealed_runs(spark: SparkSession, sf_dir: str, by_run: bool = False) -> DataFrame:
    """Runs with what a seal leaves: who sealed them and when, counts, whether they are degraded and what is missing."""
    n = F.col("run_id").cast("bigint")
    by = F.when(n % 4 == 1, "reconcile").when(n % 4 != 0, "seal")
    degraded = F.coalesce((n % 6 == 1) & by.isNotNull(), F.lit(False))
    return runs(spark, sf_dir, by_run).drop("accepted_count", "node_count").withColumns({
        "sealed_by": by, "sealed_at": F.when(by.isNotNull(), F.col("first_seen_at")), "degraded": degraded,
        "missing_seqs": F.when(degraded & (n % 5 != 0), F.array((n % 3).cast("int"), (n % 3 + 2).cast("int"))),
        "node_count": F.when(by.isNotNull(), (n % 9).cast("int")), "committed_count": F.when(by.isNotNull(), (n % 7).cast("int")), "abandoned_count": F.when(by.isNotNull(), (n % 2).cast("int")),
    })


def prevented() -> Column:
    """Duplicates that a line's effect prevented."""
    return (F.col("l_partkey") % 3).cast("int")


def run_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing effects of runs, one for each line of an order."""
    line = read(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("send-"), F.lower("l_returnflag"))
    text = lambda c: F.col(c).cast("string")
    return line.select(
        *run_key(F.col("l_orderkey")), (F.col("l_linenumber") - 1).cast("int").alias("seq"), name.alias("name"),
        F.sha2(F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).cast("binary"), 256).alias("key"),
        F.when(F.col("l_linestatus") == "F", "DONE").otherwise("STARTED").alias("status"), prevented().alias("duplicates_prevented"),
    )


def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log: eight events to a node, ten nodes to a run."""
    return history_of(read(spark, sf_dir, "events"))


def history_of(event: DataFrame) -> DataFrame:
    """The event log of rows, or of a stream, of the event table."""
    of = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "view", "SCHEDULED").when(F.col("event_type") == "click", "STARTED").when(F.col("event_type") == "purchase", "COMPLETED")
        .when(F.col("event_type") == "error", "FAILED").otherwise("CANCEL_REQUESTED")
    )
    run = F.floor(of / 80).cast("bigint")
    return event.select(
        *run_key(run),
        (F.floor(of / 8) % 10).cast("int").alias("seq"),
        F.floor(of / 8).cast("bigint").alias("scheduled_event_id"),
        of.alias("event_id"),
        F.col("ts").alias("event_time"),
        kind.alias("event_type"),
        (F.col("user_id") % 3 + 1).cast("int").alias("attempt"),
        F.sha2((F.col("user_id") % 5).cast("string"), 256).alias("result_hash"),
        F.round(F.col("value") * 100).cast("bigint").alias("size"),
    )


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows to hold against the event log: some missing, some tampered with, some never scheduled."""
    node = history_events(spark, sf_dir).groupBy(*NODE, "scheduled_event_id").agg(F.max_by("result_hash", "event_id").alias("result_hash"))
    of = F.col("scheduled_event_id")
    status = F.when(of % 3 == 0, "PROVISIONAL").when(of % 3 == 1, "COMMITTED").otherwise("ABANDONED")
    hashes = F.when(of % 11 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("result_hash"))
    seq = F.when(of % 17 == 0, F.col("seq") + 100).otherwise(F.col("seq")).cast("int")
    return node.where(of % 5 != 0).select(*RUN, seq.alias("seq"), status.alias("status"), hashes.alias("output_hash"), (of % 4 + 1).cast("int").alias("attempt"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State deltas of conversations: a turn is a step, the role its path."""
    talk = read(spark, sf_dir, "conversations")
    return talk.select(
        *run_key(F.col("conv_id")),
        F.col("turn").cast("int").alias("seq"),
        F.col("turn").cast("int").alias("step"),
        F.col("role").alias("path"),
        F.length("text").alias("size"),
        F.sha2("text", 256).alias("item"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads: texts, with the workflow and run that store them and when."""
    doc = F.col("doc_id")
    at = F.lit(EPOCH).cast("timestamp_ntz")
    return read(spark, sf_dir, "documents").select(
        doc.alias("id"),
        F.coalesce("text", F.lit("")).alias("data"),
        F.when(doc % 29 == 0, "other").otherwise("default").alias("namespace"),
        F.when(doc % 13 == 0, "").otherwise(F.coalesce("source", F.lit(""))).alias("workflow_id"),
        F.when(doc % 13 == 0, "").otherwise((doc % 5).cast("string")).alias("run_id"),
        F.when(doc % 7 == 0, "binary/encrypted").otherwise("json/plain").alias("encoding"),
        plus_micros(at, doc % 1000 * 3600000000).alias("created_at"),
        plus_micros(at, (doc % 1000 + doc % 100) * 3600000000).alias("last_ref_at"),
    )


def workflow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the workflow service says about each workflow id: status and when it closed; some are not known."""
    ids = payloads(spark, sf_dir).where("workflow_id <> ''").select("workflow_id").distinct()
    n = F.regexp_replace("workflow_id", "[^0-9]", "").cast("bigint")
    known = ids.where(F.coalesce(n % 5 != 4, F.lit(True)))
    number = F.coalesce(n, F.lit(0))
    return known.select(
        "workflow_id",
        F.when(number % 3 == 0, "RUNNING").otherwise("COMPLETED").alias("status"),
        F.when(number % 3 != 0, plus_micros(F.lit(EPOCH).cast("timestamp_ntz"), number * 86400000000)).alias("close_time"),
        (number == 7).alias("is_schedule_action"),
    )


def effect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effect log: calls, records, crashes and resolutions, in order of arrival."""
    return effect_log(read(spark, sf_dir, "orders"))


def effect_log(orders: DataFrame) -> DataFrame:
    """The effect log of rows, or of a stream, of the order table."""
    order = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("call", "done", "call", "crash", "resolve-not-done", "call", "resolve-done")))
    key = [
        F.lit("default").alias("namespace"),
        F.concat(F.lit("wf-"), (F.col("o_custkey") % 20).cast("string")).alias("workflow_id"),
        (F.col("o_custkey") % 50).cast("string").alias("run_id"),
        (F.col("o_custkey") % 3).cast("int").alias("seq"),
        F.col("o_orderpriority").alias("name"),
    ]
    return orders.select(
        *key,
        F.lit(0).alias("idx"),
        order.alias("arrival"),
        F.element_at(kinds, (order % 7 + 1).cast("int")).alias("event"),
        F.sha2(F.concat(F.col("o_orderpriority"), F.when(order % 19 == 0, "x").otherwise("")), 256).alias("request_hash"),
        F.concat(F.lit('{"id":'), order.cast("string"), F.lit("}")).alias("result"),
    )


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed model calls: one for each attempt, by a model named after the part."""
    part = F.col("l_partkey")
    line = read(spark, sf_dir, "lineitem").select("*", *run_key(F.col("l_orderkey")), (F.col("l_linenumber") - 1).cast("int").alias("seq"))
    group = Window.partitionBy(*NODE).orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    model = F.element_at(F.array(*map(F.lit, ("gpt-4o", "gpt-4o-mini", "gpt-4o-mini-2024", "claude-3", "local"))), (part % 5 + 1).cast("int"))
    return line.select(
        *NODE,
        F.row_number().over(group).alias("attempt"),
        F.lit(0).alias("call_idx"),
        model.alias("model"),
        F.col("l_quantity").cast("bigint").alias("tokens_in"),
        (part % 100).cast("bigint").alias("tokens_out"),
        F.sha2((part % 3).cast("string"), 256).alias("request_hash"),
    )


#: Prices per million tokens by model prefix.
PRICES = (("gpt-4o", "2.50", "10.00"), ("gpt-4o-mini", "0.15", "0.60"), ("claude-3", "3.00", "15.00"))


def prices(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(p).alias("prefix"), F.lit(i).cast("decimal(10,4)").alias("price_in"), F.lit(o).cast("decimal(10,4)").alias("price_out")) for p, i, o in PRICES]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
