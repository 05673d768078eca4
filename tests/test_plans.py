"""Plans that must stay cheap: exchanges counted in the plan, all joins by shuffle."""

import re

import pytest

from tidemark.plans import repair


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (?:hash|range|Single|Round)", plan))


@pytest.fixture
def shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name,most", [("rec3_full_rows", 6), ("rec1_report", 6), ("rec1_run_states", 6), ("rec1_decide", 7), ("rec1_second_pass", 12)])
def test_reconcile_plans(shuffled, data, name, most):
    assert exchanges(repair.R.queries[name](shuffled, data)) <= most


def test_one_run_with_most_rows_is_spread(spark):
    """Nodes are dealt by node, and counts of a run are summed in parts: no task holds a run."""
    from pyspark.sql import functions as F

    from tidemark.operators import reconcile

    key = [F.lit("n").alias("namespace"), F.lit("w").alias("workflow_id"), F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("run_id"), F.col("id").cast("int").alias("seq")]
    hist = spark.range(1000).select(*key, F.lit("COMPLETED").alias("status"), F.lit(False).alias("cancel_requested"), F.lit(True).alias("accepted"), F.lit("h").alias("result_hash"), F.lit(1).alias("attempt"))
    rows = spark.range(500).select(*key, F.lit("PROVISIONAL").alias("status"), F.lit("h").alias("output_hash"), F.lit(1).alias("attempt"))
    facts = reconcile.node_facts(hist, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    sizes = [r[0] for r in facts.groupBy(F.spark_partition_id()).count().select("count").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 1000 and max(sizes) < 900
    runs = hist.select("namespace", "workflow_id", "run_id").distinct().selectExpr("*", "'COMPLETED' AS status", "true AS found", "true AS closed", "false AS sealed", "false AS degraded")
    done = reconcile.reconcile(hist.withColumn("started_at", F.lit(None).cast("timestamp")), rows, runs)
    hot = done.report.where("run_id = 'hot'").first()
    assert (hot.action, hot.inserted, hot.committed, hot.abandoned) == ("sealed", 400, 500, 0)
    seal = done.seals.where("run_id = 'hot'").first()
    assert (seal.node_count, seal.committed_count, seal.degraded) == (900, 900, False)
    assert done.rows.where("status = 'COMMITTED'").count() == 1000


def test_later_scheduling_of_a_node_counts(spark):
    from tidemark.operators import reconcile

    hist = spark.createDataFrame(
        [("n", "w", "r", 0, 5, "FAILED", False, False, None, 1), ("n", "w", "r", 0, 9, "COMPLETED", False, True, "h", 2)],
        "namespace string, workflow_id string, run_id string, seq int, scheduled_event_id long, status string, cancel_requested boolean, accepted boolean, result_hash string, attempt int",
    )
    rows = spark.createDataFrame([], "namespace string, workflow_id string, run_id string, seq int, status string, output_hash string, attempt int")
    fact = reconcile.node_facts(hist, rows).first()
    assert fact.h.attempt == 2 and fact.r is None
