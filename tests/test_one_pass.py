"""Run ledgers and summaries out of one pass over the log: one shuffle a table, and the rows of the joined forms."""

import pytest
from pyspark.sql import functions as F

from tests.support import assert_same
from tests.test_plans import exchanges, shuffled  # noqa: F401
from tidemark.model import NODE, RUN
from tidemark.operators import fence, views
from tidemark.plans import reading


@pytest.mark.parametrize("name,most", [("rd1_run_ledger", 1), ("vw3_run_summary", 2), ("vw3_run_summary_effects", 2)])
def test_each_table_is_shuffled_once(shuffled, data, name, most):  # noqa: F811
    assert exchanges(reading.R.queries[name](shuffled, data)) <= most


@pytest.fixture(scope="module")
def log(spark):
    """Attempts of 300 nodes in 40 runs, with nulls, numbers that repeat and attempts that no writer classified."""
    some = lambda n, seed: F.abs(F.hash("id", F.lit(seed))) % n
    tried = spark.range(900).select(
        F.lit("n").alias("namespace"), F.concat(F.lit("w"), (F.col("id") % 300 % 7).cast("string")).alias("workflow_id"), (F.col("id") % 300 % 40).cast("string").alias("run_id"), (F.col("id") % 300).cast("int").alias("seq"),
        F.col("id").alias("arrival"), F.timestamp_seconds(some(3, 1)).alias("fence_scheduled_at"), (some(3, 2) + F.col("id") / 300 * 10).cast("int").alias("attempt"),
        F.when(some(5, 3) > 0, some(50, 4)).alias("tokens_in"), F.when(some(5, 5) > 0, some(50, 6)).alias("tokens_out"), F.when(some(4, 7) > 0, some(99, 8).cast("decimal(14,6)")).alias("cost_usd"),
        F.when(some(9, 9) > 0, F.sha2(some(2, 10).cast("string"), 256)).alias("output_hash"), F.when(some(6, 11) > 0, F.concat(F.lit("n"), some(3, 12).cast("string"))).alias("node"), F.when(some(6, 13) > 0, some(9, 14)).alias("lg_step"),
        F.element_at(F.array(*map(F.lit, ("COMMITTED", "PROVISIONAL", "ABANDONED"))), some(3, 15) + 1).alias("status"), F.when(some(3, 16) > 0, "late").alias("note"), some(3, 17).alias("duplicates_prevented"),
    )
    odd = F.when(F.hash("arrival", F.lit(18)) % 11 == 0, "DIVERGENCE_REPAIRED").when(F.hash("arrival", F.lit(19)) % 13 == 0, "DB_ERROR")
    return fence.classify(tried).withColumn("outcome", F.coalesce(odd, "outcome")).localCheckpoint()


KEPT = ["fence_scheduled_at", "attempt", "status", "tokens_in", "tokens_out", "cost_usd", "output_hash", "node", "lg_step"]


def test_lines_of_the_log_are_those_of_the_joins(log):
    nodes = fence.snapshot(log, KEPT)
    got, want = views.log_lines(fence.with_row(log, KEPT)).toPandas(), views.node_lines(log, nodes).toPandas()
    assert_same(got, want)
    assert len(got) == 300 and all(got.note.str.contains(word).any() for word in ("overwritten", "fenced out", "reconcile: ", "late", "; "))


@pytest.mark.parametrize("effects", [True, False])
def test_summary_of_the_log_is_that_of_the_joins(spark, log, effects):
    runs = log.select(*RUN).where("run_id % 5 > 0").distinct().unionByName(spark.createDataFrame([("n", "w", "none")], "namespace string, workflow_id string, run_id string"))
    tried = log if effects else log.drop("duplicates_prevented")
    got = views.log_summary(runs, fence.with_row(tried, KEPT))
    nodes = fence.snapshot(log, KEPT)
    want = views.run_summary(runs, nodes, views.retry_waste(log, nodes), log.select(*NODE, "duplicates_prevented"))
    if not effects:
        want = want.drop("effects", "duplicate_effects_prevented")
    assert got.columns == want.columns
    assert_same(got.toPandas(), want.toPandas())
    assert got.where("retry_waste_tokens > 0").count() > 10 and got.where("rows = 0").count() == 1
