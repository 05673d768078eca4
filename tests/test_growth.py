"""Running sums by blocks against one pass over each run."""

import random

from pyspark.sql import functions as F

from tidemark.operators import growth as G

SCHEMA = "namespace string, workflow_id string, run_id string, event_id long, event_type string, size long"


def model(rows):
    out, runs = {}, {}
    for row in sorted(rows, key=lambda r: (r[2], r[3])):
        total, nodes = runs.get(row[2], (None, 0))
        total = total if row[5] is None else (total or 0) + row[5]
        out[row[2], row[3]] = (total, nodes)
        runs[row[2]] = (total, nodes + (row[4] == "SCHEDULED"))
    return out


def rows_of(seed, runs=5, most=60):
    rng = random.Random(seed)
    return [
        ("n", "w", f"r{r}", i, rng.choice(["SCHEDULED", "STARTED", "COMPLETED"]), rng.choice([None, 0, rng.randrange(100)]))
        for r in range(runs)
        for i in rng.sample(range(-20, 200), rng.randrange(1, most))
    ]


def test_blocks_give_the_sums_of_whole_runs(spark):
    rows = rows_of(1)
    events, expected = spark.createDataFrame(rows, SCHEMA), model(rows)
    for block in (1, 7, 1000):
        found = {(r.run_id, r.event_id): (r.history_bytes, r.nodes_before) for r in G.running_bytes(events, block).collect()}
        assert found == expected


def test_first_event_over_the_limit(spark):
    rows = rows_of(2)
    events, sums = spark.createDataFrame(rows, SCHEMA), model(rows)
    for limit in (0, 150, 700, 10**6):
        expected = {}
        for (run, event), (total, nodes) in sorted(sums.items()):
            if (total or 0) > limit:
                expected.setdefault(run, (event, nodes))
        for block in (1, 16, 1000):
            assert {r.run_id: (r.event_id, r.nodes) for r in G.limit_crossed(events, limit, block).collect()} == expected


def test_empty_and_events_without_id(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert G.running_bytes(empty).count() == 0 and G.limit_crossed(empty, 1).count() == 0
    rows = [("n", "w", "r", None, "SCHEDULED", 5), ("n", "w", "r", 1, "STARTED", 6)]
    found = {r.event_id: (r.history_bytes, r.nodes_before) for r in G.running_bytes(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert found == {None: (5, 0), 1: (11, 1)}


def test_one_long_run_is_spread(spark):
    """The window inside blocks is keyed by block, so a run with most events lies in several partitions."""
    run = F.when(F.col("id") < 9000, "hot").otherwise(F.col("id").cast("string"))
    events = spark.range(12000).select(F.lit("n").alias("namespace"), F.lit("w").alias("workflow_id"), run.alias("run_id"), F.col("id").alias("event_id"), F.lit("SCHEDULED").alias("event_type"), F.lit(1).alias("size"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = G.running_bytes(events, 100).where("run_id = 'hot'")
        sizes = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 9000 and max(sizes) < 4500
    assert hot.agg(F.max("history_bytes")).first()[0] == 9000
