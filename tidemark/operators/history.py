"""Event histories: one row for each scheduled node, and which results count as accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import NODE, RUN

TERMINAL_EVENTS = ("COMPLETED", "FAILED", "TIMED_OUT", "CANCELED")


def project(events: DataFrame) -> DataFrame:
    """Nodes of an event log: ``status``, ``attempt``, ``started_at``, ``cancel_requested``, ``result_hash``.

    A SCHEDULED event opens a node; what refers to it counts from then on. STARTED sets attempt and time, a cancel
    request counts while nothing terminal has happened, of terminal events the last one stands. The opening is a window
    over the node's key and the rest an aggregate by the same key, so the log is shuffled once.
    """
    key = [*NODE, "scheduled_event_id"]
    opened = F.min(F.when(F.col("event_type") == "SCHEDULED", F.col("event_id"))).over(Window.partitionBy(*key))
    after = events.withColumn("_opened", opened).where("event_id >= _opened")
    kind, at = F.col("event_type"), F.col("event_id")
    is_end = kind.isin(*TERMINAL_EVENTS)
    when = lambda test, value: F.when(test, value)
    last = lambda test, value: F.max_by(when(test, value), when(test, at))
    cancel = F.min(when(kind == "CANCEL_REQUESTED", at))
    end = F.min(when(is_end, at))
    return after.groupBy(*key).agg(
        last(kind == "STARTED", F.col("attempt")).alias("attempt"),
        F.max(when(kind == "STARTED", F.col("event_time"))).alias("started_at"),
        F.coalesce(last(is_end, kind), F.lit("SCHEDULED")).alias("status"),
        F.coalesce(cancel < F.coalesce(end, F.lit(2**63 - 1)), F.lit(False)).alias("cancel_requested"),
        last(kind == "COMPLETED", F.col("result_hash")).alias("result_hash"),
    )


def accepted_under(cancellation: str, status: Column, cancel_requested: Column) -> Column:
    """Whether the workflow took a node's result, given how it waits for cancelled nodes."""
    done = status == "COMPLETED"
    return done & ~cancel_requested if cancellation == "TRY_CANCEL" else done


def naive_counters(rows: DataFrame, hist: DataFrame) -> DataFrame:
    """Counters of a sink without fences, by run: rows, repeats, rows that differ from an accepted result, accepted
    nodes without a row, rows of nodes not accepted. ``rows``: node key and ``output_hash``; ``hist``: node key,
    ``accepted``, ``result_hash``."""
    per_node = rows.groupBy(*NODE, "output_hash").agg(F.count("*").alias("n"))
    both = hist.select(*NODE, "accepted", "result_hash").join(per_node, NODE, "left")
    count = F.coalesce("n", F.lit(0))
    by_run = both.groupBy(*RUN).agg(
        F.sum(count).alias("rows"),
        F.sum(F.when(F.col("accepted") & F.col("n").isNotNull() & ~F.col("output_hash").eqNullSafe(F.col("result_hash")), count).otherwise(0)).alias("divergent_rows"),
        F.count_if(F.col("accepted") & F.col("n").isNull()).alias("lost_rows"),
        F.sum(F.when(~F.col("accepted"), count).otherwise(0)).alias("orphan_rows"),
    )
    repeats = rows.groupBy(*NODE).agg((F.count("*") - 1).alias("n")).groupBy(*RUN).agg(F.sum("n").alias("duplicate_rows"))
    return by_run.join(repeats, RUN, "left").na.fill(0, ["duplicate_rows"])
