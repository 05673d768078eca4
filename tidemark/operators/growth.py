"""Growth, limits and clocks of runs: windows over event logs and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.model import NODE, RUN


#: Event ids to a block; a run is summed by blocks first, so no task holds the events of more than one block.
BLOCK = 4096


def _blocks(events: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Events with the block of their id (those without an id come first, in a block of their own), and for each block
    of a run its bytes and scheduled nodes, and those of the blocks before it."""
    numbered = events.withColumn("_block", F.coalesce(F.floor(F.col("event_id") / F.lit(block)), F.lit(-(1 << 62))))
    sums = numbered.groupBy(*RUN, "_block").agg(F.sum("size").alias("_bytes"), F.count_if(F.col("event_type") == "SCHEDULED").alias("_nodes"))
    before = Window.partitionBy(*RUN).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {"_bytes_before": F.sum("_bytes").over(before), "_nodes_before": F.coalesce(F.sum("_nodes").over(before), F.lit(0))}
    return numbered, sums.withColumns(earlier)


def _inside(numbered: DataFrame, blocks: DataFrame) -> DataFrame:
    """Running bytes and nodes of the events that lie in the given blocks."""
    order = Window.partitionBy(*RUN, "_block").orderBy("event_id")
    both = numbered.join(blocks.select(*RUN, "_block", "_bytes_before", "_nodes_before"), [*RUN, "_block"])
    bytes_, nodes = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.count_if(F.col("event_type") == "SCHEDULED").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = both.withColumns({"_bytes_here": bytes_, "_nodes_here": F.coalesce(nodes, F.lit(0))})
    total = F.coalesce(F.col("_bytes_before") + F.col("_bytes_here"), "_bytes_before", "_bytes_here")
    return out.withColumns({"history_bytes": total, "nodes_before": F.col("_nodes_before") + F.col("_nodes_here")}).drop("_block", "_bytes_before", "_nodes_before", "_bytes_here", "_nodes_here")


def running_bytes(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Events with the bytes of their run's history so far, and the nodes scheduled before them.

    Sums by block of event ids run along a run, and sums by event inside a block: a run with a third of all events is
    spread over its blocks. Events of one run with the same id stand in any order. Run keys are not null.
    """
    return _inside(*_blocks(events, block))


def limit_crossed(events: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """The first event of each run with which its history exceeds a limit, and the nodes scheduled before it. Sizes are
    not negative, so only the events of the first block that ends beyond the limit are looked at."""
    numbered, blocks = _blocks(events, block)
    upto = F.coalesce("_bytes_before", F.lit(0)) + F.coalesce("_bytes", F.lit(0))
    carried = F.struct("_block", "_bytes_before", "_nodes_before")
    first = blocks.where(upto > limit).groupBy(*RUN).agg(F.min_by(carried, "_block").alias("_first")).select(*RUN, "_first.*")
    over = _inside(numbered, first).where(F.col("history_bytes") > limit)
    return over.groupBy(*RUN).agg(F.min("event_id").alias("event_id"), F.min_by("nodes_before", "event_id").alias("nodes"))


def slopes(points: DataFrame) -> DataFrame:
    """Growth per node between neighbouring sizes of ``points(series, nodes, bytes)``."""
    order = Window.partitionBy("series").orderBy("nodes")
    out = points.withColumn("_nodes", F.lag("nodes").over(order)).withColumn("_bytes", F.lag("bytes").over(order))
    return out.where("_nodes IS NOT NULL").select("series", "nodes", F.round((F.col("bytes") - F.col("_bytes")) / (F.col("nodes") - F.col("_nodes")), 3).alias("slope"))


def largest(events: DataFrame) -> DataFrame:
    """The largest payload of each run and where it is; the first of equal ones."""
    return events.groupBy(*RUN).agg(F.max("size").alias("size"), F.max_by("event_id", F.struct(F.col("size"), -F.col("event_id"))).alias("event_id"))


def attempt_regressions(log: DataFrame) -> DataFrame:
    """Nodes whose last arrival has a lower attempt number than one before it: an attempt-only fence would be wrong."""
    each = log.groupBy(*NODE).agg(F.max_by("attempt", "arrival").alias("attempt"), F.max("attempt").alias("highest_before"))
    return each.where("attempt < highest_before")


def clock_inversions(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """For nodes with several attempts: whether a losing attempt's worker clock is later than the accepted one's, so
    that a fence by worker clocks would keep the wrong row."""
    several = log.groupBy(*NODE).agg(F.count_distinct("attempt").alias("n")).where("n > 1").select(*NODE)
    row = nodes.select(*NODE, F.col("attempt").alias("row_attempt"), F.col("worker_time").alias("row_time"))
    both = log.join(several, NODE, "left_semi").join(row, NODE)
    late = (F.col("attempt") != F.col("row_attempt")) & (F.col("worker_time") > F.col("row_time"))
    return both.groupBy(*NODE).agg(F.bool_or(late).alias("inverted"))


def wall(history_bytes: Column, largest_payload: Column, nodes: Column, history_limit: int, payload_limit: int, node_limit: int) -> Column:
    """Which limit a run hits first."""
    return F.when(largest_payload > payload_limit, "payload").when(history_bytes > history_limit, "history").when(nodes > node_limit, "nodes").otherwise("none")


def stop_outcome(status: Column, last_event: Column, error: Column) -> Column:
    """How a run stopped: what its status says, or STUCK if it is open and keeps failing, else OPEN."""
    return F.when(status != "RUNNING", status).when(last_event.isin("FAILED", "TIMED_OUT") | error.isNotNull(), "STUCK").otherwise("OPEN")


def relative_gap(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The largest relative difference of a value over joined keys."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return both.agg(F.round(F.max(F.abs((F.col("_a") - F.col("_b")) / F.nullif(F.col("_b").cast("double"), F.lit(0.0)))), 9).alias("gap"))


def ratio(points: DataFrame, over: str, under: str) -> DataFrame:
    """Bytes of one mode over those of another, for each ``kb`` and ``nodes`` of ``points(mode, kb, nodes, bytes)``."""
    side = lambda mode: F.max(F.when(F.col("mode") == mode, F.col("bytes")))
    both = points.groupBy("kb", "nodes").agg(side(over).alias("over"), side(under).alias("under")).where("over IS NOT NULL AND under IS NOT NULL")
    return both.withColumn("ratio", F.bround(F.col("over") / F.col("under"), 1))


def header_bytes(events: DataFrame) -> DataFrame:
    """Bytes of header fields of each run: names and values of a map column ``fields``."""
    each = events.select(*RUN, F.explode("fields").alias("name", "value"))
    return each.groupBy(*RUN).agg(F.count("*").alias("fields"), F.sum(F.octet_length("name") + F.octet_length("value")).cast("bigint").alias("header_bytes"))


def percentiles(values: DataFrame, by: list[str], column: str, percents: tuple[float, ...] = (50, 95)) -> DataFrame:
    """Nearest-rank percentiles of each group, with a half-even index, rounded to 3 places.

    Values are counted first, so a group costs its distinct values and no array is built: the value at an index is the
    first whose running count passes it.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_value"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    placed = counted.withColumns({"_upto": upto, "_total": total})
    at = lambda p: F.bround(F.lit(p / 100) * (F.col("_total") - 1), 0)
    value = lambda p: F.round(F.min(F.when(F.col("_upto") > at(p), F.col("_value"))), 3)
    found = placed.groupBy(*by).agg(*(value(p).alias(f"p{p:g}") for p in percents), F.sum("_n").alias("samples"))
    return values.select(*by).distinct().join(found, by, "left").fillna(0, ["samples"])


