"""Runs from open to sealed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import RUN, TERMINAL
from tidemark.operators.fold import ordered_fold

#: How a run can end, by what its workflow function did.
EXITS = ("continue_as_new", "cancel_error", "bare_cancel", "failure", "return", "other")


def exit_status(exit_kind: Column, cancel_requested: Column) -> Column:
    """The status that an exit seals a run with; null if it does not seal."""
    return (
        F.when(exit_kind == "continue_as_new", "CONTINUED_AS_NEW")
        .when((exit_kind == "cancel_error") & cancel_requested, "CANCELLED")
        .when(exit_kind == "bare_cancel", "FAILED")
        .when(exit_kind == "failure", "FAILED")
        .when(exit_kind == "return", "COMPLETED")
    )


def node_counts(nodes: DataFrame) -> DataFrame:
    """Rows of each run by status."""
    count = lambda s: F.count_if(F.col("status") == s)
    return nodes.groupBy(*RUN).agg(
        F.count("*").alias("rows"),
        count("COMMITTED").alias("committed"),
        count("PROVISIONAL").alias("provisional"),
        count("ABANDONED").alias("abandoned"),
        F.sort_array(F.collect_set("seq")).alias("_seqs"),
    )


def missing_seqs(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """``seq`` of every node that a run counts and the ledger lacks; a run of no nodes lacks none."""
    wanted = runs.where("node_count > 0").select(*RUN, F.explode(F.sequence(F.lit(0), F.col("node_count") - 1)).alias("seq"))
    return wanted.join(nodes.select(*RUN, "seq"), [*RUN, "seq"], "left_anti")


def seal(requests: DataFrame, nodes: DataFrame, sealed_by: str = "seal") -> DataFrame:
    """Seal results of ``requests`` (run key, status, node_count, accepted_count), over rows with commits and abandons
    applied.

    A run is degraded if fewer rows are committed than results were accepted. If it is not, its PROVISIONAL rows are
    abandoned; missing rows are told of degraded runs only. Requests without a terminal status are refused
    (``refused``). If requests have a column ``sealed``, those of runs that are sealed already change nothing
    (``already``): they are given with the counts as they are. ``final_state_hash`` and ``sealed_at`` of a request go
    into the seal, if they are there.

    A run's rows are counted before its request is joined; the seqs kept for that are as many as the run has nodes.
    """
    status = F.col("status")
    refused = ~status.isin(*TERMINAL)
    counts = node_counts(nodes)
    joined = requests.join(counts, RUN, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    already = F.coalesce(F.col("sealed"), F.lit(False)) if "sealed" in requests.columns else F.lit(False)
    degraded = ~already & (zero("committed") < F.col("accepted_count"))
    all_seqs = F.when(F.col("node_count") > 0, F.sequence(F.lit(0), F.col("node_count") - 1)).otherwise(F.expr("array()").cast("array<int>"))
    lacking = F.array_except(all_seqs, F.coalesce(F.col("_seqs"), F.expr("array()").cast("array<int>")))
    open_rows = F.when(degraded | already, 0).otherwise(zero("provisional"))
    return joined.select(
        *RUN,
        status,
        "node_count",
        zero("committed").alias("committed_count"),
        (zero("abandoned") + open_rows).alias("abandoned_count"),
        degraded.alias("degraded"),
        F.when(degraded, lacking).alias("missing_seqs"),
        F.lit(sealed_by).alias("sealed_by"),
        refused.alias("refused"),
        *([already.alias("already")] if "sealed" in requests.columns else []),
        *(c for c in ("final_state_hash", "sealed_at") if c in requests.columns),
    )


def settle(nodes: DataFrame, seals: DataFrame) -> DataFrame:
    """Rows after sealing: PROVISIONAL rows of runs that were sealed whole are abandoned."""
    fresh = seals.where("NOT already") if "already" in seals.columns else seals
    whole = fresh.where("NOT degraded AND NOT refused").select(*RUN).withColumn("_whole", F.lit(True))
    out = nodes.join(whole, RUN, "left")
    moved = (F.col("status") == "PROVISIONAL") & F.col("_whole")
    return out.withColumn("status", F.when(moved, "ABANDONED").otherwise(F.col("status"))).select(*nodes.columns)


def mark_degraded(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Runs with ``degraded`` set for those that are marked; marked runs that are not known are added."""
    bad = marks.select(*RUN).distinct().withColumn("_bad", F.lit(True))
    out = runs.join(bad, RUN, "full_outer")
    return out.withColumn("degraded", F.coalesce("degraded", F.lit(False)) | F.coalesce("_bad", F.lit(False))).drop("_bad")


class Observed:
    """What a run knows of its nodes: the next sequence number, how many results it accepted, and the ids that it still
    has to tell the ledger to commit or abandon."""

    def __init__(self, next_seq: int = 0, accepted: int = 0, commits: set[int] = (), abandons: set[int] = ()):
        self.next_seq, self.accepted, self.commits, self.abandons = next_seq, accepted, set(commits), set(abandons)

    def schedule(self) -> int:
        """The sequence number of a node that is scheduled now."""
        self.next_seq += 1
        return self.next_seq - 1

    def result(self, seq: int, ok: bool, carried: list[int]) -> None:
        """On success the ids that the node carried are settled and the node is to be committed; else abandoned."""
        if ok:
            self.commits.difference_update(carried)
            self.abandons.difference_update(carried)
            self.commits.add(seq)
            self.accepted += 1
        else:
            self.abandons.add(seq)


OBSERVED = "namespace string, workflow_id string, run_id string, step int, seq int, result string, accepted int, commits array<int>, abandons array<int>"


def observe(events: DataFrame) -> DataFrame:
    """What a workflow knows of its nodes after each result, in order: how many results it accepted, and the ids that
    it still has to tell the ledger to commit or abandon.

    ``events``: run key, ``step`` (order), ``seq``, ``result`` (ok, failed, cancelled), ``carried`` (ids told with the
    node's own schedule). On success the carried ids are settled; on failure the node joins the abandons. The stream
    form is ``streaming.observe``.
    """
    def step(run: Observed, event: dict) -> dict:
        run.result(event["seq"], event["result"] == "ok", event["carried"] or ())
        return {"accepted": run.accepted, "commits": sorted(run.commits), "abandons": sorted(run.abandons)}

    return ordered_fold(events.select(*RUN, "step", "seq", "result", "carried"), RUN, ["step"], Observed, step, OBSERVED)
