"""Repair: hold ledger rows against the history of their run, decide what to do, and count what is wrong."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.model import NODE, RUN, TERMINAL
from tidemark.streaming.jobs import written

ENDED = ("CANCEL_REQUESTED", "FAILED", "TIMED_OUT", "CANCELED")


def compare(hist: DataFrame, rows: DataFrame) -> DataFrame:
    """Full outer join by node: history columns as they are, row columns with ``row_``."""
    mine = rows.select(*NODE, *(F.col(c).alias(f"row_{c}") for c in rows.columns if c not in NODE), F.lit(True).alias("_row"))
    theirs = hist.withColumn("_hist", F.lit(True))
    out = theirs.join(mine, NODE, "full_outer")
    return out.withColumn("in_history", F.coalesce("_hist", F.lit(False))).withColumn("in_ledger", F.coalesce("_row", F.lit(False))).drop("_hist", "_row")


def node_facts(hist: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each node: what history says of it (``h``, null if nothing) and its ledger row (``r``, null if none).

    Both sides go through one shuffle by node. Of a node that was scheduled twice the later scheduling counts; the
    ledger has one row a node by its key.
    """
    later = F.coalesce(F.col("h.scheduled_event_id").cast("long"), F.lit(-1)) if "scheduled_event_id" in hist.columns else F.lit(0)
    said, is_row = F.struct(*hist.columns), F.struct(*rows.columns)
    both = hist.select(*NODE, said.alias("h"), F.lit(None).cast(rows.schema).alias("r")).unionByName(
        rows.select(*NODE, F.lit(None).cast(hist.schema).alias("h"), is_row.alias("r"))
    )
    return both.groupBy(*NODE).agg(F.max_by("h", F.when(F.col("h").isNotNull(), later)).alias("h"), F.first("r", ignorenulls=True).alias("r"))


def kind_of_action() -> Column:
    """What a node needs if its run is repaired: insert, rewrite, commit, abandon, abandon-if-closed or none."""
    known, there = F.col("h").isNotNull(), F.col("r").isNotNull()
    accepted, open_row = F.coalesce("h.accepted", F.lit(False)), F.col("r.status") == "PROVISIONAL"
    ended = F.coalesce(F.col("h.status").isin(*ENDED) | F.col("h.cancel_requested"), F.lit(False))
    return (
        F.when(known & accepted & ~there, "insert")
        .when(known & accepted & open_row & C.distinct_from(F.col("r.output_hash"), F.col("h.result_hash")), "rewrite")
        .when(known & accepted & open_row, "commit")
        .when(known & ~accepted & open_row & ended, "abandon")
        .when(known & ~accepted & open_row, "abandon-if-closed")
        .otherwise("none")
    )


def skipped(include_open: bool) -> Column:
    """Why a run is left alone: history-gone, skipped-sealed, open; null if it is repaired."""
    return (
        F.when(~F.col("found"), "history-gone")
        .when(F.col("sealed") & ~F.col("degraded"), "skipped-sealed")
        .when(~F.col("closed") & F.lit(not include_open), "open")
    )


def _action(live: Column, closed: Column) -> Column:
    """The action of a node, of its kind ``kind`` and of its run."""
    kind = F.when((F.col("kind") == "abandon-if-closed") & closed, "abandon").when(F.col("kind") == "abandon-if-closed", "none").otherwise(F.col("kind"))
    return F.when(live, kind).otherwise("none")


def decide(hist: DataFrame, rows: DataFrame, runs: DataFrame, include_open: bool = False) -> DataFrame:
    """``action`` for each node of each run: insert, rewrite (and commit), commit, abandon, none; or, with null ``seq``,
    why a run is skipped: history-gone, skipped-sealed, open.

    ``runs``: run key, ``found``, ``closed``, ``sealed``, ``degraded``. Nodes of runs that ``runs`` lacks are left out.
    """
    judged = runs.select(*RUN, "closed", skipped(include_open).alias("skipped"))
    facts = node_facts(hist, rows).select(*NODE, kind_of_action().alias("kind"))
    acted = facts.join(judged.where("skipped IS NULL"), RUN).select(*NODE, _action(F.lit(True), F.col("closed")).alias("action"))
    return acted.unionByName(judged.where("skipped IS NOT NULL").select(*RUN, F.lit(None).cast("int").alias("seq"), F.col("skipped").alias("action")))


def row_after(hist: DataFrame, rows: DataFrame, at: Column | None = None, whole: Column | None = None) -> list[Column]:
    """Columns of a node's row after ``action``, from ``h`` and ``r``.

    A rewritten row takes hash, outputs and attempt from history and keeps the rest. An inserted row takes all that
    history knows: the start as its fence, the graph out of the activity type, the kind out of the output; columns that
    history lacks are null. ``at`` is the time of the commits. An attempt that history lacks is the first one. Where
    ``whole`` holds, the run was sealed whole and rows still PROVISIONAL are abandoned.
    """
    of = lambda c: F.col(f"h.{c}") if c in hist.columns else F.lit(None)
    attempt = F.coalesce(of("attempt"), F.lit(1))
    outputs = {c: of(c) for c in ("output_json", "output_bytes", "output_encoding") if c in hist.columns}
    committed = F.col("action").isin("commit", "rewrite")
    status = F.when(committed, "COMMITTED").when(F.col("action") == "abandon", "ABANDONED")
    if whole is not None:
        status = status.when(whole & (F.col("r.status") == "PROVISIONAL"), "ABANDONED")
    kept = {"status": status.otherwise(F.col("r.status"))}
    kept |= {c: F.when(F.col("action") == "rewrite", v).otherwise(F.col(f"r.{c}")) for c, v in {"output_hash": of("result_hash"), "attempt": attempt, **outputs}.items() if c in rows.columns}
    if at is not None and "committed_at" in rows.columns:
        kept["committed_at"] = F.when(committed, at).otherwise(F.col("r.committed_at"))
    made = {
        "status": F.lit("COMMITTED"), "output_hash": of("result_hash"), "attempt": attempt, "fence_scheduled_at": of("started_at"), "started_at": of("started_at"),
        "finished_at": F.coalesce(of("completed_at"), of("started_at")), "activity_id": of("activity_id"), "activity_type": of("activity_type"),
        "graph": C.graph_of(of("activity_type").cast("string")), "kind": C.kind_of(of("output_json").cast("string")), "committed_at": F.lit(None) if at is None else at, **outputs,
    }
    new = F.col("action") == "insert"
    columns = [F.when(new, made.get(f.name, F.lit(None)).cast(f.dataType)).otherwise(kept.get(f.name, F.col(f"r.{f.name}"))) for f in rows.schema if f.name not in NODE]
    return [*(F.col(c) for c in NODE), *(c.alias(n) for c, n in zip(columns, (n for n in rows.columns if n not in NODE)))]


def apply_actions(hist: DataFrame, rows: DataFrame, actions: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows after the actions, with the columns of ``rows``; see ``row_after``. ``hist`` may carry ``output_json``,
    ``output_bytes``, ``output_encoding``, ``activity_id``, ``activity_type``, ``started_at`` and ``completed_at``."""
    did = actions.where("seq IS NOT NULL AND action <> 'none'").select(*NODE, "action")
    facts = node_facts(hist, rows).join(did, NODE, "left").withColumn("action", F.coalesce("action", F.lit("none")))
    return facts.where("r IS NOT NULL OR action = 'insert'").select(*row_after(hist, rows, at)).select(*rows.columns)


def _audits(hist: DataFrame | None) -> list[Column]:
    note = F.when(F.col("action") == "insert", "row inserted from history").otherwise("row rewritten from history")
    told = [*(F.col(c) for c in NODE), F.lit("DIVERGENCE_REPAIRED").alias("outcome"), note.alias("note")]
    if hist is None:
        return told
    return [*told, F.coalesce("h.attempt", F.lit(1)).alias("attempt"), F.col("h.started_at").alias("fence_scheduled_at"), F.col("h.result_hash").alias("output_hash")]


def repairs(actions: DataFrame) -> DataFrame:
    """Audit rows of repairs."""
    return actions.where("action IN ('insert', 'rewrite')").select(*_audits(None))


@dataclass(frozen=True)
class Reconciled:
    """``rows`` and ``runs`` afterwards, ``audits`` (new attempts), ``seals`` (runs closed now) and ``report``."""

    rows: DataFrame
    runs: DataFrame
    audits: DataFrame
    seals: DataFrame
    report: DataFrame


def reconcile(hist: DataFrame, rows: DataFrame, runs: DataFrame, include_open: bool = False, at: Column | None = None) -> Reconciled:
    """One pass: rows are brought in line with their history, and closed runs that were not sealed are sealed.

    ``runs``: run key, ``status``, ``found``, ``closed``, ``sealed``, ``degraded``, and, if known, the
    ``final_state_hash`` of what the run returned, which seals of COMPLETED runs keep. A run is sealed over its repaired
    rows with the counts of its history; if it is whole, what is still PROVISIONAL is abandoned. Sealed runs that are
    degraded are repaired and stay as they are. Rows of runs that ``runs`` lacks stay. ``report``: the run's ``action``
    (history-gone, skipped-sealed, open, sealed, repaired, none) and what was done to how many nodes.

    History and rows meet once, by node, and are written with the kind of action that each node needs; what a run needs
    is counted from that by run (partial counts before the shuffle, so a large run is no large task) and written as one
    row a run. All results are read from these two tables.
    """
    facts = written(node_facts(hist, rows).withColumn("kind", kind_of_action()))
    count = lambda test, name: F.count_if(test).alias(f"_{name}")
    kinds = [count(F.col("kind") == k, k) for k in ("insert", "rewrite", "commit", "abandon", "abandon-if-closed")]
    states = [count(F.col("r.status") == s, s) for s in ("COMMITTED", "ABANDONED", "PROVISIONAL")]
    counts = facts.groupBy(*RUN).agg(*kinds, *states, count(F.col("h").isNotNull(), "nodes"), count(F.coalesce("h.accepted", F.lit(False)), "accepted"))
    of = lambda name: F.coalesce(F.col(f"`_{name}`"), F.lit(0))
    both = runs.join(counts, RUN, "left").withColumn("_skipped", skipped(include_open))
    live = F.col("_skipped").isNull()
    done = {k: F.when(live, of(k)).otherwise(0) for k in ("insert", "rewrite", "commit")}
    gone = F.when(live, of("abandon") + F.when(F.col("closed"), of("abandon-if-closed")).otherwise(0)).otherwise(0)
    known = F.col("final_state_hash") if "final_state_hash" in runs.columns else F.lit(None).cast("string")
    sealing = F.col("found") & F.col("closed") & ~F.col("sealed")
    verdicts = both.select(
        *runs.columns, "_skipped", sealing.alias("_due"), F.col("status").isin(*TERMINAL).alias("_terminal"), of("nodes").cast("int").alias("_nodes"),
        done["insert"].alias("_inserted"), done["rewrite"].alias("_rewritten"), (done["commit"] + done["rewrite"]).alias("_committed"), gone.alias("_abandoned"),
        (of("COMMITTED") + done["insert"] + done["rewrite"] + done["commit"]).alias("_standing"), (of("ABANDONED") + gone).alias("_dropped"),
        (of("PROVISIONAL") - done["rewrite"] - done["commit"] - gone).alias("_open"), of("accepted").alias("_accepted"), F.when(F.col("status") == "COMPLETED", known).alias("_final"),
    )
    verdicts = written(verdicts.withColumn("_short", F.col("_due") & (F.col("_standing") < F.col("_accepted"))).withColumn("_now", F.col("_due") & F.col("_terminal")))

    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    changed = F.col("_inserted") + F.col("_rewritten") + F.col("_committed") + F.col("_abandoned") > 0
    action = F.coalesce("_skipped", F.when(F.col("_now"), "sealed").when(changed, "repaired").when(~F.col("closed"), "open").otherwise("none"))
    report = verdicts.select(*RUN, action.alias("action"), *(F.col(f"_{c}").alias(c) for c in ("inserted", "rewritten", "committed", "abandoned")))
    flags = {"sealed": F.col("sealed") | F.col("_now"), "degraded": F.col("degraded") | (F.col("_now") & F.col("_short"))}
    after = verdicts.select(*(flags[c].alias(c) if c in flags else F.col(c) for c in runs.columns))

    judged = verdicts.select(*RUN, F.col("_skipped").isNull().alias("_live"), "closed", (F.col("_now") & ~F.col("_short")).alias("_whole"))
    acted = facts.join(judged, RUN, "left").withColumn("action", _action(flag("_live"), flag("closed")))
    new_rows = acted.where("r IS NOT NULL OR action = 'insert'").select(*row_after(hist, rows, at, flag("_whole"))).select(*rows.columns)
    return Reconciled(new_rows, after, acted.where("action IN ('insert', 'rewrite')").select(*_audits(hist)), _seals(verdicts, acted, at), report)


def _seals(verdicts: DataFrame, acted: DataFrame, at: Column | None) -> DataFrame:
    """Seals of this pass as ``lifecycle.seal`` gives them. Missing seqs are worked out for degraded runs only: the
    numbers that the run counts, without those that have a row."""
    due = verdicts.where("_due")
    short = due.where("_short AND _nodes > 0").select(*RUN, F.explode(F.sequence(F.lit(0), F.col("_nodes") - 1)).alias("seq"))
    there = acted.where("r IS NOT NULL OR action = 'insert'").select(*NODE)
    missing = short.join(there, NODE, "left_anti").groupBy(*RUN).agg(F.sort_array(F.collect_list("seq")).alias("_missing"))
    none = F.expr("array()").cast("array<int>")
    return due.join(missing, RUN, "left").select(
        *RUN, "status", F.col("_nodes").alias("node_count"), F.col("_standing").cast("long").alias("committed_count"),
        (F.col("_dropped") + F.when(F.col("_short"), 0).otherwise(F.col("_open"))).cast("long").alias("abandoned_count"), F.col("_short").alias("degraded"),
        F.when(F.col("_short"), F.coalesce("_missing", none)).alias("missing_seqs"), F.lit("reconcile").alias("sealed_by"), (~F.col("_terminal")).alias("refused"),
        F.col("_final").alias("final_state_hash"), *([] if at is None else [at.alias("sealed_at")]),
    )


def targets(runs: DataFrame, nodes: DataFrame, workflow_id: str | None = None) -> DataFrame:
    """Runs to reconcile: those of one workflow, or all that are open or degraded with PROVISIONAL rows."""
    if workflow_id is not None:
        return runs.where(F.col("workflow_id") == workflow_id).select(*RUN)
    pending = nodes.where("status = 'PROVISIONAL'").select(*RUN)
    stuck = runs.where("degraded").join(pending, RUN, "left_semi").select(*RUN)
    return runs.where("NOT sealed").select(*RUN).unionByName(stuck).distinct()


def invariants(hist: DataFrame, rows: DataFrame, sealed: DataFrame) -> DataFrame:
    """Counters of a run: rows, duplicate, divergent, lost, orphan, wrongly committed rows.

    ``hist``: node key, ``accepted``, ``result_hash``, one row for each scheduling; ``sealed``: keys of sealed runs.
    Both sides are counted by node first, so the join has one row a node however often it is written.
    """
    row = rows.groupBy(*NODE).agg(
        F.count("*").alias("n"),
        F.max_by("status", "status").alias("row_status"),
        F.max_by("output_hash", "status").alias("row_hash"),
        F.count_if(F.col("status") == "PROVISIONAL").alias("open"),
    )
    event = hist.groupBy(*NODE).agg(
        F.count("*").alias("times"), F.min_by("accepted", "scheduled_event_id").alias("accepted"), F.min_by("result_hash", "scheduled_event_id").alias("result_hash")
    )
    closed = sealed.select(*RUN).distinct().withColumn("sealed", F.lit(True))
    both = event.join(row, NODE, "full_outer").join(closed, RUN, "left")
    known, there = F.col("times").isNotNull(), F.col("n").isNotNull()
    accepted, status = F.coalesce("accepted", F.lit(False)), F.col("row_status")
    n = F.coalesce("n", F.lit(0))
    return both.groupBy(*RUN).agg(
        F.sum(n).alias("rows"),
        F.sum(F.greatest(n - 1, F.lit(0)) + F.greatest(F.coalesce("times", F.lit(0)) - 1, F.lit(0)) + F.when(there & ~known, n).otherwise(0)).alias("duplicate_rows"),
        F.count_if(accepted & (status == "COMMITTED") & C.distinct_from(F.col("row_hash"), F.col("result_hash"))).alias("divergent_rows"),
        F.count_if(known & accepted & (~there | (status == "ABANDONED"))).alias("lost_rows"),
        F.sum(F.when(F.coalesce("sealed", F.lit(False)), F.coalesce("open", F.lit(0))).otherwise(0)).alias("orphan_rows"),
        F.count_if(known & ~accepted & (status == "COMMITTED")).alias("wrongly_committed"),
    )


def repeated_effects(calls: DataFrame) -> DataFrame:
    """Surplus calls of each workflow with the same run, effect and request."""
    surplus = calls.groupBy(*RUN, "name", "request_hash").agg((F.count("*") - 1).alias("n")).where("n > 0")
    return surplus.groupBy("namespace", "workflow_id").agg(F.sum("n").alias("duplicate_side_effects"))
