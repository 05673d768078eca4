"""The read side: retry waste, timelines, run summaries, the ledger of a run as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.model import NODE, RUN
from tidemark.operators import fence


def _with_row(log: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    row = nodes.select(*NODE, F.col("fence_scheduled_at").alias("row_fence_scheduled_at"), F.col("attempt").alias("row_attempt"), *more)
    return log.join(row, NODE)


def _wasted(scheduled_at: str, attempt: str) -> Column:
    """Whether an attempt's fence is not that of the row."""
    return C.distinct_from(C.fence(), F.struct(F.col(scheduled_at).alias("fence_scheduled_at"), F.col(attempt).alias("attempt")))


def retry_waste(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each COMMITTED node what its other attempts spent: those written or fenced out whose fence is not the row's.

    Nodes without waste have a row; tokens default to none, cost is null if no wasted attempt has a price.
    """
    tried = log.where(F.col("outcome").isin("WROTE", "FENCED_OUT")).select(*NODE, "fence_scheduled_at", "attempt", "tokens_in", "tokens_out", "cost_usd")
    both = _with_row(tried, nodes.where("status = 'COMMITTED'"), "node")
    wasted = _wasted("row_fence_scheduled_at", "row_attempt")
    return both.groupBy(*NODE, "node").agg(
        F.count_if(wasted).alias("wasted_attempts"),
        F.coalesce(F.sum(F.when(wasted, C.tokens())), F.lit(0)).cast("bigint").alias("wasted_tokens"),
        F.sum(F.when(wasted, F.col("cost_usd"))).alias("wasted_cost_usd"),
    )


def waste_total(waste: DataFrame) -> DataFrame:
    """Totals of each run."""
    return waste.groupBy(*RUN).agg(
        F.sum("wasted_attempts").alias("wasted_attempts"), F.sum("wasted_tokens").alias("wasted_tokens"), F.sum("wasted_cost_usd").alias("wasted_cost_usd")
    )


def attempt_waste(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """Waste as the run ledger shows it: attempts whose *number* is not the row's, whatever their outcome and the
    row's status. Differs from ``retry_waste`` on purpose."""
    both = _with_row(log.select(*NODE, "attempt", "tokens_in", "tokens_out"), nodes)
    return both.groupBy(*NODE).agg(F.coalesce(F.sum(F.when(F.col("attempt") != F.col("row_attempt"), C.tokens())), F.lit(0)).cast("bigint").alias("retry_waste"))


def timeline(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """Each node with its number of write attempts, its duration and how long its commit lagged."""
    writes = log.groupBy(*NODE).agg(F.count("*").alias("write_attempts"))
    shown = ["node", "lg_step", "lg_path", "status", "attempt", "started_at", "finished_at", "committed_at", "tokens_in", "tokens_out", "cost_usd", "output_hash", "input_bytes"]
    return (
        nodes.select(*NODE, *shown, C.kind_of(F.col("output_json")).alias("kind"))
        .join(writes, NODE, "left")
        .withColumn("write_attempts", F.coalesce("write_attempts", F.lit(0)))
        .withColumn("duration_ms", C.duration_ms(F.col("started_at"), F.col("finished_at")))
        .withColumn("commit_lag_ms", C.duration_ms(F.col("finished_at"), F.col("committed_at")))
    )


_SUMMARY = ("rows", "committed", "provisional", "abandoned", "tokens_in", "tokens_out", "retry_waste_tokens", "effects", "duplicate_effects_prevented")


def _by_run(nodes: DataFrame, *more: Column) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return nodes.groupBy(*RUN).agg(
        F.count("seq").alias("rows"),
        count("COMMITTED").alias("committed"),
        count("PROVISIONAL").alias("provisional"),
        count("ABANDONED").alias("abandoned"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.sum("cost_usd").alias("cost_usd"),
        *more,
    )


def run_summary(runs: DataFrame, nodes: DataFrame, waste: DataFrame, effects: DataFrame) -> DataFrame:
    """One row for each run: status, rows by status, spend, waste, effects. Each part is an aggregate by run before it
    is joined, so all joins are one row to one row."""
    wasted = waste.groupBy(*RUN).agg(F.sum("wasted_tokens").alias("retry_waste_tokens"))
    effect = effects.groupBy(*RUN).agg(F.count("*").alias("effects"), F.sum("duplicates_prevented").alias("duplicate_effects_prevented"))
    out = runs.join(_by_run(nodes), RUN, "left").join(wasted, RUN, "left").join(effect, RUN, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in _SUMMARY})


def log_summary(runs: DataFrame, log: DataFrame) -> DataFrame:
    """``run_summary`` out of the log alone, in one pass over it.

    ``log``: classified attempts with ``row`` (``fence.with_row``: fence, status, tokens_in, tokens_out, cost_usd). If
    they have a column ``duplicates_prevented``, each attempt has one effect, and these are counted too. The log is
    sorted once by node; dealt by run, as ``runs``, neither is shuffled again.
    """
    tried = F.col("outcome").isin("WROTE", "FENCED_OUT")
    spent = F.when((F.col("row.status") == "COMMITTED") & tried & _wasted("row.fence_scheduled_at", "row.attempt"), C.tokens())
    numbers = {"_wasted": F.sum(spent)}
    sums = [F.sum("_wasted").alias("retry_waste_tokens")]
    if "duplicates_prevented" in log.columns:
        numbers |= {"_effects": F.count("*"), "_prevented": F.sum("duplicates_prevented")}
        sums += [F.sum("_effects").alias("effects"), F.sum("_prevented").alias("duplicate_effects_prevented")]
    by_run = _by_run(_one_each(log, numbers), *sums)
    out = runs.join(by_run, RUN, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in _SUMMARY if c in by_run.columns})


def _one_each(log: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    """One row for each node of a log with ``row``: its key, the row's columns, and aggregates of its attempts."""
    place = F.row_number().over(Window.partitionBy(*NODE).orderBy("arrival"))
    counted = log.withColumns({name: number.over(fence.of_node()) for name, number in numbers.items()} | {"_place": place})
    return counted.where("_place = 1").select(*NODE, *numbers, "row.*")


def notes(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """``note`` of each node: what became of its attempts, in order of the audit trail.

    ``log``: audit rows with ``arrival``, ``outcome``, ``output_hash`` and ``note``.
    """
    row = nodes.select(*NODE, F.col("attempt").alias("row_attempt"), F.col("output_hash").alias("row_hash"))
    tried = log.select(*NODE, "arrival", "attempt", "outcome", "output_hash", "note").join(row, NODE)
    told = tried.select(*NODE, "arrival", _text("row_attempt", "row_hash").alias("text")).where("text IS NOT NULL")
    return told.groupBy(*NODE).agg(_joined(F.collect_list(F.struct("arrival", "text"))).alias("note"))


def _text(row_attempt: str, row_hash: str) -> Column:
    """What became of an attempt; null if nothing is to be told."""
    attempt, final, why = F.col("attempt").cast("string"), F.col(row_attempt).cast("string"), F.col("note")
    differs = F.when(F.col("output_hash") != F.col(row_hash), "divergent output discarded").otherwise("same output")
    overwritten = F.concat(F.lit("attempt "), attempt, F.lit("'s row overwritten by attempt "), final, F.lit("; "), differs)
    stale = F.concat(F.lit("stale attempt "), attempt, F.lit(" fenced out"), F.when(F.length(why) > 0, F.concat(F.lit(" ("), why, F.lit(")"))).otherwise(""))
    return (
        F.when((F.col("outcome") == "WROTE") & (F.col("attempt") != F.col(row_attempt)), overwritten)
        .when(F.col("outcome") == "FENCED_OUT", stale)
        .when(F.col("outcome") == "DIVERGENCE_REPAIRED", F.concat(F.lit("reconcile: "), F.coalesce(why, F.lit(""))))
    )


def _joined(told: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(told), lambda s: s["text"]), "; ")


def node_lines(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ledger of runs: one line of text for each node."""
    return _lines(nodes.join(attempt_waste(log, nodes), NODE, "left").join(notes(log, nodes), NODE, "left"))


def log_lines(log: DataFrame) -> DataFrame:
    """``node_lines`` out of the log alone, in one pass over it.

    ``log``: audit rows with ``row`` (``fence.with_row``: node, lg_step, attempt, status, output_hash, tokens_in,
    tokens_out).
    """
    told = log.withColumn("text", _text("row.attempt", "row.output_hash"))
    waste = F.sum(F.when(F.col("attempt") != F.col("row.attempt"), C.tokens()))
    one = _one_each(told, {"retry_waste": waste, "_told": F.collect_list(F.when(F.col("text").isNotNull(), F.struct("arrival", "text")))})
    return _lines(one.withColumns({"retry_waste": F.col("retry_waste").cast("bigint"), "note": _joined(F.col("_told"))}))


def _lines(out: DataFrame) -> DataFrame:
    left, right = F.rpad, F.lpad
    waste = F.coalesce("retry_waste", F.lit(0))
    wide = lambda c, n, pad: F.when(F.length(c) > n, c).otherwise(pad(c, n, " "))
    line = F.concat_ws(
        " ",
        F.lit(""),
        *(
            wide(c, n, pad)
            for c, n, pad in (
                (F.col("seq").cast("string"), 3, right),
                (F.coalesce("node", F.lit("?")), 16, left),
                (F.coalesce(F.col("lg_step").cast("string"), F.lit("")), 4, right),
                (F.col("attempt").cast("string"), 7, right),
                (F.col("status"), 11, left),
                (C.short(F.col("output_hash")), 12, left),
                (F.format_number(C.tokens(), 0), 7, right),
                (F.format_number(waste, 0), 11, right),
            )
        ),
    )
    return out.select(*NODE, F.concat(line, F.lit("  "), F.coalesce("note", F.lit(""))).alias("line"), waste.alias("retry_waste"), F.coalesce("note", F.lit("")).alias("note"))


def header_lines(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``line`` of each run: status, sealed by whom, rows, degraded and what is missing. A run that was not counted by a
    seal shows the number of its rows."""
    rows = nodes.groupBy(*RUN).agg(F.count("*").alias("_rows"))
    sealed = F.col("sealed_at").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    by = F.when(sealed & (F.col("sealed_by") != "seal"), F.concat(F.lit(" (by "), F.col("sealed_by"), F.lit(")"))).otherwise("")
    lacks = F.when(F.size("missing_seqs") > 0, F.concat(F.lit(" missing=["), F.array_join(F.col("missing_seqs").cast("array<string>"), ", "), F.lit("]"))).otherwise("")
    flag = F.when(F.coalesce("degraded", F.lit(False)), F.concat(F.lit("  DEGRADED"), F.coalesce(lacks, F.lit("")))).otherwise("")
    line = F.concat(
        F.lit("LEDGER  wf="), "workflow_id", F.lit("  run="), "run_id", F.lit("  status="), "status", F.lit("  "), F.when(sealed, "sealed").otherwise("open"), F.coalesce(by, F.lit("")),
        F.lit("  nodes="), F.coalesce(F.col("node_count").cast("string"), zero("_rows")), F.lit(" committed="), zero("committed_count"), F.lit(" abandoned="), zero("abandoned_count"), flag,
    )
    return runs.join(rows, RUN, "left").select(*RUN, line.alias("line"))


def effect_summary(effects: DataFrame) -> DataFrame:
    """``line`` of each run with effects: names in the order of their first node, how many of each, a key to show, and
    the duplicates prevented in all."""
    by_name = effect_lines(effects)
    shown = F.concat("name", F.lit(" x"), F.col("effects").cast("string"), F.lit(" (key "), F.substring("key", 1, 6), F.lit("...)"))
    listed = F.array_sort(F.collect_list(F.struct("first_seq", "name", shown.alias("text"))))
    prevented = F.coalesce(F.sum("duplicates_prevented"), F.lit(0)).cast("string")
    line = F.concat(F.lit("effects: "), F.array_join(F.transform(listed, lambda s: s["text"]), ", "), F.lit("    duplicates prevented: "), prevented)
    return by_name.groupBy(*RUN).agg(line.alias("line"))


HEADING = " seq node             step attempt status      output_hash   tokens retry_waste  note"


def run_ledger(runs: DataFrame, log: DataFrame, nodes: DataFrame, effects: DataFrame) -> DataFrame:
    """The ledger of runs as text: ``part`` 0 is the header, 1 the heading, 2 a line for each node (by ``seq``), 3 the
    effects. Sort by run, ``part`` and ``seq`` to read it."""
    place = lambda df, part, seq=None: df.select(*RUN, F.lit(part).alias("part"), (F.lit(None).cast("int") if seq is None else F.col(seq)).alias("seq"), "line")
    out = place(header_lines(runs, nodes), 0).unionByName(place(runs.select(*RUN, F.lit(HEADING).alias("line")), 1))
    out = out.unionByName(place(node_lines(log, nodes), 2, "seq"))
    return out.unionByName(place(effect_summary(effects).join(runs.select(*RUN), RUN, "left_semi"), 3))


def effect_lines(effects: DataFrame) -> DataFrame:
    """Effects of each run by name: how many, a key to show, duplicates prevented, the statuses (ordered)."""
    return effects.groupBy(*RUN, "name").agg(
        F.count("*").alias("effects"),
        F.min("key").alias("key"),
        F.sum("duplicates_prevented").cast("bigint").alias("duplicates_prevented"),
        F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"),
        F.min("seq").alias("first_seq"),
    )


def status(runs: DataFrame, limit: int) -> DataFrame:
    """The most recent runs; ties by key."""
    return runs.orderBy(F.desc("first_seen_at"), *RUN).limit(limit)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each workflow."""
    order = Window.partitionBy("namespace", "workflow_id").orderBy(F.desc("first_seen_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
