"""Effects that must happen once, and model calls that must be paid once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.model import NODE, RUN
from tidemark.operators.fold import ordered_fold

EFFECT_KEY = [*NODE, "name", "idx"]
FOLDED = (
    "namespace string, workflow_id string, run_id string, seq int, name string, idx int, key string, arrival long, event string, "
    "outcome string, status string, request_hash string, result string, attempts int, duplicates_prevented int, resolution string"
)


class Effect:
    """The state of one effect, moved by events in order of arrival.

    call: none -> STARTED; another request is a divergence in any status; DONE is replayed and counted as prevented;
    RESOLVED as not done or not sent starts again; STARTED and UNKNOWN become UNKNOWN unless a reconciliation settles
    it. done: -> DONE. not-sent: STARTED -> RESOLVED. resolve-done / resolve-not-done: by hand, of effects not DONE.
    """

    def __init__(self):
        self.status = self.request = self.result = self.resolution = None
        self.attempts = self.prevented = 0

    def apply(self, event: str, request: str | None, result: str | None) -> str:
        if event in ("call", "reconcile-found", "reconcile-not-done"):
            return self._call(event, request, result)
        if self.status is None:
            return "ignored"
        if event == "done":
            if self.status == "DONE":
                return "ignored"
            self.status, self.result = "DONE", result
            return "recorded"
        if event == "not-sent":
            if self.status != "STARTED":
                return "ignored"
            self.status, self.resolution = "RESOLVED", "not-sent"
            return "released"
        if event in ("resolve-done", "resolve-not-done"):
            if self.status == "DONE":
                return "ignored"
            if event == "resolve-done":
                self.status, self.resolution = "DONE", "manual:done"
            else:
                self.status, self.resolution = "RESOLVED", "not-done"
            return "resolved"
        return "lost"  # a crash between call and record

    def _call(self, event: str, request: str | None, result: str | None) -> str:
        if self.status is None:
            self.status, self.request, self.attempts = "STARTED", request, 1
            return "called"
        if request != self.request:
            return "divergence"
        if self.status == "DONE":
            self.attempts, self.prevented = self.attempts + 1, self.prevented + 1
            return "replayed"
        if self.status == "RESOLVED" and self.resolution in ("not-done", "not-sent"):
            self.status, self.resolution, self.attempts = "STARTED", None, self.attempts + 1
            return "called"
        if event == "reconcile-found":
            self.status, self.result, self.resolution = "DONE", result, "reconciled:done"
            return "found"
        if event == "reconcile-not-done":
            self.status, self.result, self.resolution = "DONE", result, "reconciled:not-done"
            return "called"
        if self.status in ("STARTED", "UNKNOWN"):
            self.status, self.attempts = "UNKNOWN", self.attempts + 1
        return "unknown"


def replay(events: DataFrame) -> DataFrame:
    """One row for each event with its outcome and the effect's state after it."""
    def step(effect: Effect, row: dict) -> dict:
        outcome = effect.apply(row["event"], row["request_hash"], row["result"])
        return {
            "outcome": outcome,
            "status": effect.status,
            "request_hash": effect.request,
            "result": effect.result,
            "attempts": effect.attempts,
            "duplicates_prevented": effect.prevented,
            "resolution": effect.resolution,
        }

    keyed = events.select(*EFFECT_KEY, H.effect_key().alias("key"), "arrival", "event", "request_hash", "result")
    return ordered_fold(keyed, EFFECT_KEY, ["arrival"], Effect, step, FOLDED)


def effects(replayed: DataFrame) -> DataFrame:
    """The effects table: the last state of each effect that was ever called."""
    kept = ["status", "request_hash", "result", "attempts", "duplicates_prevented", "resolution"]
    out = replayed.groupBy(*EFFECT_KEY, "key").agg(F.max_by(F.struct(*kept), "arrival").alias("row"))
    return out.select(*EFFECT_KEY, "key", "row.*").where("status IS NOT NULL")


def resolve(effects_: DataFrame, decisions: DataFrame, at: Column | None = None) -> DataFrame:
    """Effects after decisions by hand (``key``, ``outcome`` done or not-done, ``result`` if there); effects that are
    DONE stay. An effect that is done takes the decision's result and ``at`` as its time. Any other outcome, or a key
    that no effect has, fails the query."""
    result = F.col("result") if "result" in decisions.columns else F.lit(None).cast("string")
    wrong = F.concat(F.lit("outcome must be 'done' or 'not-done', not "), F.coalesce("outcome", F.lit("null")))
    checked = F.when(F.coalesce(F.col("outcome").isin("done", "not-done"), F.lit(False)), F.col("outcome")).otherwise(F.raise_error(wrong).cast("string"))
    told = decisions.select("key", checked.alias("_to"), result.alias("_result"))
    out = effects_.withColumn("_there", F.lit(True)).join(told, "key", "full_outer")
    moved = F.col("_to").isNotNull() & (F.col("status") != "DONE")
    done = moved & (F.col("_to") == "done")
    known = F.when(F.col("_there"), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no effect with key "), F.col("key"))).cast("string"))
    changed = {
        "status": F.when(done, "DONE").when(moved, "RESOLVED").otherwise(known),
        "resolution": F.when(done, "manual:done").when(moved, "not-done").otherwise(F.col("resolution")),
    }
    if "result" in effects_.columns:
        changed["result"] = F.when(done, F.col("_result")).otherwise(F.col("result"))
    if at is not None and "done_at" in effects_.columns:
        changed["done_at"] = F.when(done, at).otherwise(F.col("done_at"))
    return out.withColumns(changed).select(*effects_.columns)


def occurrence(calls: DataFrame, order: str = "arrival") -> DataFrame:
    """Calls with ``idx``: how many calls of the same name came before in the same attempt of the node."""
    place = Window.partitionBy(*NODE, "attempt", "name").orderBy(order)
    return calls.withColumn("idx", F.row_number().over(place) - 1)


def journal(calls: DataFrame) -> DataFrame:
    """Model calls journaled: the first attempt writes, every later one with the same key is a replay."""
    keyed = calls.withColumn("key", H.llm_key())
    first = F.struct("attempt")
    return keyed.groupBy("key", *NODE, "call_idx", "request_hash").agg(
        F.min("attempt").alias("first_attempt"),
        (F.count("*") - 1).cast("int").alias("replays"),
        F.min_by("tokens_in", first).alias("tokens_in"),
        F.min_by("tokens_out", first).alias("tokens_out"),
    )


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with the price of the longest prefix of their model, null if there is none.

    Every prefix of a model name is looked up by equal join; models are priced once each, not once a call.
    """
    models = calls.select("model").distinct()
    cuts = models.select("model", F.explode(F.sequence(F.lit(1), F.length("model"))).alias("n")).select("model", F.left("model", F.col("n")).alias("prefix"))
    best = cuts.join(prices, "prefix").groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), F.length("prefix")).alias("p"))
    return calls.join(best.select("model", "p.price_in", "p.price_out"), "model", "left")


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and cost (USD) of priced calls; the cost is null if any call has no price, tokens are kept."""
    cost = F.col("price_in") * F.col("tokens_in").cast("decimal(12,0)") + F.col("price_out") * F.col("tokens_out").cast("decimal(12,0)")
    return calls.groupBy(*by).agg(
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.when(F.bool_or(F.col("price_in").isNull()), None).otherwise((F.sum(cost) / F.lit(1000000)).cast("decimal(24,6)")).alias("cost_usd"),
    )


def wasted_calls(bills: DataFrame, accepted: DataFrame, journaled: DataFrame) -> DataFrame:
    """``wasted`` for each billed call: its node was accepted by another attempt, and the journal does not say that
    this attempt's call was the one replayed."""
    out = bills.join(accepted.select(*NODE, F.col("attempt").alias("accepted_attempt")), NODE, "left")
    out = out.join(journaled.select(*NODE, "call_idx", "request_hash", "first_attempt"), [*NODE, "call_idx", "request_hash"], "left")
    other = F.col("accepted_attempt").isNotNull() & (F.col("accepted_attempt") != F.col("attempt"))
    return out.withColumn("wasted", other & ~F.col("first_attempt").eqNullSafe(F.col("attempt"))).withColumn("replayed", other & F.col("first_attempt").eqNullSafe(F.col("attempt")))


def cut_percent(before: Column, after: Column) -> Column:
    """How much of a cost is saved, in percent; null if there was none."""
    return F.round((before - after) * 100 / F.nullif(before, F.lit(0)), 1)


def surplus_effects(calls: DataFrame) -> DataFrame:
    """Effect calls of each workflow beyond the distinct (name, idx, request) ones, across the runs of its resets."""
    return calls.groupBy("namespace", "workflow_id").agg((F.count("*") - F.count_distinct(F.struct("name", "idx", "request_hash"))).alias("surplus"))
