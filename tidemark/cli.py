"""Commands over a ledger kept as Parquet folders: ``python -m tidemark.cli STORE COMMAND ...``.

A store is a folder with the relations of ``model``, and what the service tells: ``history`` and ``states`` for repair,
``workflows`` and ``namespaces`` for collection. Tables lie in versions of their own; a command that changes several of
them commits all at once by one manifest (``sources.manifest``), so a crash leaves either all old or all new. A plain
folder named as a table is read as long as no version of it was committed.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config, model
from tidemark.operators import effects, materialize, reconcile, storage, views
from tidemark.sources.manifest import Manifest

#: Modules whose queries ``bench`` times.
FAMILIES = ("fencing", "repair", "reading", "storing", "spending", "relational", "streams", "filing")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, self.path)

    def has(self, name: str) -> bool:
        return name in self.manifest.read().parts or self.manifest.exists(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest.read().parts.get(name, name)}")

    def replace(self, **tables: DataFrame) -> None:
        """All tables are written before the manifest names them, so they may be made of each other's old contents.
        Versions before the last two are removed."""
        parts = {name: self.manifest.fresh(f"_versions/{name}") for name in tables}
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/{parts[name]}")
        self.manifest.commit(parts)
        self.manifest.sweep([f"_versions/{name}" for name in tables])


def init(store: Store, args) -> DataFrame:
    """Empty relations where there are none, and the schema version; what is there stays."""
    missing = [n for n in model.RELATIONS if not store.has(n)]
    version = store.spark.range(1).selectExpr("'schema_version' AS key", f"'{model.SCHEMA_VERSION}' AS value")
    if missing:
        store.replace(**{n: version if n == "meta" else model.empty(store.spark, n) for n in missing})
    return store.read("meta")


def status(store: Store, args) -> DataFrame:
    return views.status(store.read("runs"), args.limit).select(*model.RUN, "status", "first_seen_at", "degraded")


def ledger(store: Store, args) -> DataFrame:
    """Header, nodes and effects of a run; of the latest run if none is named."""
    runs = store.read("runs").where(F.col("workflow_id") == args.workflow)
    runs = runs.where(F.col("run_id") == args.run) if args.run else views.latest_runs(runs)
    mine = lambda name: store.read(name).join(F.broadcast(runs.select(*model.RUN)), model.RUN, "left_semi")
    log = mine("attempts").withColumnRenamed("id", "arrival")
    lines = views.run_ledger(runs, log, mine("nodes"), mine("effects"))
    return lines.orderBy(*model.RUN, "part", "seq").select("run_id", "line")


def resolve(store: Store, args) -> DataFrame:
    decisions = store.spark.range(1).select(F.lit(args.key).alias("key"), F.lit(args.outcome).alias("outcome"), F.lit(args.result).alias("result"))
    store.replace(effects=effects.resolve(store.read("effects"), decisions, F.current_timestamp()))
    return store.read("effects").where(F.col("key") == args.key).select("key", "status", "resolution")


def repair(store: Store, args) -> DataFrame:
    """``history``: a row for each scheduled node; ``states``: run key, ``status``, ``found``, ``closed`` and, if known,
    ``workflow_type`` and ``final_state_hash``.

    Rows, run rows (those of runs that the ledger had not seen are added), audit rows and the report are committed
    together. A second pass finds what the first one sealed and says so.
    """
    states, ledger_runs = store.read("states"), store.read("runs")
    if args.workflow:
        states = states.where(F.col("workflow_id") == args.workflow)
    known = ledger_runs.select(*model.RUN, F.col("sealed_at").isNotNull().alias("sealed"), "degraded")
    now = F.lit(store.spark.sql("SELECT current_timestamp()").first()[0])
    done = reconcile.reconcile(store.read("history"), store.read("nodes"), states.join(known, model.RUN, "left").na.fill(False, ["sealed", "degraded"]), args.include_open, now)
    store.replace(
        report=done.report, nodes=done.rows, runs=_runs_after(ledger_runs, states, done, now, args.include_open), attempts=_attempts_after(store.read("attempts"), done.audits, now)
    )
    return store.read("report")


def _runs_after(runs: DataFrame, states: DataFrame, done: reconcile.Reconciled, now, include_open: bool) -> DataFrame:
    """Run rows with the seals of a pass in them."""
    seen = states.where(F.col("found") & (F.col("closed") | F.lit(include_open))).select(*model.RUN, *(F.col(c).alias(f"_{c}") for c in ("workflow_type",) if c in states.columns))
    seals = done.seals.where("NOT refused").select(*model.RUN, F.struct([c for c in done.seals.columns if c not in model.RUN]).alias("_seal"))
    both = runs.withColumn("_there", F.lit(True)).join(seen.withColumn("_seen", F.lit(True)), model.RUN, "full_outer").join(seals, model.RUN, "left")
    sealed, types = F.col("_seal").isNotNull(), {f.name: f.dataType for f in runs.schema}
    told = F.col("_workflow_type") if "workflow_type" in states.columns else F.lit(None).cast("string")
    values = {c: F.when(sealed, F.col(f"_seal.{c}")).otherwise(F.col(c)) for c in ("status", "node_count", "committed_count", "abandoned_count", "sealed_at", "sealed_by", "missing_seqs")}
    values["status"] = F.coalesce(values["status"], F.lit("RUNNING"))
    values["final_state_hash"] = F.when(sealed, F.col("_seal.final_state_hash")).otherwise(F.col("final_state_hash"))
    values["degraded"] = F.coalesce("degraded", F.lit(False)) | F.coalesce("_seal.degraded", F.lit(False))
    values["first_seen_at"] = F.coalesce("first_seen_at", now)
    values["workflow_type"] = F.coalesce("workflow_type", told)
    return both.where("_there OR _seen").select(*(values.get(c, F.col(c)).cast(types[c]).alias(c) for c in runs.columns))


def _attempts_after(attempts: DataFrame, audits: DataFrame, now) -> DataFrame:
    """The audit trail with the rows of a pass; their ids follow the largest one, unique and not dense."""
    last = attempts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = {"id": F.lit(last) + 1 + F.monotonically_increasing_id(), "worker": F.lit("reconcile"), "at": now}
    new = audits.select(*((made[f.name] if f.name in made else F.col(f.name) if f.name in audits.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in attempts.schema))
    return attempts.unionByName(new)


def gc(store: Store, args) -> DataFrame:
    """Counts of what a sweep takes; it is taken with ``--execute`` only. A retention shorter than the namespace's own is
    refused: a closed workflow could still be read after its payloads are gone."""
    if store.has("namespaces"):
        own = store.read("namespaces").where(F.col("namespace") == args.namespace).agg(F.max("retention_days")).first()[0]
        problem = config.check_retention(args.retention_days, own) if own is not None else None
        if problem:
            raise ValueError(problem)
    times = storage.Times.of(F.lit(store.spark.sql("SELECT current_timestamp()").first()[0]), args.retention_days, args.margin_days, args.grace_hours, args.orphan_ref_days)
    swept = storage.sweep(
        store.read("payload_refs"), store.read("payloads"), store.read("chunks"), store.read("workflows"), times.touched_before, times.cutoff, times.orphan_cutoff, args.namespace, only=args.only or None
    )
    rows = swept.report.collect()  # one row
    if args.execute:
        store.replace(payload_refs=swept.refs, payloads=swept.payloads, chunks=swept.chunks)
    return store.spark.createDataFrame(rows, swept.report.schema)


def state(store: Store, args) -> DataFrame:
    reducers = dict(pair.split("=", 1) for pair in args.channel)
    runs = store.read("runs").where(F.col("workflow_id") == args.workflow)
    about = runs.select(*model.RUN, F.unix_micros("first_seen_at").alias("run_rank"), F.col("sealed_at").isNotNull().alias("sealed"), "final_state_hash", "node_count")
    nodes = store.read("nodes").select(*model.NODE, F.col("lg_step").alias("step"), F.col("lg_path").alias("path"), "kind", "status", "output_json", "input_snapshot", "input_hash", "graph")
    rows = nodes.join(about, model.RUN)
    if args.run:
        rows = rows.join(about.where(F.col("run_id") == args.run).select(F.col("run_rank").alias("_last")), F.col("run_rank") <= F.col("_last")).drop("_last")
        rows = rows if args.chain else rows.where(F.col("run_id") == args.run)
    return materialize.fold(rows, reducers, args.chain, False, args.include_provisional, args.graph)


def bench(store: Store, args) -> DataFrame:
    """Seconds of queries over a folder of tables (here ``store`` is that folder); all of them if none is named."""
    known = {n: q for f in FAMILIES for n, q in importlib.import_module(f"tidemark.plans.{f}").R.queries.items()}
    rows = []
    for name in args.query or sorted(known):
        start = time.perf_counter()
        known[name](store.spark, store.path).write.format("noop").mode("overwrite").save()
        rows.append((name, round(time.perf_counter() - start, 3)))
    return store.spark.createDataFrame(rows, "query string, seconds double")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    top.add_argument("store")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple[str, dict]) -> None:
        sub = commands.add_parser(name)
        sub.set_defaults(call=run)
        for flag, options in arguments:
            sub.add_argument(flag, **options)

    known = config.load()
    number = lambda kind, n: {"type": kind, "default": n}
    flag, several = {"action": "store_true"}, {"action": "append", "default": []}
    command("init-db", init)
    command("status", status, ("--limit", number(int, 20)))
    command("ledger", ledger, ("workflow", {}), ("--run", {}))
    command("resolve", resolve, ("key", {}), ("outcome", {"choices": ["done", "not-done"]}), ("--result", {}))
    command("reconcile", repair, ("--workflow", {}), ("--include-open", flag))
    times = [(f"--{n.replace('_', '-')}", number(float, getattr(known, n))) for n in ("retention_days", "margin_days", "grace_hours", "orphan_ref_days")]
    command("gc", gc, *times, ("--namespace", {"default": known.namespace}), ("--only", several), ("--execute", flag))
    command("materialize", state, ("workflow", {}), ("--channel", {**several, "help": "name=append|last|sum|merge_by_id"}), ("--run", {}), ("--chain", flag), ("--include-provisional", flag), ("--graph", {}))
    command("bench", bench, ("query", {"nargs": "*"}))
    return top


def main(argv: list[str], spark: SparkSession | None = None) -> DataFrame:
    args = parser().parse_args(argv)
    shown = args.call(Store(spark or SparkSession.builder.getOrCreate(), args.store), args)
    shown.show(1000, truncate=False)
    return shown


if __name__ == "__main__":
    main(sys.argv[1:])
