"""Payload storage: chunks by content, manifests, references, reassembly, and collection of what nobody needs."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import RUN
from tidemark.streaming.jobs import written

MAX_PAYLOAD = 256 << 20
#: Encodings whose payloads are cut into chunks; others are stored whole.
CHUNKED = ("json/plain", "json/protobuf", "binary/plain")


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """256 random 64-bit numbers, from a fixed seed."""
    rng = random.Random(20160623)
    return np.array([rng.getrandbits(64) for _ in range(256)], np.uint64)


def boundaries(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks, as in FastCDC (Xia et al., USENIX ATC 2016): a gear hash over the bytes, a
    stricter mask before the average size and a looser one after it.

    The gear hash forgets a byte after 64 steps, so it is computed for all positions at once; only the walk from cut
    to cut is a loop.
    """
    n = len(data)
    if n <= least:
        return [n]
    values = gear()[np.frombuffer(data, np.uint8)]
    rolled = values.copy()
    span = 1
    while span < 64:  # doubling: the hash of 2k bytes from two hashes of k bytes
        rolled[span:] += rolled[:-span].copy() << np.uint64(span)
        span *= 2
    bits = average.bit_length() - 1
    strict = np.flatnonzero(rolled >> np.uint64(64 - bits - 1) == 0)
    loose = np.flatnonzero(rolled >> np.uint64(64 - bits + 1) == 0)
    ends, start = [], 0
    while n - start > least:
        def first(hits: np.ndarray, low: int, high: int) -> int | None:
            at = int(np.searchsorted(hits, low))
            return int(hits[at]) + 1 if at < len(hits) and hits[at] < high else None

        middle, end = min(start + average, n), min(start + most, n)
        cut = first(strict, start + least, middle) or first(loose, max(middle, start + least), end) or end
        ends.append(cut)
        start = cut
    if start < n:
        ends.append(n)
    return ends


def chunk(data: bytes, least: int = 4096, average: int = 16384, most: int = 65536) -> list[bytes]:
    """Chunks of one payload; an empty payload is one empty chunk."""
    ends = boundaries(data, least, average, most)
    return [data[a:b] for a, b in zip([0, *ends], ends)] or [b""]


def cut(payloads: DataFrame, least: int = 4096, average: int = 16384, most: int = 65536, dedupe: bool = True) -> DataFrame:
    """``claim, position, hash, data, size`` of every chunk of every distinct payload in ``payloads(claim, data
    binary, encoding)``. Encodings that are not known to repeat inside are kept whole; payloads over the limit are
    refused with an error."""

    def run(batches):
        for batch in batches:
            rows = []
            for claim, data, encoding in zip(*(c.to_pylist() for c in batch.columns)):
                data = data or b""
                if len(data) > MAX_PAYLOAD:
                    raise ValueError(f"payload {claim} has {len(data)} bytes, more than {MAX_PAYLOAD}")
                parts = chunk(data, least, average, most) if dedupe and encoding in CHUNKED else [data]
                rows += [(claim, i, hashlib.sha256(p).digest(), p, len(p)) for i, p in enumerate(parts)]
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["claim", "position", "hash", "data", "size"])

    chosen = payloads.select("claim", "data", "encoding")
    return chosen.mapInArrow(run, "claim string, position int, hash binary, data binary, size long")


def cut_fixed(payloads: DataFrame, length: int) -> DataFrame:
    """The same rows with chunks of a fixed number of characters, in the JVM; for texts."""
    many = F.greatest(F.lit(1), F.ceil(F.length("data") / F.lit(length)).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(F.col("data"), i * length + 1, F.lit(length)))
    whole = F.when(F.col("encoding").isin(*CHUNKED), pieces).otherwise(F.array("data"))
    out = payloads.select("claim", F.posexplode(whole).alias("position", "data"))
    return out.select("claim", "position", F.sha2("data", 256).alias("hash"), "data", F.octet_length("data").cast("bigint").alias("size"))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each chunk, however many payloads have it."""
    return chunks.groupBy("hash").agg(F.any_value("data").alias("data"), F.first("size").alias("size"))


def manifests(chunks: DataFrame) -> DataFrame:
    """``claim, chunks, size``: the ordered chunk list of each payload."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "hash")))
    return chunks.groupBy("claim").agg(F.transform(ordered, lambda s: s["hash"]).alias("chunks"), F.sum("size").alias("size"))


def new_chunks(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks that the store lacks; their sizes add up to the new bytes of a put."""
    return distinct_chunks(chunks).join(known.select("hash"), "hash", "left_anti")


def references(log: DataFrame) -> DataFrame:
    """References, one for each claim and run: created first, touched last. Unknown targets are empty strings."""
    key = ["claim", *RUN]
    clean = log.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("workflow_id", "run_id")})
    return clean.groupBy(*key).agg(F.min("created_at").alias("created_at"), F.max("last_ref_at").alias("last_ref_at"))


def touched(log: DataFrame) -> DataFrame:
    """When each payload was stored first and referred to last."""
    return log.groupBy("claim").agg(F.min("created_at").alias("created_at"), F.max("last_ref_at").alias("last_ref_at"))


def retrieve(manifests_: DataFrame, chunks: DataFrame) -> DataFrame:
    """``claim, data, problem``: payloads put together from their chunks in order. A payload with a missing chunk, or
    whose hash is not its claim, has a problem and no data."""
    wanted = manifests_.select("claim", F.posexplode("chunks").alias("position", "hash"))
    found = wanted.join(chunks.select("hash", F.col("data").cast("binary").alias("data"), F.lit(True).alias("there")), "hash", "left")
    whole = F.coalesce(F.expr("listagg(data) WITHIN GROUP (ORDER BY position)"), F.lit(b""))  # linear in the payload
    out = found.groupBy("claim").agg(F.count_if(F.col("there").isNull()).alias("missing"), whole.alias("data"))
    problem = F.when(F.col("missing") > 0, "missing chunk").when(F.sha2("data", 256) != F.col("claim"), "hash differs")
    return out.select("claim", F.when(problem.isNull(), F.col("data")).alias("data"), problem.alias("problem"))


def fetch(manifests_: DataFrame, chunks: DataFrame, delimiter: str = "") -> DataFrame:
    """``claim, data``: texts put together from their chunks through the manifests; chunks that are missing are left out,
    and nothing is checked (``retrieve`` checks)."""
    wanted = manifests_.select("claim", F.posexplode("chunks").alias("position", "hash"))
    joined = F.expr(f"listagg(data, '{delimiter}') WITHIN GROUP (ORDER BY position)")
    return wanted.join(chunks.select("hash", F.col("data").cast("string").alias("data")), "hash").groupBy("claim").agg(joined.alias("data"))


def externalize(payloads: DataFrame, threshold: int) -> DataFrame:
    """Payloads that go to the store: those of at least ``threshold`` bytes, so a payload of exactly the threshold goes."""
    return payloads.where(F.octet_length("data") >= threshold)


def metrics(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counters of a log that is put into an empty store: see ``_counters``."""
    met = log.groupBy("claim").agg(*_seen())
    unique = distinct_chunks(chunks).select("size")
    return _counters(met.withColumn("fresh", F.lit(True)), unique)


def _seen() -> list[Column]:
    """What a log says of a claim."""
    return [
        F.count("*").alias("stores"),
        F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("bigint").alias("bytes"),
        F.min_by("encoding", "id").alias("encoding"),
        F.min("created_at").alias("created_at"),
        F.max("last_ref_at").alias("last_ref_at"),
    ]


def _counters(met: DataFrame, new: DataFrame) -> DataFrame:
    """One row: payloads handed over, those that the store (or an earlier row) had, bytes handed over, bytes of new
    chunks, bytes that needed none, and payloads kept whole. ``new`` holds the sizes of new chunks."""
    long = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    whole = F.col("fresh") & ~F.coalesce(F.col("encoding").isin(*CHUNKED), F.lit(False))
    of_log = met.select("stores", (F.col("stores") - F.col("fresh").cast("int")).alias("dedupe_hits"), F.col("bytes").alias("logical_bytes"), whole.cast("int").alias("opaque"), F.lit(0).alias("unique_bytes"))
    rows = of_log.unionAll(new.select(F.lit(0), F.lit(0), F.lit(0), F.lit(0), "size"))
    total = rows.agg(*(long(F.sum(c)).alias(c) for c in of_log.columns))
    return total.withColumn("deduped_bytes", F.col("logical_bytes") - F.col("unique_bytes"))


@dataclass(frozen=True)
class Put:
    """The store after a put, and what the put did: ``cut`` holds the chunks of payloads that the store lacked, ``deltas``
    how much more often a chunk is listed by manifests, ``counters`` one row (see ``_counters``)."""

    refs: DataFrame
    payloads: DataFrame
    chunks: DataFrame
    cut: DataFrame
    deltas: DataFrame
    counters: DataFrame


def put(log: DataFrame, refs: DataFrame, payloads: DataFrame, chunks: DataFrame, cutter: Callable[[DataFrame], DataFrame] = cut) -> Put:
    """Put ``log(id, claim, data, encoding, namespace, workflow_id, run_id, created_at, last_ref_at)`` into a store.

    Claims meet the stored manifests before anything is cut: a known payload adds a reference and touches its manifest
    and chunks, and its bytes are neither cut nor shuffled when the unknown claims are few. These are written first, so
    Spark knows their size when it chooses between a broadcast and a shuffle. Rows of one claim hold the same data; the
    row of the smallest ``id`` gives the encoding. An empty log changes nothing.
    """
    stored = payloads.select("claim", F.lit(True).alias("_stored"))
    met = written(log.groupBy("claim").agg(*_seen()).join(stored, "claim", "left").withColumn("fresh", F.col("_stored").isNull()).drop("_stored"))
    fresh, hits = met.where("fresh"), met.where("NOT fresh").select("claim", F.col("last_ref_at").alias("_at"))
    lacking = written(fresh.select("claim", "encoding"))
    data = log.select("claim", "data").join(lacking.select("claim"), "claim", "left_semi").groupBy("claim").agg(F.any_value("data").alias("data"))
    parts = written(cutter(data.join(lacking, "claim")))

    of_fresh = fresh.select("claim", "encoding", "created_at", "last_ref_at")
    lists = manifests(parts).join(of_fresh, "claim").withColumn("deduped", F.coalesce(F.col("encoding").isin(*CHUNKED), F.lit(False)))
    bumped = payloads.join(hits, "claim", "left").withColumn("last_ref_at", F.greatest("last_ref_at", "_at")).drop("_at")
    after = bumped.unionByName(lists.select(*[c for c in lists.columns if c in payloads.columns]), allowMissingColumns=True)

    new = written(parts.groupBy("hash").agg(F.first("size").alias("size")).join(chunks.select("hash"), "hash", "left_anti"))
    again = payloads.select("claim", "chunks").join(hits, "claim").select(F.explode("chunks").alias("hash"), F.col("_at").alias("last_ref_at"))
    seen = parts.select("claim", "hash").join(of_fresh, "claim").select("hash", "created_at", "last_ref_at").unionByName(again, allowMissingColumns=True)
    seen = written(seen.groupBy("hash").agg(F.min("created_at").alias("_made"), F.max("last_ref_at").alias("_at")))
    touched_ = chunks.join(seen.select("hash", "_at"), "hash", "left").withColumn("last_ref_at", F.greatest("last_ref_at", "_at")).drop("_at")
    rows = distinct_chunks(parts.join(new.select("hash"), "hash", "left_semi")).join(seen, "hash").withColumnsRenamed({"_made": "created_at", "_at": "last_ref_at"})
    rows = touched_.unionByName(rows.select(*[c for c in rows.columns if c in chunks.columns]), allowMissingColumns=True)
    all_refs = refs.select("claim", *RUN, "created_at", "last_ref_at").unionByName(log.select("claim", *RUN, "created_at", "last_ref_at"))
    return Put(references(all_refs), after, rows, parts, count_deltas(lists), _counters(met, new.select("size")))


def run_bytes(refs: DataFrame, payloads: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each run: its payloads, their bytes stored whole, and the bytes of their distinct chunks.

    A run has what refers to it and what refers to its workflow without a run (the input it was started with). What both
    have counts once: bytes of the run, and of the workflow, less those that they share, so nothing is copied to the runs
    of a workflow.
    """
    owned = refs.select("claim", *RUN).distinct().join(payloads.select("claim", "chunks", F.col("size").alias("_whole")), "claim")
    whole = owned.select(*RUN, F.lit("payload").alias("what"), F.col("claim").cast("binary").alias("item"), F.col("_whole").cast("bigint").alias("size"))
    listed = owned.select(*RUN, F.explode(F.array_distinct("chunks")).alias("hash")).distinct().join(chunks.select("hash", "size"), "hash")
    items = whole.unionAll(listed.select(*RUN, F.lit("chunk"), F.col("hash").cast("binary"), F.col("size").cast("bigint")))
    flow = ["namespace", "workflow_id"]
    common = items.where("run_id = ''").select(*flow, "what", "item", F.lit(True).alias("_shared"))
    both = items.join(common, [*flow, "what", "item"], "left")
    own = (F.col("run_id") == "") | F.col("_shared").isNull()  # a run's own items, the workflow's in its row without a run
    of = lambda what, value: F.coalesce(F.sum(F.when(own & (F.col("what") == what), value)), F.lit(0)).cast("bigint")
    sums = both.groupBy(*RUN).agg(of("payload", F.lit(1)).alias("payloads"), of("payload", F.col("size")).alias("whole_bytes"), of("chunk", F.col("size")).alias("unique_bytes"))
    names = ("payloads", "whole_bytes", "unique_bytes")
    start = sums.where("run_id = ''").select(*flow, *(F.col(n).alias(f"_{n}") for n in names))
    more = F.when(F.col("run_id") == "", F.lit(0))
    return sums.join(start, flow, "left").select(*RUN, *((F.col(n) + F.coalesce(more, F.col(f"_{n}"), F.lit(0))).alias(n) for n in names))


# --- collection -----------------------------------------------------------------------------------------------------


def workflow_verdicts(refs: DataFrame, states: DataFrame, cutoff: Column, namespace: str, only: list[str] | None = None) -> DataFrame:
    """``workflow_id, verdict`` of each workflow that refers to a payload: open, retained, expired, schedule, skipped
    (another namespace).

    A workflow that the service does not know is judged by its firings, workflows named ``<id>-...``: an open one keeps
    it open, one closed after the cutoff retains it. Firings are found by equi join on every prefix of their ids.
    """
    ids = refs.where("workflow_id <> ''").select("namespace", "workflow_id").distinct()
    if only is not None:
        ids = ids.where(F.col("workflow_id").isin(*only))
    parts = F.split("workflow_id", "-")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-")))
    is_open = F.col("status") == "RUNNING"
    retained = F.col("close_time") > cutoff
    firings = (
        states.select(F.explode(prefixes).alias("workflow_id"), is_open.alias("o"), F.coalesce(retained, F.lit(False)).alias("r"))
        .groupBy("workflow_id").agg(F.bool_or("o").alias("firing_open"), F.bool_or("r").alias("firing_retained"))
    )
    own = states.select("workflow_id", F.lit(True).alias("known"), is_open.alias("is_open"), retained.alias("retained"), "is_schedule_action")
    out = ids.join(own, "workflow_id", "left").join(firings, "workflow_id", "left")
    verdict = (
        F.when(F.col("namespace") != namespace, "skipped")
        .when(F.coalesce("is_schedule_action", F.lit(False)), "schedule")
        .when(F.col("known") & F.col("is_open"), "open")
        .when(F.col("known") & F.col("retained"), "retained")
        .when(F.col("known"), "expired")
        .when(F.col("firing_open"), "open")
        .when(F.col("firing_retained"), "retained")
        .otherwise("expired")
    )
    return out.select("namespace", "workflow_id", verdict.alias("verdict"))


def expired_refs(refs: DataFrame, verdicts: DataFrame, touched_before: Column, cutoff: Column, orphan_cutoff: Column, orphans: bool = True) -> DataFrame:
    """References that may go: of expired workflows, untouched since the grace and made before the cutoff; and those
    without a workflow once they are old enough."""
    gone = verdicts.where("verdict = 'expired'").select("namespace", "workflow_id").withColumn("_gone", F.lit(True))
    out = refs.join(gone, ["namespace", "workflow_id"], "left")
    old = F.col("_gone") & (F.col("last_ref_at") < touched_before) & (F.col("created_at") < cutoff)
    lost = F.lit(orphans) & (F.col("workflow_id") == "") & (F.col("last_ref_at") < orphan_cutoff)
    return out.where(F.coalesce(old, F.lit(False)) | lost).select(*refs.columns)


def dead_manifests(payloads: DataFrame, refs: DataFrame, expired: DataFrame, touched_before: Column) -> DataFrame:
    """Payloads untouched since the grace that no live reference names."""
    live = refs.join(expired.select("claim", *RUN), ["claim", *RUN], "left_anti").select("claim")
    return payloads.where(F.col("last_ref_at") < touched_before).join(live, "claim", "left_anti")


def dead_chunks(chunks: DataFrame, payloads: DataFrame, dead: DataFrame, touched_before: Column) -> DataFrame:
    """Chunks untouched since the grace that no live payload lists: the lists are exploded and joined by equality."""
    live = payloads.join(dead.select("claim"), "claim", "left_anti").select(F.explode("chunks").alias("hash"))
    return chunks.where(F.col("last_ref_at") < touched_before).join(live, "hash", "left_anti")


def count_deltas(lists: DataFrame, sign: int = 1) -> DataFrame:
    """``hash, delta``: how many of these manifests list a chunk; with ``sign=-1`` they go."""
    return lists.select(F.explode(F.array_distinct("chunks")).alias("hash")).groupBy("hash").agg((F.count("*") * sign).alias("delta"))


def counted(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """``hash, listed`` after the deltas; chunks that nothing lists stay, with 0, until a sweep takes them."""
    both = counts.select("hash", "listed").unionAll(deltas.select("hash", "delta"))
    return both.groupBy("hash").agg(F.sum("listed").alias("listed"))


def unlisted_chunks(chunks: DataFrame, counts: DataFrame, touched_before: Column) -> DataFrame:
    """Chunks untouched since the grace that are counted 0 times. A chunk without a count is not judged: it stays."""
    return chunks.where(F.col("last_ref_at") < touched_before).join(counts.where("listed <= 0").select("hash"), "hash", "left_semi")


@dataclass(frozen=True)
class Times:
    """When a sweep that starts at ``now`` lets things go: untouched since ``touched_before``, made and closed before
    ``cutoff`` (retention and a margin ago), without a workflow and untouched since ``orphan_cutoff``."""

    touched_before: Column
    cutoff: Column
    orphan_cutoff: Column

    @classmethod
    def of(cls, now: Column, retention_days: float, margin_days: float, grace_hours: float, orphan_ref_days: float) -> Times:
        ago = lambda days: now - F.make_dt_interval(secs=F.lit(round(days * 86400, 3)))
        return cls(ago(grace_hours / 24), ago(retention_days + margin_days), ago(orphan_ref_days))


@dataclass(frozen=True)
class Swept:
    """What a sweep leaves, and ``report``: one row of counts of what it takes. ``lost`` are the chunks that go (``hash,
    size``), ``counts`` the reference counts after the sweep, if it was given some."""

    refs: DataFrame
    payloads: DataFrame
    chunks: DataFrame
    report: DataFrame
    lost: DataFrame
    counts: DataFrame | None = None


def sweep(refs: DataFrame, payloads: DataFrame, chunks: DataFrame, states: DataFrame, touched_before: Column, cutoff: Column, orphan_cutoff: Column, namespace: str = "default", orphans: bool = True, only: list[str] | None = None, counts: DataFrame | None = None) -> Swept:
    """References of expired workflows go, then payloads that nothing refers to, then chunks that no payload lists.

    What goes is written once, so the report of a dry run, which leaves the tables as they are, is that of the sweep.
    With ``only``, references of these workflows may go and no others, orphans included.

    With ``counts(hash, listed)``, kept by every put and sweep of the store, only the lists of payloads that go are
    opened; without, those of all payloads that stay.
    """
    verdicts = workflow_verdicts(refs, states, cutoff, namespace, only)
    gone = written(expired_refs(refs, verdicts, touched_before, cutoff, orphan_cutoff, orphans and only is None))
    dead = written(dead_manifests(payloads, refs, gone, touched_before).select("claim"))
    if counts is None:
        unlisted = dead_chunks(chunks, payloads, dead, touched_before)
    else:
        counts = written(counted(counts, count_deltas(payloads.join(dead, "claim", "left_semi"), -1)))
        unlisted = unlisted_chunks(chunks, counts, touched_before)
    lost = written(unlisted.select("hash", "size"))
    tagged = gone.select(F.when(F.col("workflow_id") == "", "orphan").otherwise("ref").alias("what"), F.lit(0).cast("long").alias("size"))
    tagged = tagged.unionAll(dead.select(F.lit("manifest"), F.lit(0).cast("long"))).unionAll(lost.select(F.lit("chunk"), F.col("size").cast("long")))
    count = lambda what, name: F.count_if(F.col("what") == what).alias(name)
    names = {"ref": "refs_expired", "orphan": "orphan_refs_expired", "manifest": "manifests_deleted", "chunk": "chunks_deleted"}
    report = tagged.agg(*(count(w, n) for w, n in names.items()), F.coalesce(F.sum("size"), F.lit(0)).alias("chunk_bytes_deleted"))
    key = ["claim", *RUN]
    left = counts.join(lost.select("hash"), "hash", "left_anti") if counts is not None else None
    stay = (refs.join(gone.select(*key), key, "left_anti"), payloads.join(dead, "claim", "left_anti"), chunks.join(lost.select("hash"), "hash", "left_anti"))
    return Swept(*stay, report, lost, left)
