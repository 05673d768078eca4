"""Best-fit packing of documents into sequences of at most ``size`` tokens, by exact-complement hashing.

Only lengths matter to a packing, and there are at most ``size`` of them. So:

1. one narrow pass makes pieces: a document's token ids end with an end id; only documents longer than ``size`` are
   cut, into full pieces and a rest;
2. pieces are counted by length: a table of at most ``size`` rows, the only thing that reaches the driver;
3. ``plan`` packs the counts into *patterns* (a multiset of lengths, and how many sequences have it). For each length,
   longest first, it looks up lengths that exactly fill the gap: a single, a pair, a triple, in hash tables by their
   sums, and consumes as many as the counts allow at once; what stays over is packed best-fit;
4. each piece gets its rank among the pieces of its length and with it its place in the plan. Ranks are taken in
   buckets by a hash that a number of the row salts, so neither a length nor a document that a third of the pieces
   share makes a large task; the offset of a bucket is a running sum over the counts of the buckets.

Nothing but the plan (bounded by ``size``, not by the input) is broadcast.

Defined results: null text counts as empty and is one piece with the end id alone. Repeated rows are pieces of their
own. An empty table gives no rows. Texts are tokenised whole. Sequence ids are consecutive from 0. Columns other than
``doc_id`` and ``text`` take no part, whatever their names; a null doc_id stays null.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import wordbpe
from tidemark.llm.runtime import begin, durable, sliced

SIZE = 4096
END_ID = 1
_END = END_ID.to_bytes(4, "little")
#: Pieces of one length that a bucket ranks; a bucket is the unit of one sort.
BUCKET_ROWS = 500_000
LEAST_BUCKETS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row for each piece; ``ids array<int>`` as well if asked for. ``salt`` numbers the rows of a task."""
    path = path or wordbpe.default_path()

    def cut(batches):
        begin("wordbpe")
        encode, number = wordbpe.encoder(path).encode, itertools.count()
        for batch in sliced(batches):
            rows, ids_out = [], []
            encoded = encode([t or "" for t in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += _END
                for k, at in enumerate(range(0, len(ids) // 4, size)):
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc, k, at, len(part) // 4, zlib.crc32(part), next(number) & 0x7FFFFFFF))
                    if with_ids:
                        ids_out.append(np.frombuffer(part, "<i4"))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


@dataclass
class Pattern:
    """``times`` sequences that each hold ``parts``: (length, how many)."""

    times: int
    parts: list[tuple[int, int]] = field(default_factory=list)


class Complements:
    """Hash tables from a sum to the single lengths, pairs and triples of available lengths that have it.

    A combination that the counts no longer allow never comes back, since counts only fall. So the entry of a sum is
    made when the sum is first asked for, and what is used up is taken from its end; no entry is cut short.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.free = [0] * (size + 1)
        for length, n in counts.items():
            if not 1 <= length <= size:
                raise ValueError(f"a piece of {length} tokens does not fit sequences of {size}")
            self.free[length] += n
        self.have = np.array(self.free) > 0
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def take(self, parts: list[tuple[int, int]], times: int) -> None:
        for n, k in parts:
            self.free[n] -= times * k
            self.have[n] = self.free[n] > 0

    def enough(self, *lengths: int) -> bool:
        return all(self.free[n] >= lengths.count(n) for n in lengths)

    def _pairs(self, total: int) -> list[int]:
        """The shorter parts of the pairs with this sum, the shortest at the end, where an available pair is."""
        if total not in self.pairs:
            low = np.arange(total // 2, 0, -1)
            self.pairs[total] = low[self.have[low] & self.have[total - low]].tolist()
        parts = self.pairs[total]
        while parts and not self.enough(parts[-1], total - parts[-1]):
            parts.pop()
        return parts

    def _triples(self, total: int) -> list[int]:
        """The first parts of the triples with this sum, the longest at the end."""
        if total not in self.triples:
            self.triples[total] = [n for n in np.flatnonzero(self.have[: total - 1]).tolist() if self._pairs(total - n)]
        parts = self.triples[total]
        while parts and not (self.free[parts[-1]] and self._pairs(total - parts[-1])):
            parts.pop()
        return parts

    def pair(self, total: int, *taken: int) -> tuple[int, ...] | None:
        for n in reversed(self._pairs(total)):
            if self.enough(total - n, n, *taken):
                return total - n, n
        return None

    def fill(self, gap: int, *taken: int) -> tuple[int, ...] | None:
        """One, two or three available lengths whose sum is ``gap``, the longest first, besides those ``taken``."""
        if self.enough(gap, *taken):
            return (gap,)
        if found := self.pair(gap, *taken):
            return found
        for n in reversed(self._triples(gap)):
            if found := self.pair(gap - n, n, *taken):
                return n, *found
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns that hold every piece. Runs on counts alone, so its cost depends on ``size`` and not on the input."""
    sums = Complements(counts, size)
    free, left, out = sums.free, [], []
    if free[size]:
        out.append(Pattern(free[size], [(size, 1)]))
        sums.take([(size, 1)], free[size])
    for length in range(size - 1, 0, -1):
        while free[length] and (found := sums.fill(size - length, length)):
            lengths = (length, *found)
            parts = [(n, lengths.count(n)) for n in dict.fromkeys(lengths)]
            times = min(free[n] // k for n, k in parts)
            sums.take(parts, times)
            out.append(Pattern(times, parts))
        if free[length]:
            left.append(length)
    return out + best_fit({n: free[n] for n in left if free[n]}, size)


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best-fit decreasing on counts: equal lengths go into equal gaps together."""
    by_gap: dict[int, list[Pattern]] = {}
    gaps = np.zeros(size + 1, bool)

    def put(gap: int, pattern: Pattern) -> None:
        by_gap.setdefault(gap, []).append(pattern)
        gaps[gap] = True

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fitting = np.flatnonzero(gaps[length:])
            if not len(fitting):
                each = min(size // length, n)
                times = n // each
                put(size - each * length, Pattern(times, [(length, each)]))
                n -= times * each
                continue
            gap = length + int(fitting[0])
            pattern = by_gap[gap].pop()
            gaps[gap] = bool(by_gap[gap])
            each = min(gap // length, -(-n // pattern.times))
            times = min(pattern.times, n // each)
            if times < pattern.times:
                put(gap, Pattern(pattern.times - times, list(pattern.parts)))
            put(gap - each * length, Pattern(times, [*pattern.parts, (length, each)]))
            n -= times * each
    return [p for patterns in by_gap.values() for p in patterns]


@dataclass(frozen=True)
class Slots:
    """For each length: ranks from ``first`` on have their place in sequences from ``sequence`` on, ``each`` to a
    sequence, at ``offset``."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, each, offset = self.by_length[length]
        slot = np.searchsorted(first, rank, "right") - 1
        turn, inside = np.divmod(rank - first[slot], each[slot])
        return sequence[slot] + turn, offset[slot] + inside * length


def slots(patterns: list[Pattern]) -> Slots:
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for p in patterns:
        offset = 0
        for length, each in p.parts:
            rows.setdefault(length, []).append((taken.get(length, 0), base, each, offset))
            taken[length] = taken.get(length, 0) + p.times * each
            offset += length * each
        base += p.times
    return Slots({n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in rows.items()}, base)


def assign(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset`` and without ``salt``; needs ``doc_id, piece, length, ids_crc32, salt``
    in a table that does not change, since it is read several times."""
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    placed = slots(plan(counts, size))
    buckets = max(LEAST_BUCKETS, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    salted = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(buckets)))
    # Buckets of a length, in order, with the number of pieces before each: sums of counts, at most size x buckets rows.
    sums = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = salted.withColumn("_rank", F.row_number().over(within)).join(before, ["length", "_bucket"])
    kept = [f for f in parts.schema if f.name != "salt"]
    rows = ranked.select(*(f.name for f in kept), (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def put(batches):
        for batch in batches:
            names = batch.schema.names[:-1]
            length, rank = (np.asarray(batch.column(batch.schema.names.index(c))) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for group in np.split(order, cuts) if len(order) else ():
                sequence[group], offset[group] = placed.place(int(length[group[0]]), rank[group])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return rows.mapInArrow(put, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Contract rows: each piece of each document with its place."""
    return assign(durable(pieces(docs, path, size)), size)
