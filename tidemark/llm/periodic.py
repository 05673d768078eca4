"""Periodic runs of words: stretches that repeat their first words at least three times over.

For every period q the document has a grid of points; it is as coarse as can be while each run of the least length has
a point g with both g and g + q inside. That makes n log n pairs (q, g) for n words. All pairs are tested at once:
equal words, then equal prefix hashes of half the least length on one side, then two binary searches for the longest
common extensions of g and g + q, to the right and to the left. The stretches found are compared word by word, and of
equal stretches the one with the smallest period stays. If a comparison fails (two hashes met), the period is worked
out from the words themselves, so results never depend on hashes.

One narrow pass; a document lives in one task only while its row is made, pairs are made ``PAIRS`` at a time.

Defined results: a null text has no words, no runs and the digests of nothing. Repeated rows get equal results; a null
doc_id is never folded. ``doc_id`` of any whole type is taken as long. Other columns of the input are not read by
``periodic_runs`` and ``run_digests``, and kept by ``collapse``.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import sliced

#: Words that a run has at least, and how many times its period.
LEAST, TIMES = 24, 3
#: Pairs of period and grid point in memory at a time.
PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros((0, 3), np.int64)


@dataclass
class Prefixes:
    """Hashes of all prefixes, as sums of word value times base to the power of the place (modulo 2^64)."""

    sums: np.ndarray
    powers: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray) -> Prefixes:
        values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        powers = np.full(len(ids) + 1, _BASE)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum((values ^ (values >> np.uint64(32))) * powers[:-1], out=sums[1:])
        return cls(sums, powers)

    def same(self, at: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``at`` hash as those ``apart`` words further on."""
        first = (self.sums[at + length] - self.sums[at]) * self.powers[apart]
        return first == self.sums[at + apart + length] - self.sums[at + apart]


def _longest(fits, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Binary search of all pairs at once for the greatest length in least..most that fits (least does)."""
    low, high = least.copy(), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        ok = fits(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def _smallest_periods(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) with the smallest period of each (start, end), in the order of start and period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def _stretches(ids: np.ndarray, q: int, least: int) -> np.ndarray:
    """All maximal stretches of period q with at least ``least`` words, from the words themselves."""
    same = np.concatenate(([False], ids[:-q] == ids[q:], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, end = edges[::2], edges[1::2] + q
    keep = end - start >= least
    return np.stack([start[keep], end[keep], np.full(int(keep.sum()), q)], axis=1)


def _holds(ids: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether a stretch has the period and neither neighbour keeps it."""
    inside = np.array_equal(ids[start : end - q], ids[start + q : end])
    return inside and (start == 0 or ids[start - 1] != ids[start - 1 + q]) and (end == len(ids) or ids[end] != ids[end - q])


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``ids``, by start, then period. A run is a maximal stretch with that
    smallest period and at least max(``least``, ``times`` x period) words; ``times`` is 2 at least."""
    n = len(ids)
    if n < max(least, times):
        return _NONE
    hashes = Prefixes.of(ids)
    periods = np.arange(1, n // times + 1)
    needed = np.maximum(least, times * periods)
    step = needed - periods
    points = (n - 1 - periods) // step + 1
    ends = np.cumsum(points)
    found, low = [_NONE], 0
    while low < len(periods):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        which = np.repeat(np.arange(low, high), points[low:high])
        first = ends[low:high] - points[low:high] - (ends[low - 1] if low else 0)
        g = (np.arange(len(which)) - first[which - low]) * step[which]
        q = periods[which]
        keep = ids[g] == ids[g + q]
        g, q, which = g[keep], q[keep], which[keep]
        half = (step[which] + 1) // 2
        ahead = g + q + half <= n
        ahead[ahead] = hashes.same(g[ahead], q[ahead], half[ahead])
        behind = g >= half
        behind[behind] = hashes.same((g - half)[behind], q[behind], half[behind])
        keep = ahead | behind
        g, q, which = g[keep], q[keep], which[keep]
        right = _longest(lambda m: hashes.same(g, q, m), np.ones_like(g), n - g - q)
        left = _longest(lambda m: hashes.same(g - m, q, m), np.zeros_like(g), g)
        keep = left + right + q >= needed[which]
        found.append(_smallest_periods(np.stack([(g - left)[keep], (g + q + right)[keep], q[keep]], axis=1)))
        low = high
    runs = _smallest_periods(np.concatenate(found))
    wrong = {int(q) for s, e, q in runs.tolist() if not _holds(ids, s, e, q)}
    if wrong:
        right = [_stretches(ids, q, max(least, times * q)) for q in wrong]
        runs = _smallest_periods(np.concatenate([runs[~np.isin(runs[:, 2], list(wrong))], *right]))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """Start, length and period of the run with the greatest exact length / period; ties to smaller start, period."""
    if not len(runs):
        return None
    ratio = (runs[:, 1] - runs[:, 0]) / runs[:, 2]
    best = None
    for s, e, q in runs[ratio >= ratio.max() * (1 - 1e-12)].tolist():  # near the top, compared as fractions
        if best is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    return best


def folded(n: int, doc_id: int | None) -> np.ndarray | None:
    """The contract's own periodic documents: which original word stands at each place, None where none changes."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


def _texts(column: pa.Array) -> list[list[bytes]]:
    """Words of each text; bytes.split() cuts at the six ASCII white-space characters and nothing else."""
    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]


RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id`` and ``runs`` (word number, words, period) of each whole text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches):
        for batch in sliced(batches):
            rows = [[{"start": s, "length": e - s, "period": q} for s, e, q in find_runs(numbered(w), least, times).tolist()] for w in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "runs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, RUNS)


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with each run cut to its first period; the words of a changed text are joined by one space, texts
    without runs stay as they are, and other columns stay."""
    at = docs.columns.index("text")

    def cut(batches):
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            for i, words in enumerate(_texts(batch.column(at))):
                runs = find_runs(numbered(words), least, times)
                if len(runs):
                    gone = repeated(len(words), runs).tolist()
                    texts[i] = b" ".join(w for w, out in zip(words, gone) if not out).decode()
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    return docs.mapInArrow(cut, docs.schema)


DIGEST = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def digest_row(words: list[bytes], doc_id: int | None) -> tuple:
    """Contract values of one document."""
    ids, place = numbered(words), folded(len(words), doc_id)
    if place is not None:
        ids = ids[place]
    runs = find_runs(ids)
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs.tolist())
    kept = words
    if len(runs):
        stay = np.flatnonzero(~repeated(len(words), runs))
        kept = [words[i] for i in (stay if place is None else place[stay]).tolist()]
    elif place is not None:
        kept = [words[i] for i in place.tolist()]
    best = strongest(runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def run_digests(docs: DataFrame) -> DataFrame:
    """Contract rows: runs of every document, a tenth of which is folded to a periodic one first."""
    names = [part.split()[0] for part in DIGEST.split(", ")]
    kinds = (*[pa.int64()] * 5, pa.string(), pa.string())

    def digest(batches):
        for batch in sliced(batches):
            rows = [digest_row(words, doc) for words, doc in zip(_texts(batch.column(1)), batch.column(0).to_pylist())]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, DIGEST)
