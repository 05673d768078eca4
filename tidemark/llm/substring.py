"""Exact repeats of word windows: fixed-block anchors, probed by every rolling window and extended to maximal repeats.

A window is 20 consecutive words of one document. A word is removed if a window covers it whose word sequence also
starts earlier (smaller doc_id, or same document and earlier start); windows are judged on the input.

Of two equal windows, the earlier one holds a whole block of 10 words that starts at a multiple of 10 in its document.
So it is enough to index these non-overlapping reference blocks and to probe them with every rolling window of 10
words; where a probe hits, it is extended: the windows of 20 words around it are compared, and the union of those that
start earlier elsewhere is the maximal repeat.

Documents are dealt into *batches*, ranges of doc_id that hold some megabytes of text each, so "earlier" between batches
is the order of the batches and inside a batch the order of its rows. A doc_id that fills several batches (or null, if
many rows have none) is spread over as many by a hash. What is exchanged are not rows per window but, from each batch
to each range of hashes, one packed set (sorted hashes, their differences in the fewest bytes):

1. each batch sends its rolling hashes, blocks marked; a range answers each batch with the hashes that lie in several
   batches, in one of them as a block (hits);
2. each batch extends its hits and sends the hashes of the windows around them; a range answers all batches but the
   earliest that holds a window;
3. each batch removes the words under answered windows and under repeats inside the batch.

A hash occurs once in a set however often it is in the batch, and ranges are even in hashes, so neither a passage that
a third of all documents share nor any other hot key makes a large task. Texts are shuffled once, by batch, and that
exchange serves all three passes; a task holds the hashes of its batch and the words of one document. Anchors are
compared by 48 bits, which only costs some needless extensions; windows by 96 bits (two hashes over 64-bit word hashes):
n compared windows give about n^2 / 2^97 false removals, 1e-5 for a million million of them.

Defined results: null, empty and blank texts have no words and the hash of the empty string. Rows with a null doc_id
come before all others; rows with equal doc_id count as documents in the order of their texts (if they fill several
batches, in the order of a hash of text and place, then of texts). Documents of fewer
than 20 words lose nothing. An empty table gives an empty result. Words are runs of bytes other than space and
\\x09-\\x0D, so other Unicode spaces are part of words. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import begin, hold

WINDOW = 20
BLOCK = 10
ANCHOR_BITS = 48
#: Text of a batch: 4 MB for up to 1 GB of text, then as the root of the text, up to 256 MB.
LEAST_BATCH, MOST_BATCH = 4 << 20, 256 << 20
#: Bytes of text that count once when ranges are measured.
UNIT = 2048
#: Hashes that a range answers at a time, about.
RANGE_HASHES = 1_500_000
#: Words whose hashes a Python worker keeps.
TABLE_SIZE = 250_000
BATCH = "_tidemark_batch"
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_SIZE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()
hold("substring", _WORDS.clear)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Batch:
    """Word hashes of the documents of a batch that are long enough to hold a window, one after the other."""

    def __init__(self, texts: list[str | None]):
        begin("substring")
        each, self.counts = [np.zeros(0, np.uint64)], []
        for text in texts:
            words = split_words(text)
            self.counts.append(len(words))
            if len(words) >= WINDOW:
                each.append(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))
        self.long = [i for i, n in enumerate(self.counts) if n >= WINDOW]
        self.sizes = np.array([self.counts[i] for i in self.long], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        total = int(self.starts[-1])
        flat = np.concatenate(each)
        rolled, other = self._roll(flat, _BASE), self._roll(flat, _OTHER_BASE)
        at = np.arange(total) - np.repeat(self.starts[:-1], self.sizes)
        left = np.repeat(self.sizes, self.sizes) - at
        #: first word of each rolling window and of each full window
        self.probes = np.flatnonzero(left >= BLOCK)
        self.windows = np.flatnonzero(left >= WINDOW)
        power = lambda base: np.uint64(pow(base, BLOCK, 1 << 64))
        self.anchor = _mix(rolled[self.probes]) >> np.uint64(64 - ANCHOR_BITS)
        self.is_block = at[self.probes] % BLOCK == 0
        pair = lambda x, base: _mix(x[self.windows] * power(base) + x[self.windows + WINDOW - BLOCK] + np.uint64(1))
        self.window = pair(rolled, _BASE)
        self.check = (pair(other, _OTHER_BASE) >> np.uint64(32)).astype(np.uint32)
        self.total = total

    @staticmethod
    def _roll(flat: np.ndarray, base: int) -> np.ndarray:
        """Hashes of all runs of ``BLOCK`` words."""
        count = max(0, len(flat) - BLOCK + 1)
        out = flat[:count].copy()
        for j in range(1, BLOCK):
            out = out * np.uint64(base) + flat[j : count + j]
        return out

    def around(self, hit: np.ndarray) -> np.ndarray:
        """Which full windows hold a probe that hits."""
        hits = np.zeros(self.total + WINDOW + 1, np.int64)
        hits[self.probes[hit] + 1] = 1
        hits = np.cumsum(hits)
        return hits[self.windows + WINDOW - BLOCK + 1] > hits[self.windows]

    def own_hits(self) -> np.ndarray:
        """Probes that equal another one of the batch, one of the equal ones being a block."""
        if not len(self.anchor):
            return np.zeros(0, bool)
        _, back, counts = np.unique(self.anchor, return_inverse=True, return_counts=True)
        blocks = np.bincount(back[self.is_block], minlength=len(counts)) > 0
        return ((counts > 1) & blocks)[back]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _within(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(chosen):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)
    return chosen[at] == values


def _within_both(values: np.ndarray, checks: np.ndarray, chosen: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which (value, check) pairs are among those chosen, sorted by value."""
    keys, marks = chosen
    out = np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    open_ = np.flatnonzero(at < len(keys))
    while len(open_):  # once, but for values that occur with several checks
        open_ = open_[keys[at[open_]] == values[open_]]
        out[open_] |= marks[at[open_]] == checks[open_]
        at[open_] += 1
        open_ = open_[(at[open_] < len(keys)) & ~out[open_]]
    return out


def _first_of_each(values: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which (value, check) pairs are the first of their kind."""
    order = np.lexsort((np.arange(len(values)), checks, values))
    v, c = values[order], checks[order]
    first = np.ones(len(values), bool)
    first[order[1:]] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    return first


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as the first one and their differences in as few bytes as the largest needs."""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    small = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + small.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = raw
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


def _send(batch: int, values: np.ndarray, bits: int, ranges: int, checks: np.ndarray | None = None) -> pa.Table:
    """One row for each range of hashes that sorted ``values`` of ``bits`` bits touch, with their checks if given."""
    cuts = np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)
    ends = np.r_[0, np.searchsorted(values, cuts), len(values)]
    full = [i for i in range(ranges) if ends[i + 1] > ends[i]]
    data = [pack(values[ends[i] : ends[i + 1]]) for i in full]
    if checks is not None:
        data = [checks[ends[i] : ends[i + 1]].astype("<u4").tobytes() + d for i, d in zip(full, data)]
        sizes = [int(ends[i + 1] - ends[i]) for i in full]
        data = [n.to_bytes(8, "little") + d for n, d in zip(sizes, data)]
    return pa.table({"range": pa.array(full, pa.int32()), "batch": pa.array([batch] * len(full), pa.int32()), "data": pa.array(data, pa.binary())})


def unpack_checked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return unpack(data[8 + 4 * n :]), np.frombuffer(data, "<u4", n, 8)


def _answers(batch: np.ndarray, values: np.ndarray, checks: np.ndarray | None = None) -> pa.Table:
    """One row for each batch, from values sorted by batch and size."""
    firsts = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]) if len(batch) else np.empty(0, int)
    parts = np.split(values, firsts[1:]) if len(firsts) else []
    data = [pack(p) for p in parts]
    if checks is not None and len(firsts):
        data = [len(c).to_bytes(8, "little") + c.astype("<u4").tobytes() + d for c, d in zip(np.split(checks, firsts[1:]), data)]
    return pa.table({BATCH: pa.array(batch[firsts], pa.int32()), "data": pa.array(data, pa.binary())})


def _gather(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(values, batches) of the sets sent to a range, sorted by value, then batch."""
    sets = [unpack(d) for d in group.column("data").to_pylist()]
    batch = np.repeat(group.column("batch").to_numpy().astype(np.int32), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.lexsort((batch, values))
    return values[order], batch[order]


_ONE = np.uint64(1)


def _anchor_hits(group: pa.Table) -> pa.Table:
    """Hashes in several batches, in one of them as a block (the lowest bit), to all batches that have them."""
    values, batch = _gather(group)
    key, block = values >> _ONE, (values & _ONE).astype(bool)
    first = np.r_[True, key[1:] != key[:-1]]
    which = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    apart = np.maximum.reduceat(batch, starts) != np.minimum.reduceat(batch, starts)
    hit = (apart & np.logical_or.reduceat(block, starts))[which]
    key, batch = key[hit], batch[hit]
    order = np.lexsort((key, batch))
    return _answers(batch[order], key[order])


def _later_windows(group: pa.Table) -> pa.Table:
    """Windows to all batches that have them but the earliest."""
    sets = [unpack_checked(d) for d in group.column("data").to_pylist()]
    batch = np.repeat(group.column("batch").to_numpy().astype(np.int32), [len(v) for v, _ in sets])
    values, checks = (np.concatenate([x[i] for x in sets]) for i in (0, 1))
    order = np.lexsort((batch, checks, values))
    values, checks, batch = values[order], checks[order], batch[order]
    later = np.r_[False, (values[1:] == values[:-1]) & (checks[1:] == checks[:-1])][: len(values)]
    values, checks, batch = values[later], checks[later], batch[later]
    order = np.lexsort((values, batch))
    return _answers(batch[order], values[order], checks[order])


def _in_order(group: pa.Table) -> tuple[list[int], list[str | None]]:
    """Order of the rows (null doc_ids, then doc_id; equal ones by text) and the texts in that order."""
    docs, texts = group.column("doc_id").to_pylist(), group.column("text").to_pylist()
    order = sorted(range(len(docs)), key=lambda i: (docs[i] is not None, docs[i] or 0, texts[i] or ""))
    return order, [texts[i] for i in order]


def _answered(replies: pa.Table) -> np.ndarray:
    sets = [unpack(d) for d in replies.column("data").to_pylist()]
    return np.sort(np.concatenate(sets)) if sets else np.empty(0, np.uint64)


def _answered_windows(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sets = [unpack_checked(d) for d in replies.column("data").to_pylist()]
    if not sets:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    values, checks = (np.concatenate([x[i] for x in sets]) for i in (0, 1))
    order = np.argsort(values, kind="stable")
    return values[order], checks[order]


def _batch_of(group: pa.Table) -> int:
    return group.column(BATCH)[0].as_py()


def covered(batch: Batch, answered: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which words of the batch are removed."""
    gone = _within_both(batch.window, batch.check, answered)
    near = np.flatnonzero(batch.around(batch.own_hits()))
    if len(near):
        gone[near[~_first_of_each(batch.window[near], batch.check[near])]] = True
    edges = np.zeros(batch.total + 1, np.int64)
    np.add.at(edges, batch.windows[gone], 1)
    np.add.at(edges, batch.windows[gone] + WINDOW, -1)
    return np.cumsum(edges)[:-1] > 0


def _batches(docs: DataFrame) -> tuple[Column, int]:
    """The batch of a row (an expression), and the number of ranges of hashes."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    each = min(MOST_BATCH, max(LEAST_BATCH, int(LEAST_BATCH * math.sqrt(size / (1 << 30)))))
    count, ranges = max(1, -(-size // each)), max(1, -(-size // (6 * RANGE_HASHES)))
    if count == 1:
        return F.lit(0), ranges
    # Ranges of equal bytes: a row counts once for each unit of its text. Null doc_ids come first, as the least number.
    place = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long")
    units = (1 + F.coalesce(F.octet_length("text"), F.lit(0)) / UNIT).cast("int")
    shares = [i / count for i in range(1, count)]
    weighted = docs.select(F.explode(F.array_repeat(place, units)).alias("place"))
    cuts = sorted(weighted.agg(F.percentile_approx("place", shares, 20 * count)).first()[0] or [])
    # Two levels of sorted cuts: a row looks at about 2 * sqrt(batches) of them.
    step = max(1, math.isqrt(len(cuts)))

    def below(holds) -> Column:
        block = F.size(F.filter(F.lit(cuts[step - 1 :: step]), holds))
        return block * step + F.size(F.filter(F.slice(F.lit(cuts), block * step + 1, F.lit(step)), holds))

    # A doc_id that is the cut of several ranges fills them: its rows are spread over these.
    first, own = below(lambda cut: cut < place), below(lambda cut: cut <= place)
    spread = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.greatest(own - first, F.lit(1)))
    return (first + spread).cast("int"), ranges


def _removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` dealt into batches, and for each batch the windows that an earlier batch holds."""
    batch, ranges = _batches(docs)
    dealt = docs.withColumn(BATCH, batch)

    def send_anchors(group: pa.Table) -> pa.Table:
        b = Batch(_in_order(group)[1])
        marked = np.unique((b.anchor << _ONE) | b.is_block.astype(np.uint64))
        last = np.r_[marked[1:] >> _ONE != marked[:-1] >> _ONE, True][: len(marked)]  # a block stands for its plain probes
        return _send(_batch_of(group), marked[last], ANCHOR_BITS + 1, ranges)

    def send_windows(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(replies) or not len(group):
            return _send(0, np.empty(0, np.uint64), 64, ranges, np.empty(0, np.uint32))
        b = Batch(_in_order(group)[1])
        near = np.flatnonzero(b.around(_within(b.anchor, _answered(replies))))
        near = near[_first_of_each(b.window[near], b.check[near])]
        near = near[np.argsort(b.window[near], kind="stable")]
        return _send(_batch_of(group), b.window[near], 64, ranges, b.check[near])

    sets, answer = "range int, batch int, data binary", f"{BATCH} int, data binary"
    hits = dealt.groupBy(BATCH).applyInArrow(send_anchors, sets).groupBy("range").applyInArrow(_anchor_hits, answer)
    windows = dealt.groupBy(BATCH).cogroup(hits.groupBy(BATCH)).applyInArrow(send_windows, sets)
    return dealt, windows.groupBy("range").applyInArrow(_later_windows, answer)


def find_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, removed`` (runs of removed words: first, end exclusive) and ``kept_sha256`` of the kept words
    joined by single spaces."""
    dealt, later = _removals(docs.select("doc_id", "text"))
    run_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def remove(group: pa.Table, replies: pa.Table) -> pa.Table:
        order, texts = _in_order(group)
        b = Batch(texts)
        gone = covered(b, _answered_windows(replies))
        where = dict(zip(b.long, range(len(b.long))))
        removed: list[list[dict]] = []
        sha = []
        for i, text in enumerate(texts):
            words, runs = split_words(text), []
            if i in where:
                mine = gone[b.starts[where[i]] : b.starts[where[i] + 1]]
                edges = np.flatnonzero(np.diff(np.r_[False, mine, False])).tolist()
                runs = [{"first": a, "end": e} for a, e in zip(edges[::2], edges[1::2])]
                if runs:
                    words = [w for w, g in zip(words, mine.tolist()) if not g]
            removed.append(runs)
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        docs_ = group.column("doc_id").take(pa.array(order, pa.int64()))
        return pa.table({"doc_id": docs_, "n_words": pa.array(b.counts, pa.int64()), "removed": pa.array(removed, run_type), "kept_sha256": pa.array(sha, pa.string())})

    schema = "doc_id long, n_words long, removed array<struct<first:long,end:long>>, kept_sha256 string"
    return dealt.groupBy(BATCH).cogroup(later.groupBy(BATCH)).applyInArrow(remove, schema)


def cut_text(text: str, gone: list[bool]) -> str:
    """The text without the words marked, and without the white space before each of them."""
    data, out, at = text.encode(), [], 0
    for word, drop in zip(data.split(), gone):
        start = data.index(word, at)
        if not drop:
            out += [data[at:start], word]
        at = start + len(word)
    return b"".join(out).strip(b" \t\n\r\x0b\x0c").decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words cut out of ``text`` and ``n_chars`` (if there, of any whole type) brought in line.
    Documents without repeats are left as they are; documents of which nothing is left are dropped."""
    dealt, later = _removals(docs)
    schema = docs.schema

    def remove(group: pa.Table, replies: pa.Table) -> pa.Table:
        order, in_order = _in_order(group)
        b = Batch(in_order)
        gone = covered(b, _answered_windows(replies))
        texts = group.column("text").to_pylist()
        sizes = group.column("n_chars").to_pylist() if "n_chars" in group.column_names else None
        empty = set()
        for k, i in enumerate(b.long):
            mine = gone[b.starts[k] : b.starts[k + 1]]
            if mine.any():
                row = order[i]
                texts[row] = cut_text(texts[row], mine.tolist())
                if sizes:
                    sizes[row] = len(texts[row])
                if mine.all():
                    empty.add(row)
        out = group.select(schema.names)
        out = out.set_column(schema.names.index("text"), "text", pa.array(texts, pa.string()))
        if sizes:
            out = out.set_column(schema.names.index("n_chars"), "n_chars", pa.array(sizes, out.schema.field("n_chars").type))
        return out.take(pa.array([i for i in range(len(texts)) if i not in empty], pa.int64())) if empty else out

    return dealt.groupBy(BATCH).cogroup(later.groupBy(BATCH)).applyInArrow(remove, schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Contract rows."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return find_repeats(docs).select("doc_id", "n_words", gone.alias("n_removed"), "kept_sha256")


#: The contract in DuckDB SQL, window by window.
REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s + 19], ' ') ORDER BY doc_id, s) AS n FROM p),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM k WHERE n > 1),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
g AS (SELECT x.doc_id, count(r.pos) AS n_removed, string_agg(word, ' ' ORDER BY x.pos) FILTER (r.pos IS NULL) AS kept
      FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.pos = r.pos GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)"""
