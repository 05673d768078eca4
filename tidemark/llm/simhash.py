"""Near duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two link if they differ in at most ``RADIUS`` = 3. Three differing bits leave at most one
in one of the two halves of 32 bits. So every distinct fingerprint emits, for either half, all variants of that half
within half the radius (1 bit, and the half itself), rows are shuffled on the variant, and fingerprints that meet
there, at least one of them at home (the variant is its own half), are verified on all 64 bits. A pair within the
radius meets in this way for certain. Whole 64-bit balls of half the radius (rounded up, 2 bits) would be 2081 variants
of each fingerprint, about 48 KB to shuffle for a document of 2 KB; the halves need 66, about 1.5 KB.

What meets at one variant leaves as a star of links (each fingerprint to the least of its local component), so the
links grow with the rows and not with pairs. Small meetings are verified pair by pair. Large ones hash balls again, over
the other half: variants within 2 bits of homes and within 1 bit of visitors; whatever meets a home that is within 1
bit is within the radius by the triangle inequality, and every pair within the radius has such a meeting.

Exact copies share a fingerprint and are folded first, so a text repeated by a third of all rows is one row here.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other. Repeated rows get equal
results. Rows with a null doc_id get a fingerprint, and the least doc_id of their component if there is one; they
link nothing by themselves. An empty table gives an empty result. Columns other than ``doc_id`` and ``text`` take no
part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.runtime import begin, durable, forget, sliced

RADIUS = 3
SEED = 42
#: Rows that one call of the verifier holds, about.
MEETING_ROWS = 500_000
#: Rows of a variant that are verified pair by pair; more hash balls over the other half.
PAIRWISE = 512
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every shingle of ``width`` words, A-Z lower-cased; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    starts = np.cumsum([0, *sizes])
    full = [i for i, n in enumerate(sizes) if n]
    at = 0
    while at < len(full):  # runs of about 64k hashes, so that unpacked bits stay in the cache
        end = at + 1
        while end < len(full) and starts[full[end] + 1] - starts[full[at]] <= 65_536:
            end += 1
        some = full[at:end]
        block = hashes[starts[some[0]] : starts[some[-1] + 1]]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, starts[some] - starts[some[0]], axis=0, dtype=np.int32)
        counts = np.array([sizes[i] for i in some])[:, None]
        out[some] = np.packbits(2 * sums > counts, axis=1).reshape(-1).view(np.uint64)
        at = end
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every whole text."""

    def hash_all(batches):
        begin("simhash")
        for batch in sliced(batches):
            each = [shingle_hashes(t, width) for t in batch.column(1).to_pylist()]
            flat = np.fromiter((h for x in each for h in x), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(flat, [len(x) for x in each]).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(hash_all, "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """``key, fp, doc_id, home``: the halves of each fingerprint and their one-bit variants; the top bit of ``key``
    above the half tells which half it is."""
    flips = np.array([0, *(1 << i for i in range(32))], np.uint64)

    def emit(batches):
        for batch in (b.slice(low, 10_000) for b in batches for low in range(0, b.num_rows, 10_000)):
            fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            doc = np.asarray(batch.column(1))
            home = np.tile(np.arange(33) == 0, len(fp))
            for half in (0, 1):
                own = (fp >> _HALF if half == 0 else fp) & _LOW
                key = (own[:, None] ^ flips[None]).reshape(-1) | np.uint64(half << 32)
                columns = [key.view(np.int64), np.repeat(fp.view(np.int64), 33), np.repeat(doc, 33), home]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "doc_id", "home"])

    return distinct.select("fp", "doc_id").mapInArrow(emit, "key long, fp long, doc_id long, home boolean")


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component, for links between 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _balls(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, variant) of every 32-bit value within ``radius`` bits."""
    masks = [np.uint64(0)]
    if radius > 0:
        masks += [np.uint64(1 << i) for i in range(32)]
    if radius > 1:
        masks += [np.uint64(1 << i | 1 << j) for i in range(32) for j in range(i)]
    masks = np.array(masks, np.uint64)
    return np.repeat(np.arange(len(values)), len(masks)), (values[:, None] ^ masks[None]).reshape(-1)


def large_meeting(fp: np.ndarray, home: np.ndarray, half: int, slices: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as index pairs) of one large meeting, linear in its rows: each variant of the other half that is within
    1 bit of a home links that home with all homes within 2 bits and all visitors within 1 bit.

    Variants are taken in slices by value, so memory is bounded while every slice sees all rows.
    """
    other = fp & _LOW if half == 0 else fp >> _HALF
    homes, guests = np.flatnonzero(home), np.flatnonzero(~home)
    slices = slices or 1 + (562 * len(homes) + 33 * len(guests)) // 8_000_000
    links_a, links_b = [], []
    for part in range(slices):
        who, variant, near = [], [], []
        for members, radius, is_hub in ((homes, 1, True), (homes, 2, False), (guests, 1, False)):
            for low in range(0, len(members), 4096):
                index, v = _balls(other[members[low : low + 4096]], radius)
                mine = (v * np.uint64(0x9E3779B97F4A7C15) >> _HALF) % np.uint64(slices) == part
                who.append(members[low : low + 4096][index[mine]])
                variant.append(v[mine])
                near.append(np.full(mine.sum(), is_hub))
        who, variant, near = np.concatenate(who), np.concatenate(variant), np.concatenate(near)
        order = np.lexsort((~near, variant))
        who, variant, near = who[order], variant[order], near[order]
        first = np.r_[True, variant[1:] != variant[:-1]]
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        linked = near[start] & (who[start] != who)
        links_a.append(who[linked])
        links_b.append(who[start][linked])
    return np.concatenate(links_a), np.concatenate(links_b)


def meet(key: np.ndarray, fp: np.ndarray, doc: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars of verified links (doc, least doc of the local component) among rows that share keys."""
    order = np.lexsort((~home, key))
    key, fp, doc, home = key[order], fp[order].view(np.uint64), doc[order], home[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    sizes = np.diff(np.r_[starts, len(key)])
    links_a, links_b = [], []
    live = (sizes > 1) & home[starts] if len(starts) else np.empty(0, bool)
    small = live & (sizes <= PAIRWISE)
    at, size = starts[small], sizes[small]
    for shift in range(1, int(size.max(initial=1))):  # the i-th home of a meeting with every later row
        keep = size > shift
        at, size = at[keep], size[keep]
        counts = size - shift
        a = np.repeat(at - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        b = a + shift
        linked = home[a] & (np.bitwise_count(fp[a] ^ fp[b]) <= radius)
        links_a.append(a[linked])
        links_b.append(b[linked])
    for low, n in zip(starts[live & ~small], sizes[live & ~small]):
        a, b = large_meeting(fp[low : low + n], home[low : low + n], int(key[low] >> 32))
        links_a.append(low + a)
        links_b.append(low + b)
    if not links_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    nodes, flat = np.unique(np.r_[doc[a], doc[b]], return_inverse=True)
    root = _local_roots(len(nodes), flat[: len(a)], flat[len(a) :])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between the documents that stand for the distinct fingerprints of ``distinct(fp, doc_id)``."""
    spark = distinct.sparkSession
    rows = 66 * distinct.count()
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // MEETING_ROWS))
    emitted = variants(distinct).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))

    def verify(group: pa.Table) -> pa.Table:
        a, b = meet(*(group.column(c).to_numpy() for c in ("key", "fp", "doc_id", "home")))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return emitted.groupBy("part").applyInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    prints = durable(fingerprints(docs, width))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL"))
    found = components(links(distinct))
    roots = distinct.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("fp", F.coalesce("root", "doc_id").alias("component_id"))
    by_print = durable(roots)
    forget(distinct)
    return prints.join(by_print, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicate_digests(docs: DataFrame, width: int = 3) -> DataFrame:
    """Contract rows."""
    return near_duplicates(docs, width).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` without the documents of a component other than its least doc_id; rows of one doc_id stay or go
    together, rows without a doc_id stay."""
    gone = near_duplicates(docs, width).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(durable(gone), "doc_id", "left_anti").select(*docs.columns)
