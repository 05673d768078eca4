"""Near duplicates by Jaccard similarity of word shingles: SimHash and MinHash candidates, exact verification.

Two texts link if their sets of ``width``-word shingles have a Jaccard similarity of ``ALIKE`` = 4/5 at least. First the
texts whose SimHash fingerprints link (``simhash``, by ball hashing) are verified against the least text of their ball
component, and what is alike is linked. SimHash's radius takes in the closest copies only, so all texts meet again by
MinHash, where pairs that are linked already are left out. A text has
``BANDS`` x ``ROWS`` minimums of its shingle hashes; texts whose minimums are equal in all rows of a band meet there. A
pair of similarity s meets with probability 1 - (1 - s^3)^10: 0.9992 at 0.8, more above.

What meets is verified on the whole sets. In meetings of up to ``SMALL`` texts every pair is. In a larger one each text is
compared with the smallest, c, and all pairs that are alike are still found: let x and y be alike. If they share no
shingle outside c, then x and c share what x and y share, and c is no larger than y, so x is alike to c, and so is y:
they are linked through c. Otherwise they share a shingle outside c, and meet again there. Of the shingles of x outside c
only the first, the rarest, are needed for that: x and y share 4/5 of x at least, of which no more lies in c than x shares
with c, so a text that lacks k of that outside c can leave out its last k - 1 (a prefix filter). Such meetings are taken
in the next round, in the same way; those of texts that are all linked by now, and those of the same texts as another,
are left out. Texts that only share a passage share nothing outside it, so a passage of thousands of texts is linear.
Texts that are nearly alike, each to each, would leave a round one by one; so a meeting that is verified pair by pair
may be four times as large in each round.

Texts are shuffled once, those that meet anything, and kept in the shared folder with other tables of the run, which
are removed when they have been used. Texts with equal sets are folded before. Defined results: texts without words have
empty sets and link to each other only. Repeated rows get equal results. Rows with a null doc_id link nothing. An empty
table gives an empty result. Other columns take no part, whatever their names. Rows of one doc_id with several texts
count as the text of the first of them that is met.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.runtime import begin, durable, forget, sliced
from tidemark.llm.simhash import shingle_hashes

BANDS, ROWS = 10, 3
#: Least similarity of a link, as a fraction.
ALIKE = (4, 5)
#: Texts of a meeting that is verified pair by pair; in larger ones the same links are found by rounds of centres.
SMALL = 16
#: Meetings of a text that are listed, so that a pair is made in the first only and not in all that it shares.
FIRST = 32
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)
_BAND = _RANDOM.integers(0, 1 << 63, BANDS, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of a set of shingle hashes; none of an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[low : low + 1024, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND


def prints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, digest, keys, size, fp``: the digest of the set of shingles, its band keys and its size, and the SimHash
    fingerprint of the text."""

    def hash_all(batches):
        begin("minhash")
        for batch in sliced(batches):
            digests, keys, sizes = [], [], []
            each = [np.array(shingle_hashes(t, width), np.uint64) for t in batch.column(1).to_pylist()]
            fps = simhash.majority(np.concatenate(each), [len(x) for x in each])
            for own in map(np.unique, each):
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                keys.append(band_keys(own).view(np.int64))
                sizes.append(len(own))
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "keys", "size", "fp"])

    return docs.select("doc_id", "text").mapInArrow(hash_all, "doc_id long, digest binary, keys array<long>, size long, fp long")


def least_shared(sizes: int) -> int:
    """How many shingles two alike sets share, of that many in both: with a similarity of p/q, p/(p+q) of their sizes."""
    return -(-ALIKE[0] * sizes // (ALIKE[0] + ALIKE[1]))


def alike(one: frozenset, other: frozenset) -> bool:
    both = len(one & other)
    return ALIKE[1] * both >= ALIKE[0] * (len(one) + len(other) - both)


def outside(one: frozenset, centre: frozenset) -> tuple[list[int], int]:
    """The shingles of ``one`` outside ``centre``, and how many of them it has to show, in any order that holds for all
    texts, so that every text that is alike to it, and not linked through the centre, meets it. None if it need not
    show any."""
    rest = one - centre
    shared = max(-(-ALIKE[0] * len(one) // ALIKE[1]), least_shared(len(one) + len(centre)))  # the other is no smaller than the centre
    needed = max(1, shared - (len(one) - len(rest)))
    shown = max(0, len(rest) - needed + 1)
    return ([h - (1 << 64) if h >> 63 else h for h in rest] if shown else []), shown


def verify(candidates: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``a, b, linked, rest, shown`` of the candidate pairs ``a, b, star``: whether they are alike and, where ``b`` is a
    centre, what ``outside`` says of ``a``. ``texts(doc_id, text)`` has a row for each document."""
    chosen = durable(candidates.groupBy("a", "b").agg(F.bool_or("star").alias("star")))
    both = chosen.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def compare(batches):
        begin("minhash")
        seen: dict[str, frozenset] = {}

        def shingles(text: str) -> frozenset:
            if text not in seen:
                if len(seen) >= 64:
                    seen.pop(next(iter(seen)))
                seen[text] = frozenset(shingle_hashes(text, width))
            return seen[text]

        # The other text of neighbouring pairs is often the same, the centre of a star.
        for batch in sliced(batches, "text_a"):
            linked, rest, shown = [], [], []
            for star, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                one, other = shingles(x or ""), shingles(y or "")
                linked.append(alike(one, other))
                some, n = outside(one, other) if star else ([], 0)
                rest.append(some)
                shown.append(n)
            columns = [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(rest, pa.list_(pa.int64())), pa.array(shown, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "linked", "rest", "shown"])

    compared = both.select("a", "b", "star", "text_a", "text_b").mapInArrow(compare, "a long, b long, linked boolean, rest array<long>, shown long")
    found = durable(compared.where("linked OR size(rest) > 0"))
    forget(chosen)
    return found


def balls(distinct: DataFrame) -> DataFrame:
    """``a, b, star``: each text with the least one of its fingerprint, and that with the least of those that its
    fingerprint links to."""
    one = distinct.groupBy("fp").agg(F.min("doc_id").alias("b"))
    same = distinct.join(one, "fp").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    return same.unionAll(simhash.links(one.select("fp", F.col("b").alias("doc_id")))).withColumn("star", F.lit(False))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of the keys that several documents have, with their number ``n``."""
    several = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return durable(rows.join(several, "key"))


def centres(large: DataFrame) -> DataFrame:
    """``key, centre``: the smallest text of each meeting, ties to the least doc_id."""
    return large.groupBy("key").agg(F.min_by("doc_id", F.struct("size", "doc_id")).alias("centre"))


def _told_apart(small: DataFrame) -> DataFrame:
    """``small`` with ``main``, the root that most texts of the meeting have, and ``before``: which meetings with lower
    keys the text has, of its ``FIRST`` lowest."""
    by = Window.partitionBy("doc_id").orderBy("key")
    lowest = F.collect_list(F.when(F.col("_n") <= FIRST, F.col("key"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    listed = small.withColumn("_n", F.row_number().over(by)).withColumn("before", lowest)
    return listed.join(small.groupBy("key").agg(F.mode("root", True).alias("main")), "key")


def pairs(meetings: DataFrame, most: int) -> DataFrame:
    """``a, b, star``: all pairs of meetings of up to ``most`` that are not linked, and each document of a larger one
    with its centre. Two texts share no more of the centre they came from than either has of it (``inside``), and no
    more outside than either has in common with any (``common``); pairs for which that is too little are left out.

    One text of a pair at least has not the root that most of its meeting have, so only such texts are held against the
    others. Texts that have many meetings in common are a pair in the first of them alone, of those listed: a pair is
    left out only where both list a meeting before that they share, and the first that they share is never left out."""
    small, large = meetings.where(F.col("n") <= most), meetings.where(F.col("n") > most)
    told = _told_apart(small)
    one, other = (told.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "root", "main", "size", "inside", "common", "before"))) for side in "ab")
    could = F.least("inside_a", "inside_b") + F.least("common_a", "common_b")
    fits = could * (ALIKE[0] + ALIKE[1]) >= (F.col("size_a") + F.col("size_b")) * ALIKE[0]
    star = large.join(centres(large), "key").where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"), F.lit(True).alias("star"))
    pair = one.where("root_a <> main_a").join(other, "key").where("root_a <> root_b AND (root_b = main_b OR doc_id_a > doc_id_b)").where(fits).where(~F.arrays_overlap("before_a", "before_b"))
    return pair.select(F.greatest("doc_id_a", "doc_id_b").alias("a"), F.least("doc_id_a", "doc_id_b").alias("b"), F.lit(False).alias("star")).unionAll(star)


def _rooted(meetings: DataFrame, roots: DataFrame) -> DataFrame:
    return meetings.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


def next_meetings(meetings: DataFrame, found: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``key, doc_id, size, root, inside, common, n``: where texts of large meetings meet outside their centres. Only meetings of texts that are
    not all linked yet (``roots(node, root)``) are taken, and of meetings of the same texts one.

    Texts show the shingles first that fewest others of the centre have, so a text whose own are mostly its own shows
    few that others share, or none."""
    several = lambda rows, *more: rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("_low"), F.max("root").alias("_high"), *more).where("_low <> _high")
    large = _rooted(meetings.where(F.col("n") > most).select("key", "doc_id", "size"), roots)
    apart = large.join(several(large).select("key"), "key", "left_semi")
    told = apart.join(centres(apart), "key").select("centre", "doc_id", "size", "root").distinct()
    told = told.join(found.where("shown > 0").select(F.col("a").alias("doc_id"), F.col("b").alias("centre"), "rest", "shown"), ["doc_id", "centre"])
    each = durable(told.select(F.explode("rest").alias("r"), "shown", "centre", "doc_id", "size", "root").select(F.xxhash64("centre", "r").alias("key"), "shown", "centre", "doc_id", "size", "root"))
    rare = Window.partitionBy("centre", "doc_id").orderBy("have", "key")
    ranked = each.join(each.groupBy("key").agg(F.count("*").alias("have")), "key").withColumn("_n", F.row_number().over(rare))
    text = Window.partitionBy("centre", "doc_id")
    ranked = ranked.withColumn("common", F.count_if(F.col("have") > 1).over(text)).withColumn("inside", F.col("size") - F.count("*").over(text))
    rows = durable(ranked.where("_n <= shown AND have > 1").select("key", "doc_id", "size", "root", "inside", "common"))
    forget(each)
    number = F.xxhash64("doc_id")
    groups = several(rows, F.bit_xor(number).alias("_xor"), F.sum(F.shiftright(number, 20)).alias("_sum"))
    kept = groups.groupBy("n", "_xor", "_sum").agg(F.min("key").alias("key")).select("key", "n")
    out = durable(rows.join(kept, "key"))
    forget(rows)
    return out


def links(distinct: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``node, root`` of linked documents: verified links between those that meet; ``distinct(doc_id, keys, size, fp)``.

    Texts that are alike have sizes at most 5/4 apart, so a meeting falls into those of neighbouring classes of size.
    """
    classes = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(ALIKE[1] / ALIKE[0] + 1e-4))
    met = distinct.select("doc_id", "size", F.explode("keys").alias("band")).withColumn("class", F.explode(F.array(classes, classes + 1)))
    meetings = _shared(met.select(F.xxhash64("band", "class").alias("key"), "doc_id", "size", F.col("doc_id").alias("root"), F.col("size").alias("inside"), F.lit(0).cast("long").alias("common")))
    near = durable(balls(distinct))
    meet = meetings.select("doc_id").unionAll(near.select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct()
    texts = durable(docs.select("doc_id", "text").join(meet, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    close = verify(near, texts, width)
    roots, most = components(close.where("linked").select("a", "b")), SMALL
    forget(near)
    forget(close)
    raw, meetings = meetings, durable(_rooted(meetings.drop("root"), roots).select(*meetings.columns))
    forget(raw)
    while True:
        found = verify(pairs(meetings, most), texts, width)
        linked = found.where("linked").select("a", "b").unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        before, roots = roots, components(linked)
        again = next_meetings(meetings, found, roots, most)
        most *= 4
        for done in (meetings, found, before):
            forget(done)
        meetings = again
        if meetings.isEmpty():
            break
    forget(meetings)
    forget(texts)
    return roots


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, component_id`` of every document."""
    each = durable(prints(docs, width))
    distinct = durable(each.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min_by(F.struct("doc_id", "keys", "size", "fp"), "doc_id").alias("one")).select("digest", "one.*"))
    found = links(distinct, docs, width)
    roots = durable(distinct.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", F.coalesce("root", "doc_id").alias("component_id")))
    forget(distinct)
    out = durable(each.select("doc_id", "digest").join(roots, "digest", "left").select("doc_id", "component_id"))
    forget(each)
    forget(roots)
    return out


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` without the documents of a component other than its least doc_id; rows of one doc_id stay or go
    together, rows without a doc_id stay."""
    gone = near_duplicates(docs, width).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
