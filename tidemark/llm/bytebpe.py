"""Byte-level BPE: encoding by folds of ranked merges in Spark's higher-order functions, decoding by concatenation.

A text is split by the vocabulary's pattern; the ids of each match depend on the match alone, so a task folds merges
once for each distinct word it meets. Tasks read at least ``TASK_BYTES`` of input, unless that leaves cores idle, so that
few words are folded by several tasks. One narrow pass over the documents, without a shuffle, in three steps:

1. Python splits the texts and numbers the distinct words of the task; a row carries the numbers of its words, and the
   bytes of those words that come up for the first time, as ids of single-byte tokens with the ranks of their pairs;
2. ``merged`` folds the merges of the new words in the JVM: the state is the array of token ids with the rank of each
   neighbouring pair; every step joins the leftmost pair of least rank and looks up the two pairs that this makes. Ranks
   come from a literal map of pairs: a hash table without collisions, in two literal arrays;
3. Python puts the ids of words together to ids of texts, and decodes them by concatenating their byte pieces.

A word that is a token is its own id, as in the vocabulary's library. A step of the fold costs the length of the word,
so words of more than ``LONG_WORD`` bytes are merged with a heap in step 1 instead: n log n steps, the same merges in the
same order. A task's table of words is bounded by the text it reads.

Defined results: a null or empty text has no ids and decodes to no bytes. Special tokens are plain text. Repeated rows
get equal results; an empty table gives an empty one. Texts are read whole. Code points that are newer than the tables of
the tokenizer's library are split as that library does, if it can be imported. Columns other than ``doc_id`` and
``text`` take no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import random
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import sliced

#: Bytes of input of a task, at least.
TASK_BYTES = 64 << 20
#: Bytes of the longest word that the fold merges.
LONG_WORD = 100
#: A pair of ids is one number: the left one shifted by this, plus the right one.
ID_BITS = 17
#: No token, and the id of the ends of a word.
EDGE = (1 << ID_BITS) - 1
#: The rank of a pair that forms no token, above all others.
NO_RANK = 1 << ID_BITS
#: Bits of a place in a word that the fold merges.
PLACE_BITS = 7
#: A slot without a pair, above all that have one.
EMPTY = 1 << 3 * ID_BITS
#: Place and id.
OWN = (1 << PLACE_BITS + ID_BITS) - 1
#: What stands at either end of a word; its place stays above 0, whatever is merged before it.
END = NO_RANK << PLACE_BITS + ID_BITS | OWN
GROUPS = 1 << 15


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of what two neighbouring tokens form, for every pair of tokens that forms one."""
    out = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                out[left << ID_BITS | right] = rank
    return out


@lru_cache(maxsize=2)
def pair_table(path: str) -> tuple[int, list[int], list[int]]:
    """The pairs as a hash table without collisions: (multiplier, shift of each group of pairs, slots). A slot holds pair
    and rank as one number, plus one; 0 is empty. A pair's slot is its hash plus the shift of its group."""
    pairs = pair_ranks(read_ranks(path))
    if max(read_ranks(path).values(), default=0) >= EDGE:
        raise ValueError(f"ids must be below {EDGE}")
    size = 1 << max(4, (2 * len(pairs)).bit_length())
    rng = random.Random(1)
    while True:
        times = rng.randrange(1 << 27, 1 << 28) | 1
        groups: dict[int, list[int]] = {}
        for pair in pairs:
            groups.setdefault(_group(pair), []).append(pair)
        if all(len({_slot(p, times, 0, size) for p in group}) == len(group) for group in groups.values()):
            break
    shifts, slots = [0] * GROUPS, [0] * size
    for group, members in sorted(groups.items(), key=lambda x: -len(x[1])):
        while any(slots[_slot(p, times, shifts[group], size)] for p in members):
            shifts[group] = rng.randrange(size)
        for p in members:
            slots[_slot(p, times, shifts[group], size)] = (p << ID_BITS | pairs[p]) + 1
    return times, shifts, slots


def _group(pair: int) -> int:
    return (pair * 40503 >> 5) % GROUPS


def _slot(pair: int, times: int, shift: int, size: int) -> int:
    return ((pair * times >> 20) + shift) % size


def rank_literal(path: str) -> tuple[Column, int, int]:
    """The table as a literal (arrays out of one string each, which Catalyst folds), its multiplier and its size. Bounded
    by the vocabulary."""
    times, shifts, slots = pair_table(path)
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    return F.struct(numbers(shifts).alias("shifts"), numbers(s - 1 if s else EMPTY for s in slots).alias("slots")), times, len(slots)


def let(value: Column, body) -> Column:
    """``body(value)``, an array, with ``value`` computed once. Not by an index into the outer array: for each row that
    derives its type anew from the whole of ``body``."""
    return F.flatten(F.transform(F.array(value), body))


def merged(word: Column, table: Column, times: int, size: int) -> Column:
    """The fold of ranked merges of one word, of the state that ``Splitter.starts`` gives it; ids are the lowest bits.

    The state is one array: a number for each token, of the rank of the pair that it begins (``NO_RANK`` if none), its
    place in the array, and its id, from the highest bits to the lowest. So the least number is the leftmost pair of least
    rank, and says where it is. A token that forms no pair stands at either end.
    """
    long = lambda n: F.lit(n).cast("long")

    def ranked(x: Column) -> Column:
        """The number of a token, of its place, its id and the id of the next."""
        pair = x.bitwiseAND(long((1 << 2 * ID_BITS) - 1))
        group = F.shiftright(x * long(40503), 5).bitwiseAND(long(GROUPS - 1))  # of the lowest bits alone
        at = (F.shiftright(pair * long(times), 20) + F.get(table["shifts"], group)).bitwiseAND(long(size - 1))
        found = F.get(table["slots"], at).bitwiseXOR(F.shiftleft(pair, ID_BITS))  # the rank alone, if the slot has the pair
        return F.shiftleft(F.least(found, long(NO_RANK)), PLACE_BITS + ID_BITS) + F.shiftright(x, ID_BITS)

    def step(state: Column, _: Column) -> Column:
        def join(low: Column) -> Column:
            new = F.shiftright(low, PLACE_BITS + ID_BITS)
            i = F.shiftright(low, ID_BITS).bitwiseAND(long(OWN >> ID_BITS)).cast("int")
            before = F.shiftleft(F.get(state, i - 1).bitwiseAND(long(OWN)), ID_BITS) + new
            joined = F.shiftleft(low.bitwiseAND(long(OWN - EDGE)) + new, ID_BITS) + F.get(state, i + 2).bitwiseAND(long(EDGE))
            rest = F.transform(F.slice(state, i + 3, F.size(state)), lambda x: x - long(1 << ID_BITS))  # one place to the left
            parts = F.array(F.slice(state, F.lit(1), i - 1), F.transform(F.array(before, joined), ranked), rest)
            return F.when(low >= long(NO_RANK << PLACE_BITS + ID_BITS), state).otherwise(F.flatten(parts))

        return let(F.array_min(state), join)

    folded = F.aggregate(F.sequence(F.lit(1), F.size(word) - 3), word, step)
    return F.when(F.size(word) < 2, word).when(F.element_at(word, 1) < 0, F.slice(word, F.lit(2), F.size(word))).otherwise(let(folded, lambda x: F.slice(x, F.lit(2), F.size(x) - 2)))


def merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The merges of the fold on a long word, with a heap of (rank, place) in place of a search."""
    after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get(ids[i] << ID_BITS | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        low, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(ids) or ids[i] != left or ids[j] != right:
            continue  # one of the two has been merged with another since
        ids[i], alive[j], after[i] = low, False, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else len(ids)
            if b < len(ids) and (r := pairs.get(ids[a] << ID_BITS | ids[b])) is not None:
                heapq.heappush(heap, (r, a, ids[a], ids[b]))
    return [x for x, here in zip(ids, alive) if here]


@lru_cache(maxsize=2)
def newer_letters(pattern: str) -> str:
    """Code points that this splitter takes for letters, digits or white space, and the tokenizer's library, with older
    tables, for unassigned ones. Each is tried next to a letter, a mark and a digit, with a vocabulary whose only merges
    join these to the first byte of the code point: they merge if and only if the library does not split."""
    try:
        import tiktoken
    except ImportError:
        return ""
    known = regex.compile(r"[\p{L}\p{N}\s]")
    newer = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.category(c) == "Cn" and known.match(c)]
    ranks = {bytes([i]): i for i in range(256)}
    for first in sorted({c.encode()[:1] for c in newer}):
        for mark in (b"a", b"!", b"1"):
            ranks[mark + first] = len(ranks)
    probe, split = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)
    return "".join(c for c in newer if any((probe.encode_ordinary(m + c)[0] > 255) != (len(split.findall(m + c)) == 1) for m in "a!1"))


#: Printable Latin letters, digits and marks, which both regular expression libraries class alike.
_PLAIN = r"\t\n\r\x20-\x7e¡-¬®-ſ"
_ODD = re.compile(f"[^{_PLAIN}]")


@lru_cache(maxsize=2)
def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for such texts with its classes written out, which the standard library matches faster; none if it
    uses other classes."""
    plain = [c for c in map(chr, range(0x180)) if not _ODD.match(c)]
    kinds = lambda first: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == first)
    written = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{kinds('L')}{kinds('N')}]").replace(r"\p{L}", f"[{kinds('L')}]").replace(r"\p{N}", f"[{kinds('N')}]")
    try:
        return re.compile(written)
    except re.error:
        return None


#: A code point that no table has assigned.
UNASSIGNED = "\u0378"


class Splitter:
    """Matches of the pattern in texts, and the ids of the bytes of a word."""

    def __init__(self, pattern: str, newer: str, ranks: dict[bytes, int]):
        self.pattern, self.ranks = regex.compile(pattern), ranks
        self.newer, self.odd = dict.fromkeys(map(ord, newer), UNASSIGNED), None
        if newer:
            codes = sorted(map(ord, newer))
            cuts = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1), len(codes)]
            self.odd = regex.compile("[" + "".join(f"\\U{codes[a]:08x}-\\U{codes[b - 1]:08x}" for a, b in zip(cuts, cuts[1:])) + "]")
        self.plain = plain_pattern(pattern)
        self.pairs: dict[int, int] = {}
        self.bytes = np.array([ranks.get(bytes([i]), EDGE) for i in range(256)], np.int64)
        #: Ranks of the pairs of single bytes.
        self.first = np.array([[ranks.get(bytes([i, j]), NO_RANK) for j in range(256)] for i in range(256)], np.int64)

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.plain and not _ODD.search(text):
            return self.plain.findall(text)
        if self.odd and not text.isascii() and self.odd.search(text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.newer))]
        return self.pattern.findall(text)

    def starts(self, words: list[str]) -> pa.ListArray:
        """What the fold starts from, for each word: its state of single bytes, or the id of a word that is a token, or -1
        and the final ids of a long word."""
        each = [w.encode() for w in words]
        n = np.fromiter(map(len, each), np.int64, len(each))
        whole = np.fromiter((self.ranks.get(w, -1) for w in each), np.int64, len(each))
        raw = np.frombuffer(b"".join(each), np.uint8)
        ends = np.cumsum(n)
        rank = np.full(len(raw), NO_RANK, np.int64)
        rank[:-1] = self.first[raw[:-1], raw[1:]]
        rank[ends - 1] = NO_RANK
        place = np.arange(len(raw)) - np.repeat(ends - n, n) + 1
        sizes = np.where(whole >= 0, 1, n + 2)
        starts = np.cumsum(sizes) - sizes
        flat = np.full(int(sizes.sum()), END, np.int64)
        folds = np.repeat(whole < 0, n)
        flat[(np.repeat(starts, n) + place)[folds]] = (rank << PLACE_BITS + ID_BITS | place << ID_BITS | self.bytes[raw])[folds]
        flat[starts[whole >= 0]] = whole[whole >= 0]
        long = sizes > LONG_WORD + 2
        if long.any():
            self.pairs = self.pairs or pair_ranks(self.ranks)
            parts = [[-1, *merge_long(self.bytes[np.frombuffer(w, np.uint8)].tolist(), self.pairs)] if x else p for w, x, p in zip(each, long, np.split(flat, starts[1:]))]
            flat, sizes = np.concatenate([np.asarray(p, np.int64) for p in parts]), np.array([len(p) for p in parts])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat, pa.int64()))


class Words:
    """Ids of the words of a task, by number."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.count = 0
        self.used = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        for name, more, used in (("ids", len(flat), self.used), ("ends", len(sizes) + 1, self.count + 1)):
            old = getattr(self, name)
            if used + more > len(old):
                new = np.zeros(max(2 * len(old), used + more), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[self.count + 1 : self.count + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.count += len(sizes)

    def text(self, words: np.ndarray) -> np.ndarray:
        """Ids of a text, of the numbers of its words."""
        starts = self.ends[words]
        sizes = self.ends[words + 1] - starts
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def coalesced(docs: DataFrame) -> DataFrame:
    """Tasks of at least ``TASK_BYTES`` of input, but one for each core if there are so many splits; no shuffle."""
    spark = docs.sparkSession
    splits = docs.rdd.getNumPartitions()
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return docs.coalesce(max(1, spark.sparkContext.defaultParallelism, -(-splits * size // TASK_BYTES)))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """``doc_id, ids array<int>`` of every text; with ``digest`` the contract rows in its place."""
    path, pattern = path or default_path(), pattern or default_pattern()
    ranks = read_ranks(path)
    splitter = Splitter(pattern, newer_letters(pattern), ranks)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    def number(batches):
        known: dict[str, int] = {}
        for batch in sliced(batches):
            rows, new, ends = [], [], [0]
            for text in batch.column(1).to_pylist():
                words = splitter.words(text)
                fresh = [w for w in dict.fromkeys(words) if w not in known]
                known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                new += fresh
                ends.append(len(new))
                rows.append(np.fromiter(map(known.__getitem__, words), "<i4", len(words)).tobytes())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), splitter.starts(new))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), lists], ["doc_id", "words", "new"])

    def assemble(batches):
        table = Words()
        for batch in batches:
            lists = batch.column(2)
            table.add(lists.flatten().flatten().to_numpy(zero_copy_only=False) & EDGE, lists.flatten().value_lengths().to_numpy(zero_copy_only=False))
            for part in sliced([batch], "words"):
                ids = [table.text(np.frombuffer(w, "<i4")).astype("<u4") for w in part.column(1).to_pylist()]
                if not digest:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])
                    continue
                back = [hashlib.sha256(decode_ids(x.tolist(), pieces)).hexdigest() for x in ids]
                columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    literal, times, size = rank_literal(path)
    numbered = coalesced(docs.select("doc_id", "text")).mapInArrow(number, "doc_id long, words binary, new array<array<bigint>>")
    ids = let(literal, lambda t: F.transform("new", lambda w: merged(w, t, times, size)))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>"
    return numbered.select("doc_id", "words", ids.alias("new")).mapInArrow(assemble, schema)


def decode_ids(ids: list[int], pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, ids))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, decoded binary`` of ``encoded(doc_id, ids)``; null ids decode to null. An id outside the vocabulary
    raises ``IndexError``."""
    ranks = read_ranks(path or default_path())
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece

    def join(batches):
        for batch in batches:
            texts = [None if x is None else decode_ids(x, pieces) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id long, decoded binary")


def encoding_digests(docs: DataFrame) -> DataFrame:
    """Contract rows."""
    return encode(docs, digest=True)
