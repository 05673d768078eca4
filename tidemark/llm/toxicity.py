"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel compares two strings by the subsequences of ``SIZES`` letters that they share. Each occurrence counts
``DECAY`` to the power of the characters it spans, ``SPAN`` at most; digits and signs are only gaps. So ``i-d-i-o-t`` and
``idxiot`` stay near ``idiot``. The kernel is normalised, K(s, t) / sqrt(K(s, s) K(t, t)). A Nyström map from kernel
values with landmark strings makes the machine linear; since the kernel is an inner product over subsequences, the
trained machine folds into one weight for each subsequence of the landmarks, and scoring needs no landmarks any more.

Strings are the pieces of sentences: words in lower case with marks on letters removed and signs at both ends cut off,
runs of three or more single letters joined, pieces of more than ``WINDOW`` characters as overlapping windows. A
sentence scores as its best piece, a document as its best sentence.

Labels are those of documents, so training finds the sentences that earn them. Distinct sentences are counted by
string (copies of a text count once); strings whose sentences come from toxic documents, beyond chance, mark toxic
sentences, and sentences of clean documents are the clean ones. A sentence trains by its strings: the marking ones and
their virtual examples on one side, the strings of clean sentences on the other. After each of ``ROUNDS`` fits the
clean strings that score highest join, as examples and landmarks. A logistic curve over the sample's documents turns
best scores into 0..1.

Bounds: the labelled sample has at most ``DOCUMENTS`` documents of each label (those with the smallest hashes of
doc_id); the driver gets at most ``MARKS`` marking strings, ``STRINGS`` clean ones and ``HARDEST`` hard ones a round,
and one number for each document of the sample. Scoring is one narrow pass over all whole texts, with a table of the
strings met so far.

Defined results: a null or empty text scores as one without evidence. Without labels of both kinds, or if nothing sets
toxic documents apart, every score is 0. A document labelled twice is toxic if any of its labels is. Null doc_ids have no label.
Repeated rows get equal scores. Ties of hashes are broken by doc_id. ``doc_id`` of any whole type is taken as long.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import begin, durable, forget, sliced

SIZES, DECAY, SPAN = (3, 4), 0.6, 8
#: Longest string; longer pieces are windows of so many characters, half of it apart.
WINDOW = 18
#: Documents of each label in the sample.
DOCUMENTS = 4000
#: Strings that the driver gets: marks of toxic sentences, clean ones, and hard clean ones in each of so many rounds.
MARKS, STRINGS, HARDEST, ROUNDS = 500, 16_000, 4_000, 3
LANDMARKS = 512
#: Cost of an error on a string that stands for one sentence.
COST = 10.0
#: Sentences that one toxic string, or one clean string, counts for at most.
MOST_TOXIC, MOST_CLEAN = 50, 200
#: A mark's rate in toxic documents is so many times its rate in clean ones, and its log-likelihood ratio so large.
CONTRAST, LEAST_RATIO = 20.0, 24.0
#: Strings whose scores a Python worker keeps.
TABLE_SIZE = 300_000
#: Letters are classes 1..26, other letters 27, digits and signs 0.
_KINDS = 28
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")


# --- strings --------------------------------------------------------------------------------------------------------


def plain(word: str) -> str:
    """A word in lower case, without marks on letters and without what is no letter at its ends."""
    word = word.lower()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    if word.isalpha():
        return word
    low, high = 0, len(word)
    while low < high and not word[low].isalpha():
        low += 1
    while high > low and not word[high - 1].isalpha():
        high -= 1
    return word[low:high]


def windows(piece: str) -> list[str]:
    if len(piece) <= WINDOW:
        return [piece]
    return [piece[i : i + WINDOW] for i in range(0, len(piece) - WINDOW // 2, WINDOW // 2)]


def spelled_out(words: list[str]) -> list[str]:
    """Runs of three or more single letters, joined."""
    out, run = [], []
    for word in [*words, ""]:
        if len(word) == 1:
            run.append(word)
            continue
        if len(run) >= 3:
            out += windows("".join(run))
        run = []
    return out


class Strings:
    """The strings of texts; ``plain`` of each distinct word is worked out once."""

    def __init__(self):
        self.plain: dict[str, str] = {}

    def of(self, text: str) -> set[str]:
        words = text.split()
        new = set(words).difference(self.plain)
        if len(self.plain) + len(new) > TABLE_SIZE:
            self.plain.clear()
            new = set(words)
        self.plain.update((w, plain(w)) for w in new)
        found = set(map(self.plain.__getitem__, set(words)))
        out = {w for w in found if min(SIZES) <= len(w) <= WINDOW}
        for long in (w for w in found if len(w) > WINDOW):
            out.update(windows(long))
        if any(len(w) == 1 for w in found):
            out.update(spelled_out(list(map(self.plain.__getitem__, words))))
        return out


# --- kernel ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _places(length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of ``size`` within ``SPAN`` in a string, and the weight of each."""
    rows = [(i, *(i + j for j in rest)) for i in range(length) for rest in combinations(range(1, min(SPAN, length - i)), size - 1)]
    places = np.array(rows, np.int64).reshape(-1, size)
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32)


def _classes(strings: list[str], length: int) -> np.ndarray:
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), length)
    out = np.where((points >= 97) & (points <= 122), points - 96, 0).astype(np.int32)
    odd = points > 127
    if odd.any():
        letters = {p: 27 for p in np.unique(points[odd]).tolist() if chr(p).isalpha()}
        out[odd] = [letters.get(p, 0) for p in points[odd].tolist()]
    return out


SUBSEQUENCES = sum(_KINDS**k for k in SIZES)


def subsequences(strings: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For strings of one length: numbers of their subsequences (0: none, a gap is in it) and the weights."""
    kinds = _classes(strings, length)
    numbers, weights, base = [], [], 0
    for size in SIZES:
        places, weight = _places(length, size)
        code, gap = np.full((len(strings), len(places)), base, np.int32), np.zeros((len(strings), len(places)), bool)
        power = 1
        for k in range(size):
            column = kinds[:, places[:, k]]
            code += column * power
            gap |= column == 0
            power *= _KINDS
        code[gap] = 0
        numbers.append(code)
        weights.append(weight)
        base += power
    return np.concatenate(numbers, axis=1), np.concatenate(weights)


def norms(numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """sqrt(K(s, s)) of each row: equal subsequences add up before they are squared."""
    order = np.argsort(numbers, axis=1)
    sorted_numbers = np.take_along_axis(numbers, order, axis=1)
    sums = np.zeros((len(numbers), numbers.shape[1] + 1))
    np.cumsum(np.where(sorted_numbers > 0, weights[order], 0), axis=1, out=sums[:, 1:])
    last = np.ones(numbers.shape, bool)
    last[:, :-1] = sorted_numbers[:, 1:] != sorted_numbers[:, :-1]
    row, at = np.nonzero(last)
    ends = sums[row, at + 1]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    totals = ends - np.where(first, 0, np.concatenate(([0], ends[:-1])))
    return np.sqrt(np.bincount(row, totals**2, len(numbers)))


def by_length(strings: list[str], most: int = 1 << 21):
    """Places of the strings of equal length, in parts of at most ``most`` subsequences."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    for length in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == length)
        rows = max(1, most // max(1, sum(len(_places(length, size)[0]) for size in SIZES)))
        for low in range(0, len(where), rows):
            yield length, where[low : low + rows]


@dataclass
class Machine:
    """Weight of every subsequence (none for number 0), bias, and the logistic curve over scores."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    centre: float = 0.0

    def scores(self, strings: list[str]) -> np.ndarray:
        """Decision value of each string; strings with nothing that speaks for toxicity have the bias."""
        out = np.full(len(strings), self.bias)
        for length, where in by_length(strings):
            some = [strings[i] for i in where.tolist()]
            numbers, weights = subsequences(some, length)
            value = self.weight[numbers] @ weights
            speaks = np.flatnonzero(value > 0)
            if len(speaks):
                out[where[speaks]] += value[speaks] / norms(numbers[speaks], weights)
        return out

    def share(self, best: float) -> float:
        """The score of a document, 0..1, by that of its best string."""
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * (best - self.centre)))))


class Scorer:
    """Best strings of texts, with a table of the strings met so far, which starts anew when it is full."""

    def __init__(self, machine: Machine):
        self.machine, self.strings, self.known = machine, Strings(), {}

    def best(self, texts: list[str | None]) -> list[float]:
        each = [self.strings.of(t) if t else set() for t in texts]
        new = set().union(*each).difference(self.known) if each else set()
        if len(self.known) + len(new) > TABLE_SIZE:
            self.known.clear()
            new = set().union(*each)
        new = list(new)
        self.known.update(zip(new, self.machine.scores(new).tolist()))
        get = self.known.__getitem__
        return [max(map(get, found), default=self.machine.bias) for found in each]


# --- training -------------------------------------------------------------------------------------------------------


def _kernel_rows(strings: list[str], columns: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel values with the landmarks, whose unit vectors over the ``columns`` are given."""
    at = np.full(SUBSEQUENCES, -1, np.int32)
    at[columns] = np.arange(len(columns))
    out = np.zeros((len(strings), landmarks.shape[0]))
    for length, where in by_length(strings, 1 << 18):
        numbers, weights = subsequences([strings[i] for i in where.tolist()], length)
        size, rows = norms(numbers, weights), max(1, (1 << 22) // len(columns))
        for low in range(0, len(where), rows):
            part = numbers[low : low + rows]
            row, place = np.nonzero((part > 0) & (at[part] >= 0))
            dense = np.zeros((len(part), len(columns)), np.float32)
            np.add.at(dense, (row, at[part[row, place]]), weights[place])
            out[where[low : low + rows]] = (dense @ landmarks.T) / np.maximum(size[low : low + rows], 1e-12)[:, None]
    return out


def _unit_vectors(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all subsequences of some strings, and the strings as unit vectors over them."""
    entries, row_of, size_of = [], [], []
    for length, where in by_length(strings):
        numbers, weights = subsequences([strings[i] for i in where.tolist()], length)
        row, place = np.nonzero(numbers > 0)
        entries.append(numbers[row, place])
        row_of.append(where[row])
        size_of.append(weights[place])
    columns, at = np.unique(np.concatenate(entries), return_inverse=True)
    dense = np.zeros((len(strings), len(columns)), np.float32)
    np.add.at(dense, (np.concatenate(row_of), at), np.concatenate(size_of))
    return columns, dense / np.maximum(np.linalg.norm(dense, axis=1), 1e-12)[:, None]


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps over the rows within the margin."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        inside = y * (x @ w) < 1
        some = x[inside] * cost[inside, None]
        new = np.linalg.solve(np.eye(x.shape[1]) + some.T @ x[inside], some.T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def virtual(string: str) -> list[str]:
    """A string with a gap, or a letter, between two of its letters, and with gaps between all of them: examples of what
    the machine has to tolerate (virtual support vectors)."""
    inner = range(1, len(string))
    return [f"{string[:i]}{sign}{string[i:]}" for i in inner for sign in "-x"] + ["-".join(string)[:WINDOW]]


def fit(toxic: dict[str, int], clean: dict[str, int], hardest: dict[str, int] = {}, cost: float = COST) -> Machine:
    """A machine from toxic strings and clean ones, each with how many sentences it stands for. Landmarks are the toxic
    strings that stand for most, the hardest clean ones, and other clean ones at even distances."""
    known = {*clean, *hardest}
    grown: dict[str, float] = {}
    for string, n in toxic.items():
        grown[string] = max(grown.get(string, 0), min(n, MOST_TOXIC))
        for other in virtual(string):
            if other not in known:
                grown[other] = max(grown.get(other, 0), min(n, MOST_TOXIC) / (2 * len(string)))
    negative = {**hardest, **clean}
    strings = [*grown, *negative]
    y = np.array([1.0] * len(grown) + [-1.0] * len(negative))
    weigh = np.array([*grown.values(), *(min(n, MOST_CLEAN) for n in negative.values())], float)
    third = LANDMARKS // 3
    spread = [w for w in clean if w not in hardest]
    chosen = sorted(toxic, key=lambda w: (-toxic[w], w))[:third] + list(hardest)[:third] + spread[:: max(1, len(spread) // third)][:third]
    columns, landmarks = _unit_vectors(chosen)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
    keep = values > 1e-5 * values.max()
    to_features = vectors[:, keep] / np.sqrt(values[keep])
    features = np.column_stack([_kernel_rows(strings, columns, landmarks) @ to_features, np.ones(len(strings))])
    w = _squared_hinge(features, y, cost * weigh)
    weight = np.zeros(SUBSEQUENCES, np.float32)
    weight[columns] = (to_features @ w[:-1]) @ landmarks
    weight[0] = 0
    return Machine(weight, float(w[-1]))


def held_out(doc_id):
    """Whether a document's label is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, documents: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``doc_id`` and ``toxic`` of at most ``documents`` labelled documents of each label, and by label how many there
    are in the sample and in all."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    known = durable(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    all_of = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    first = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents) for k in (0, 1)]
    return first[0].unionByName(first[1]), {k: (min(documents, n), n) for k, n in all_of.items()}


def sentence_counts(texts: DataFrame) -> DataFrame:
    """``string``, ``toxic_n`` and ``clean_n``: distinct sentences by string, from ``text`` and ``toxic``."""
    def cut(batches):
        begin("toxicity")
        strings = Strings()
        for batch in sliced(batches):
            found = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for sentence in _SENTENCE.split(text or ""):
                    some = strings.of(sentence)
                    if some:
                        number = xxhash.xxh64_intdigest(sentence.encode("utf-8", "surrogatepass")) >> 1
                        found.update((s, toxic, number) for s in some)
            found = list(found)
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["string", "toxic", "sentence"])

    cut_up = texts.select("text", "toxic").mapInArrow(cut, "string string, toxic int, sentence long").distinct()
    return cut_up.groupBy("string").agg(F.count_if(F.col("toxic") == 1).alias("toxic_n"), F.count_if(F.col("toxic") == 0).alias("clean_n"))


def _marks(counted: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Strings that mark toxic sentences, with ``toxic_n``."""
    a, b = F.col("toxic_n").cast("double"), F.col("clean_n").cast("double")
    share = toxic / (toxic + clean)
    ratio = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    apart = (a / toxic >= CONTRAST * (b + 0.5) / clean) & (ratio >= LEAST_RATIO)
    return counted.where(F.col("toxic_n") > 0).where(apart).withColumn("ratio", ratio)


def _scored(strings: DataFrame, machine: Machine) -> DataFrame:
    sent = strings.sparkSession.sparkContext.broadcast(machine)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(0).to_pylist()))], [*batch.schema.names, "value"])

    return strings.select("string", "clean_n").mapInArrow(score, "string string, clean_n long, value double")


def best_scores(docs: DataFrame, machine: Machine, column: str = "best") -> DataFrame:
    """``doc_id`` and the decision value of the best string of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches):
        begin("toxicity")
        scorer = Scorer(sent.value)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.best(batch.column(1).to_pylist()), pa.float64())], ["doc_id", column])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, f"doc_id long, {column} double")


def logistic(best: np.ndarray, toxic: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
    """Slope and centre of the curve that gives the share of toxic documents by best score; Newton steps on the
    likelihood with a small penalty, which keeps them finite where the labels are apart."""
    x = np.column_stack([best, np.ones(len(best))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weigh * (p - toxic)) + 0.01 * w
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    a = max(float(w[0]), 0.1)
    return a, -float(w[1]) / a


def train(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS) -> Machine | None:
    """A machine by the labels that are not held out; None if they are all alike or mark nothing."""
    sample, sizes = labelled_sample(labels, documents)
    if len(sizes) < 2:
        return None
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")  # 2 x ``documents`` rows
    counted = durable(sentence_counts(chosen))
    marks = _marks(counted, sizes[1][0], sizes[0][0])
    toxic = {r["string"]: r["toxic_n"] for r in marks.orderBy(F.desc("ratio"), "string").limit(MARKS).collect()}
    if not toxic:
        return None
    plain_ones = counted.where(F.col("clean_n") > 0).join(F.broadcast(marks.select("string")), "string", "left_anti")
    orders = ((F.desc("clean_n"), F.col("string")), (F.xxhash64("string"), F.col("string")))
    clean = {r["string"]: r["clean_n"] for order, most in zip(orders, (STRINGS // 4, STRINGS - STRINGS // 4)) for r in plain_ones.orderBy(*order).limit(most).collect()}
    machine, hardest = fit(toxic, clean), {}
    for _ in range(ROUNDS):
        hard = _scored(plain_ones, machine).orderBy(F.desc("value"), "string").limit(HARDEST).collect()
        hardest = {r["string"]: r["clean_n"] for r in hard}
        machine = fit(toxic, {**clean, **hardest}, hardest)
        clean.update(hardest)
    found = best_scores(chosen, machine).groupBy("doc_id").agg(F.max("best").alias("best")).join(F.broadcast(sample), "doc_id").toArrow()
    is_toxic = found.column("toxic").to_numpy()
    weigh = np.where(is_toxic == 1, sizes[1][1] / sizes[1][0], sizes[0][1] / sizes[0][0])
    machine.slope, machine.centre = logistic(found.column("best").to_numpy(), is_toxic, weigh)
    forget(counted)
    return machine


def toxic_rows(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """Contract rows: trained on the labels of ``labels``, scored for all documents."""
    machine = train(docs, labels, documents)
    if machine is None:
        found = docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("score"))
    else:
        share = 1 / (1 + F.exp(-F.lit(machine.slope) * (F.col("best") - F.lit(machine.centre))))
        found = best_scores(docs, machine).select("doc_id", share.alias("score"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without documents that score ``least`` or more; all columns as they were."""
    machine = train(docs, labels)
    if machine is None:
        return docs
    sent, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index("text")

    def clean(batches):
        begin("toxicity")
        scorer = Scorer(sent.value)
        for batch in sliced(batches):
            keep = [sent.value.share(b) < least for b in scorer.best(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
