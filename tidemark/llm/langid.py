"""Language identification, word first: known words score by their log frequency in each language, unseen words back
off to the longest of their character n-grams (4, 3, 2, 1) that are known.

The model is fitted to a bounded sample of labelled texts: at most ``ROWS_PER_LANGUAGE`` of each language, and
``ROWS`` in all (but one of each language), those with the smallest hashes of their text; copies of a text count once.
All words and n-grams of these texts enter the model, each with its counts in the languages that have it. So the model
that travels to the tasks is bounded by the sample, however many languages there are, and prediction is one narrow pass
over all whole texts. Words are told apart by 64 bits of a hash.
``lang``, ``source`` and ``doc_id`` never enter a prediction.

Defined results: ``und`` with score 0 if the text is null or has no letters; also if nothing could be learned (no
labelled rows). Ties go to the language that sorts first. A text of unknown characters only has equal scores. Repeated
rows get equal results; an empty table gives an empty one. Columns ``lang_pred``, ``score`` and ``known`` of the input
are replaced by ``predict`` and kept by ``keep_identified``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import begin, durable, forget, sliced, unused

UNKNOWN = "und"
#: Most texts of the sample, of one language and of all.
ROWS_PER_LANGUAGE, ROWS = 2000, 100_000
LONGEST = 4
SMOOTH = 0.5
#: Words whose scores a Python worker keeps, and numbers that these scores may be.
TABLE_SIZE, TABLE_NUMBERS = 300_000, 6_000_000
#: A word counts as known if it, or an n-gram of so many characters (ends of the word included), was seen.
EVIDENCE = 3
#: Share of its words that a document of a known language must have known.
LEAST_KNOWN = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case; signs such as raised digits may stand between them, not alone."""
    return [w for w in _LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; single characters without the marks."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


@dataclass
class Table:
    """Log frequencies of words or n-grams by language: sorted hashes, for each of them the languages that have it and
    their values (from ``starts[i]`` to ``starts[i + 1]``), and the value of languages that do not."""

    keys: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    values: np.ndarray
    unseen: np.ndarray
    whole: np.ndarray | None = None

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Scores of keys in all languages."""
        scores = np.tile(self.unseen, (len(at), 1))
        n = self.starts[at + 1] - self.starts[at]
        entries = np.arange(int(n.sum())) + np.repeat(self.starts[at] - (np.cumsum(n) - n), n)
        scores[np.repeat(np.arange(len(at)), n), self.languages[entries]] = self.values[entries]
        return scores

    def spread(self) -> None:
        """In a worker: keep all rows, if they are no more than ``TABLE_NUMBERS`` numbers, which finds them faster."""
        if self.whole is None and len(self.keys) * len(self.unseen) <= TABLE_NUMBERS:
            self.whole = self.rows(np.arange(len(self.keys)))

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which texts are known, and the scores in all languages of those that are."""
        wanted = np.fromiter(map(_key, texts), np.uint64, len(texts))
        if not len(self.keys):
            return np.zeros(len(texts), bool), np.zeros((0, len(self.unseen)))
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        return known, self.rows(at[known]) if self.whole is None else self.whole[at[known]]


_NOTHING = Table(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: Table

    def scores(self, words: list[str]) -> np.ndarray:
        """Log frequency by language, of an unseen word the mean over the longest n-grams that are known; in the last
        column, whether the word counts as known."""
        out = np.zeros((len(words), len(self.languages) + 1))
        seen, rows = self.words.find(words)
        out[seen, :-1], out[seen, -1] = rows, 1
        for i in np.flatnonzero(~seen).tolist():
            for n in range(LONGEST, 0, -1):
                known, rows = self.grams.find(grams(words[i], n))
                if known.any():
                    out[i, :-1], out[i, -1] = rows.mean(axis=0), n >= EVIDENCE
                    break
        return out


class Scorer:
    """Predicts with a table of the scores of words met so far, which starts anew when it is full."""

    def __init__(self, model: Model):
        self.model = model
        model.words.spread()
        model.grams.spread()
        self.size = max(1024, min(TABLE_SIZE, TABLE_NUMBERS // (len(model.languages) + 1)))
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages) + 1))

    def _learn(self, found: list[str]) -> None:
        new = [w for w in dict.fromkeys(found) if w not in self.at]
        if len(self.at) + len(new) > self.size and self.at:
            self._empty()
            new = list(dict.fromkeys(found))
        first = len(self.at)
        if first + len(new) > len(self.rows):
            more = np.zeros((max(first + len(new), 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]))
            self.rows = np.concatenate([self.rows, more])
        self.rows[first : first + len(new)] = self.model.scores(new)
        self.at.update(zip(new, range(first, first + len(new))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, share of known words) of each text."""
        each, out = [words(t) for t in texts], []
        low = 0
        while self.model.languages and low < len(each):  # as many texts at a time as the table has room for
            high, n = low + 1, len(each[low])
            while high < len(each) and n + len(each[high]) <= self.size:
                n += len(each[high])
                high += 1
            self._learn([w for found in each[low:high] for w in found])
            out += map(self._best, each[low:high])
            low = high
        return out or [(UNKNOWN, 0.0, 0.0)] * len(each)

    def _best(self, found: list[str]) -> tuple[str, float, float]:
        """(language, score, share of known words) of the words of a text, which the table knows."""
        if not found:
            return UNKNOWN, 0.0, 0.0
        total = self.rows[np.fromiter(map(self.at.__getitem__, found), np.int64, len(found))].sum(axis=0)
        scores = total[:-1]
        best = int(scores.argmax())
        return self.model.languages[best], float(1.0 / np.exp(scores - scores[best]).sum()), float(total[-1] / len(found))


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _log_frequencies(counted: pa.Table, languages: list[str]) -> Table:
    """From rows (key, lang, n): every key, with its counts in the languages that have it."""
    keys, at = np.unique(np.fromiter(map(_key, counted.column(0).to_pylist()), np.uint64, len(counted)), return_inverse=True)
    column = {name: i for i, name in enumerate(languages)}
    cells, of = np.unique(at * len(languages) + np.fromiter(map(column.__getitem__, counted.column(1).to_pylist()), np.int64, len(counted)), return_inverse=True)
    counts = np.bincount(of, counted.column(2).to_numpy(), len(cells))
    row, lang = np.divmod(cells, len(languages))
    whole = np.log(np.bincount(lang, counts, len(languages)) + SMOOTH * max(1, len(keys)))
    return Table(keys, np.searchsorted(row, np.arange(len(keys) + 1)), lang, np.log(counts + SMOOTH) - whole[lang], np.log(SMOOTH) - whole)


def labelled_sample(docs: DataFrame, rows_per_language: int, rows: int) -> tuple[DataFrame, list[str]]:
    """``lang, text`` of the sample, and all languages.

    Texts are first thinned out by their hash, at the rate that the size of their language needs (rates are as many
    numbers as the model has languages); then copies go, and of each language the smallest hashes stay.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return labelled.select("lang", "text"), []
    most, steps = max(1, min(rows_per_language, rows // len(sizes))), 1 << 40
    rates = docs.sparkSession.createDataFrame([(name, int(min(1.0, (2 * most + 20) / n) * steps)) for name, n in sizes.items()], "lang string, rate long")
    hashed = labelled.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(steps)))
    thin = hashed.join(F.broadcast(rates), "lang").where(F.col("h") < F.col("rate")).dropDuplicates(["lang", "h"])
    first = Window.partitionBy("lang").orderBy("h")
    return thin.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("lang", "text"), sorted(sizes)


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS) -> Model:
    """Fit to the labelled texts that are not held out."""
    sample, languages = labelled_sample(docs, rows_per_language, rows)  # languages are the columns of the model
    if not languages:
        return Model([], _NOTHING, _NOTHING)

    def counts(found: Counter, name: str) -> pa.RecordBatch:
        keys = list(found)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], ["lang", name, "n"])

    def count_words(batches):
        begin("langid")
        for batch in sliced(batches):
            found = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, w) for w in words(text))
            yield counts(found, "word")

    def count_grams(batches):
        for batch in sliced(batches, "word", 1 << 18):
            found = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        found[lang, g] += n
            yield counts(found, "gram")

    counted = durable(sample.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    spelled = counted.mapInArrow(count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = Model(languages, *(_log_frequencies(rows.select(key, "lang", "n").toArrow(), languages) for rows, key in ((counted, "word"), (spelled, "gram"))))
    forget(counted)
    return model


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """``docs`` with language, score and share of known words in the columns ``names`` (which are replaced); all other
    columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample
    kept = [f for f in docs.schema if f.name not in names]

    def score(batches):
        begin("langid")
        scorer = Scorer(sent.value)
        for batch in sliced(batches):
            found = scorer.predict(batch.column("text").to_pylist())
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    schema = type(docs.schema)(list(kept)).add(names[0], "string").add(names[1], "double").add(names[2], "double")
    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(score, schema)


def language_rows(docs: DataFrame) -> DataFrame:
    """Contract rows: trained on the labelled documents of ``docs``, predicted for all."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_known: float = LEAST_KNOWN) -> DataFrame:
    """``docs`` without documents in no known language: those without letters (``und``), and those of whose words less
    than ``least_known`` are known. If nothing could be learned, all documents with letters stay."""
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = tuple(unused(n, docs.columns) for n in ("lang_pred", "score", "known"))
    found = predict(docs, model, names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) >= least_known)).select(*(f"`{c}`" for c in docs.columns))
