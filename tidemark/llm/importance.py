"""Documents drawn towards a target: importance weights over hashed n-grams, and an exact draw of the highest scores.

Two passes over the texts. The first counts features by bucket, one array of ``BUCKETS`` numbers a task; the counts of
documents and target give every bucket a whole-number gain. The second scores each document by that array. A draw adds
Gumbel noise from a hash of doc_id, so the highest scores are a sample without replacement by weight.

The draw sorts nothing as a whole. Whole scores are counted (partial counts before the shuffle), counts are summed from
the top first over ``BINS`` ranges of scores, then inside the ranges that reach the draw, which gives each surviving
score the number of documents before it; documents of one score are numbered by doc_id. Equal rows of a score are
counted, not sorted, so a doc_id that holds a third of all rows is one row until it gets its ranks.

Defined results: a null text has no words and weight 0. A null doc_id counts as empty text in the noise and comes
before other ids of its score. Repeated rows get equal weights and scores, and ranks one after the other. Without
documents of enough words nothing is drawn; empty tables are allowed on both sides. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import durable, sliced

BUCKETS = 10_000
#: Longest run of words that is a feature.
LONGEST = 1
#: Ranges of scores whose counts are summed in one task.
BINS = 4096
SEED = "2024"
#: Features whose bucket a Python worker keeps.
TABLE_SIZE = 400_000
#: A-Z in lower case; other ASCII characters than letters and digits become spaces, bytes of longer characters stay.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in (i + 32 if 65 <= i <= 90 else i for i in range(256)))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def features(found: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by one space."""
    return found + [b" ".join(found[i : i + k]) for k in range(2, longest + 1) for i in range(len(found) - k + 1)]


class Buckets(dict):
    """Value of a feature's bucket, worked out once for each feature that a task meets."""

    def __init__(self, values):
        super().__init__()
        self.values_of = values

    def __missing__(self, feature: bytes):
        if len(self) >= TABLE_SIZE:
            self.clear()
        found = self[feature] = self.values_of[zlib.crc32(feature) % len(self.values_of)]
        return found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket`` and ``n``: features of all whole texts by bucket."""
    def count(batches):
        of, total = Buckets(range(buckets)), np.zeros(buckets, np.int64)
        for batch in sliced(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                some = features(words(text), longest)
                total += np.bincount(np.fromiter(map(of.__getitem__, some), np.int64, len(some)), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(there), "n": pa.array(total[there])})

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """By bucket, how much likelier its features are in ``target``: thousandths of the logarithm, rounded down."""
    def counts(texts):
        held = np.zeros(buckets, np.int64)
        for row in bucket_counts(texts, buckets, longest).collect():  # at most ``buckets`` rows
            held[row["bucket"]] = row["n"]
        return held

    source, wanted = counts(docs), counts(target)
    above, below = float(source.sum() + buckets), float(wanted.sum() + buckets)
    return [math.floor(1000 * math.log((float(t + 1) * above) / (float(s + 1) * below))) for s, t in zip(source.tolist(), wanted.tolist())]


WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def weigh(docs: DataFrame, gain: list[int], longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each whole text; the array of gains is a bounded broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches):
        of = Buckets(sent.value)
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = words(text)
                some = features(found, longest)
                rows.append((len(found), len(some), sum(map(of.__getitem__, some))))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, WEIGHTS)


def noise(doc_id, seed: str = SEED):
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of ``seed:doc_id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int, eligible) -> DataFrame:
    """``scored`` (written already: it is read several times) with ``rank``: 1, 2, ... for the highest ``score`` of the
    eligible rows, ties to smaller ``doc_id``, up to ``percent`` in a hundred of them; null for all others."""
    columns = scored.columns
    able = scored.where(eligible)
    whole = able.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    places = whole["n"] * percent // 100
    if not places:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    width = (whole["high"] - whole["low"]) // BINS + 1
    of_bin = F.floor((F.col("score") - F.lit(whole["low"])) / F.lit(width))
    counted = durable(able.groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", of_bin))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    bins = counted.groupBy("bin").agg(F.sum("n").alias("n")).select("bin", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    inside = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    reached = counted.join(F.broadcast(bins.where(F.col("above") < places)), "bin")
    reached = reached.select("score", (F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before")).where(F.col("before") < places)
    cut = reached.agg(F.min("score")).first()[0]

    drawn = able.where(F.col("score") >= cut).groupBy(*columns).agg(F.count("*").alias("_rows"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), *(c for c in columns if c not in ("score", "doc_id")))
    numbered = drawn.join(reached, "score").withColumn("_to", F.col("before") + F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranks = numbered.select(*columns, F.explode(F.sequence(F.col("_to") - F.col("_rows") + 1, F.col("_to"))).alias("rank"))
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= places, F.col("rank")))
    rest = scored.where(~F.coalesce(eligible & (F.col("score") >= cut), F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranks.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` numbers the ``percent`` in a hundred
    drawn of the documents with ``least_words`` words or more."""
    weighed = weigh(docs, gains(docs, target, buckets, longest), longest)
    scored = durable(weighed.withColumn("score", F.col("weight") + noise("doc_id", seed)))
    return draw(scored, percent, F.col("n_words") >= least_words).drop("n_words")


#: DuckDB SQL of ``resample`` with its defaults. DuckDB has no crc32: the table of 256 numbers is made by rule.
RESAMPLE_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i)) AS steps
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM benchmark
), tokens AS (SELECT r, unnest(words) AS word FROM docs),
spelled AS (SELECT word, hex(encode(word)) AS code FROM (SELECT word FROM tokens UNION SELECT word FROM target)),
hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, (2 * i + 1)::INT, 2))::BIGINT),
    lambda x, b: xor(x >> 8, steps[xor(x & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM spelled, crc
), source AS (SELECT bucket, count(*) AS s FROM tokens JOIN hashed USING (word) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM tokens) AS all_s, (SELECT count(*) FROM target) AS all_t),
gained AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE)
    / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM source FULL JOIN wanted USING (bucket), sums
), weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM tokens JOIN hashed USING (word) JOIN gained USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (r)
), able AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
    (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 AS places
  FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= places THEN place END AS rank FROM able
"""
