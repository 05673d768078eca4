"""The fold of merges: its state starts with ranks and places, and no step searches the array."""

import random

from pyspark.sql import functions as F

from tidemark.llm import bytebpe


def test_fold_of_words_against_the_heap(spark):
    """Ties, overlapping pairs, and words up to the longest that the fold takes."""
    ranks = bytebpe.read_ranks(bytebpe.default_path())
    rng = random.Random(5)
    words = ["a" * n for n in range(1, bytebpe.LONG_WORD + 1)] + ["é" * n for n in range(1, 50)] + [" the" * 20, "͸ab", "aaab" * 25]
    words += ["".join(rng.choice("abeénrst ") for _ in range(rng.randrange(1, 80))) for _ in range(800)]
    words = [w for w in words if len(w.encode()) <= bytebpe.LONG_WORD]
    pairs = bytebpe.pair_ranks(ranks)
    want = [bytebpe.merge_long([ranks[bytes([b])] for b in w.encode()], pairs) for w in words]
    rows = bytebpe.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), pattern=r"(?s).+").collect()
    got = {r.doc_id: list(r.ids) for r in rows}
    assert [w for i, w in enumerate(words) if got[i] != (want[i] if w.encode() not in ranks else [ranks[w.encode()]])] == []


def test_fold_does_not_search(spark):
    """``array_position`` leaves its loop by an exception; each step takes the place from the state."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    assert "array_position" not in bytebpe.encode(docs)._jdf.queryExecution().analyzed().toString()


def test_fold_is_computed_once(spark):
    """Interpreted expressions are not shared: a fold that is named twice in the plan is computed twice for each word."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    plan = bytebpe.encode(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
