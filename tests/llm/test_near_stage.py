"""The near-duplicate stage takes SimHash balls first, verified on the sets; MinHash takes the rest."""

import random

from pyspark.sql import functions as F

from tidemark.llm import minhash, simhash
from tidemark.llm.simhash import shingle_hashes

from .test_minhash import brute_roots, edited


def distances(distinct):
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in distinct.select("doc_id", "fp").collect()}
    return {(a, b): (fps[a] ^ fps[b]).bit_count() for a in fps for b in fps if b < a}


def test_balls_link_without_minhash(spark):
    """Texts whose band keys never meet link if they are alike and their fingerprints are near, and only then."""
    rng = random.Random(21)
    base = [[f"w{rng.randrange(4000)}" for _ in range(400)] for _ in range(15)]
    texts = dict(enumerate(edited(rng, words, n) for words in base for n in (0, 1, 1)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    distinct = minhash.prints(docs, 5).withColumn("keys", F.array(F.col("doc_id"))).select("doc_id", "keys", "size", "fp")
    want = {p for p, d in distances(distinct).items() if d <= simhash.RADIUS}
    roots = {r.node: r.root for r in minhash.links(distinct, docs, 5).collect()}
    assert want and all(roots.get(a, a) == roots.get(b, b) for a, b in want)
    assert set(roots.values()) <= {b for _, b in want} and {a // 3 for a, _ in want} == {a // 3 for a in roots}


def test_balls_are_verified(spark):
    """One fingerprint does not make texts alike: repeats weigh in it, and the sets differ."""
    rng = random.Random(22)
    often = " ".join(f"a{i}" for i in range(30))
    texts = {i: f"{often} " * 60 + " ".join(f"o{i}x{rng.randrange(10**6)}" for _ in range(60)) for i in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    distinct = minhash.prints(docs, 5).select("doc_id", "keys", "size", "fp")
    assert minhash.balls(distinct).count() > 0
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == brute_roots(texts) == {i: i for i in texts}


def test_fingerprints_of_the_stage_are_those_of_the_operator(spark):
    texts = ["A b c d e f g", "", None, "too short", "x " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.fp for r in simhash.fingerprints(docs, 5).collect()}
    assert {r.doc_id: r.fp for r in minhash.prints(docs, 5).collect()} == want and shingle_hashes(None, 5) == []
