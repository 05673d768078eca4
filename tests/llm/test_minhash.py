"""The near-duplicate stage against brute-force Jaccard similarity."""

import random

from tidemark.llm import minhash
from tidemark.llm.simhash import shingle_hashes


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def brute_roots(texts):
    sets = {i: set(shingle_hashes(t, 5)) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root


def test_stage_links_what_is_alike(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(3)
    base = [[f"w{rng.randrange(4000)}" for _ in range(200)] for _ in range(12)]
    texts = [edited(rng, words, n) for words in base for n in (0, 0, 1, 2, 3, 4, 6, 12)] + ["", "too short", "Too  Short", None]
    texts = dict(enumerate(texts))
    want = brute_roots(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(want.values())
    monkeypatch.setattr(minhash, "SMALL", 1)  # centres only
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def roots_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}


def test_pairs_inside_one_large_meeting(spark):
    """120 pairs of texts that all share a passage: about 0.84 alike within a pair, 0.76 between strangers."""
    rng = random.Random(11)
    passage = [f"c{i}" for i in range(180)]
    texts = []
    for i in range(120):
        own = [f"p{i}x{j}" for j in range(28)]
        other = own[:22] + [f"q{i}x{j}" for j in range(6)]
        texts += [" ".join(passage + own), " ".join(passage + other)]
    rng.shuffle(texts)
    got = roots_of(spark, texts)
    assert got == brute_roots(dict(enumerate(texts))) and len(set(got.values())) == 120


def test_meetings_inside_meetings(spark, monkeypatch):
    """Passages shared by all, by half and by fifths of the texts, and families of edited copies between them."""
    monkeypatch.setattr(minhash, "SMALL", 3)
    rng = random.Random(12)
    shared = {("all", 0): 60} | {("half", h): 40 for h in range(2)} | {("fifth", f): 25 for f in range(5)}
    passages = {k: [f"{k[0]}{k[1]}w{i}" for i in range(n)] for k, n in shared.items()}
    texts = []
    for i in range(90):
        body = passages["all", 0] + (passages["half", i % 2] if i % 3 else []) + (passages["fifth", i % 5] if i % 4 else [])
        own = body + [f"o{i}x{j}" for j in range(rng.choice([3, 12, 30]))]
        texts.append(" ".join(own))
        texts += [edited(rng, own, rng.choice([0, 1, 2, 3])) for _ in range(i % 3)]
    rng.shuffle(texts)
    assert roots_of(spark, texts) == brute_roots(dict(enumerate(texts)))
