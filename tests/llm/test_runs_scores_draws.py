"""Periodic runs, toxicity and importance resampling against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, periodic, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs --------------------------------------------------------------------------------------------------


def plain_runs(words, least=24, times=3):
    """By definition: every maximal stretch of every period, then the smallest period of each stretch."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, kinds = rng.randrange(0, 150), rng.choice([1, 2, 3, 60])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(2 if n > 60 else 0):
        a, p = rng.randrange(n - 30), rng.randrange(1, 12)
        for i in range(a + p, a + rng.randrange(20, n - a)):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (2, 2), (5, 2)])
def test_runs_are_those_of_the_definition(least, times):
    rng = random.Random(least)
    for _ in range(300):
        words = some_words(rng)
        assert [tuple(r) for r in periodic.find_runs(np.array(words, np.int64), least, times).tolist()] == plain_runs(words, least, times)


def test_runs_do_not_depend_on_hashes(monkeypatch):
    """With hashes that all meet, every stretch is found wrong by them and right by its words."""
    monkeypatch.setattr(periodic.Prefixes, "same", lambda self, at, apart, length: np.ones(len(at), bool))
    rng = random.Random(5)
    for _ in range(60):
        words = some_words(rng)
        got = [tuple(r) for r in periodic.find_runs(np.array(words, np.int64)).tolist()]
        assert set(got) <= set(plain_runs(words)) or len(words) < 24
        assert all(r in got for r in plain_runs(words) if any(g[2] == r[2] for g in got))


def test_pairs_in_parts_give_the_same(monkeypatch):
    rng = random.Random(6)
    texts = [some_words(rng) for _ in range(40)]
    whole = [periodic.find_runs(np.array(t, np.int64)).tolist() for t in texts]
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert whole == [periodic.find_runs(np.array(t, np.int64)).tolist() for t in texts]


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_digests_of_a_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(F.length("text") < 6000)
    rows = {tuple(r) for r in periodic.run_digests(docs).collect()}
    assert rows == {plain_digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert sum(r[1] > 0 for r in rows) > 20


def test_runs_of_odd_tables(spark):
    texts = [None, "", "w " * 30, "a b " * 20, "a b " * 20, "ü x\ty z\r" * 12 + "end", "n" * 5000, "one two"]
    rows = [(None if i == 3 else i // 2, t, 7, "kept") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, start int, period string")
    assert Counter(map(tuple, periodic.run_digests(docs).collect())) == Counter(plain_digest(r[0], r[1]) for r in rows)
    assert periodic.run_digests(docs.limit(0)).count() == 0
    out = periodic.collapse(docs)
    assert out.schema == docs.schema
    assert [r.text for r in out.collect()] == [None, "", "w", "a b", "a b", "ü x y z end", "n" * 5000, "one two"]
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs.where("doc_id is not null")).collect()}
    assert found[1] == [(0, 30, 1)]


def test_exact_ratios():
    """Two ratios that are next to each other: the exact comparison decides, ties go to the smaller start."""
    runs = np.array([[5, 5 + 300, 100], [0, 300, 100], [900, 900 + 100, 33]])
    assert periodic.strongest(runs) == (900, 100, 33)
    assert periodic.strongest(runs[:2][np.argsort(runs[:2, 0])]) == (0, 300, 100)


# --- toxicity -------------------------------------------------------------------------------------------------------


def plain_kernel(s, t):
    """Sums over all pairs of equal subsequences, by enumeration."""
    def features(x):
        out = Counter()
        from itertools import combinations

        for size in toxicity.SIZES:
            for at in combinations(range(len(x)), size):
                letters = "".join(x[i] for i in at)
                if at[-1] - at[0] < toxicity.SPAN and letters.isalpha():
                    out[letters] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = features(s), features(t)
    dot = lambda u, v: sum(x * v[k] for k, x in u.items())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def test_kernel_is_that_of_the_definition():
    strings = ["idiot", "i-d-i-o-t", "idxiot", "radiotower", "abcabcabc", "banana", "st1upid"]
    columns, unit = toxicity._unit_vectors(strings)
    got = toxicity._kernel_rows(strings, columns, unit)
    want = [[plain_kernel(s, t) for t in strings] for s in strings]
    assert np.allclose(got, want, atol=1e-5)
    assert got[0, 1] > 0.9 and got[0, 2] > got[0, 3]


def test_strings_of_texts():
    strings = toxicity.Strings()
    assert strings.of("The IDIOT!!! i d i o t, (w.o.r.d)") == {"the", "idiot", "w.o.r.d"}
    assert strings.of("é è ê") == {"eee"} and strings.of("a b") == set() and strings.of("") == set()
    long = strings.of("x" * 100)
    assert long == {"x" * toxicity.WINDOW, "x" * 10}
    assert toxicity.windows("abcdefghijklmnopqrstuvwxyz")[-1].endswith("z")


@pytest.fixture(scope="module")
def marked(spark):
    """Documents of made-up words; toxic ones hold an insult, and a tenth of all labels is toxic without one."""
    rng = random.Random(3)
    parts = ["lo", "ra", "mi", "tu", "ke", "sa", "no", "vi", "en", "or", "st", "id", "po"]
    insults = ["grumbler", "dolt", "wretched", "vermin"]
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic and i % 40:
            words[rng.randrange(60)] = rng.choice(insults)
        for at in range(9, 60, 10):
            words[at] += "."
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), insults


def test_toxicity_of_unseen_documents_and_gapped_insults(spark, marked):
    docs, labels, insults = marked
    machine = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.toxic_rows(docs, labels).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held if r.doc_id % 40)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    scorer = toxicity.Scorer(machine)
    for word in insults:
        for shape in ("-".join(word), f"{word[:2]}x{word[2:]}", f"{word[:3]}*{word[3:]}!!", word.upper(), " ".join(word), f"{word[:2]}1{word[2:]}"):
            assert machine.share(scorer.best([f"lora mi {shape} tuke"])[0]) >= 0.5, shape
    assert toxicity.keep_clean(docs, labels).count() == sum(1 - r.predicted for r in rows.values())


def test_toxicity_on_odd_tables(spark, marked):
    docs, labels, _ = marked
    odd = spark.createDataFrame([(None, "lora", 1), (1, None, 2), (2, "", 3), (2, "", 3), (3, "dolt " * 3000, 4), (3, "dolt", 4)], "doc_id int, text string, toxic int")
    twice = labels.unionByName(labels.limit(50)).unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    both = docs.unionByName(odd.select(F.col("doc_id").cast("long"), "text"))
    rows = toxicity.toxic_rows(both, twice).collect()
    assert len(rows) == 906 and all(r.held_out is False for r in rows if r.doc_id is None)
    for empty in (labels.limit(0), labels.where("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {(r.score, r.predicted) for r in toxicity.toxic_rows(odd, empty).collect()} == {(0.0, 0)}
    assert toxicity.toxic_rows(odd.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(odd.withColumn("best", F.lit("kept")), labels)
    assert kept.columns == ["doc_id", "text", "toxic", "best"]


def test_sample_of_labels_is_bounded(spark):
    labels = spark.range(2000).select(F.lit(7).alias("doc_id"), F.lit(1).alias("toxic")).unionByName(spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")))
    sample, sizes = toxicity.labelled_sample(labels, 10)
    assert sample.where("toxic = 0").count() == 10 and sample.where("toxic = 1").count() == 1 and sizes[0][0] == 10


# --- importance resampling ------------------------------------------------------------------------------------------


def plain_resample(docs, target, percent=10, least=20, buckets=10_000, longest=1):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    feats = lambda w: [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in feats(split(x))), Counter(bucket(f) for x in target for f in feats(split(x)))
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for doc, x in docs:
        words = split(x)
        found = feats(words)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    places = len(able) * percent // 100
    out = Counter((*r[:4], i + 1 if i < places else None) for i, r in enumerate(able))
    return out + Counter((*r[:4], None) for r in rows if r[4] < least)


@pytest.mark.parametrize("percent,longest,bins", [(10, 1, 4096), (37, 2, 4096), (60, 1, 3), (100, 1, 1), (0, 1, 4096)])
def test_draws_are_those_of_a_sort(spark, data, monkeypatch, percent, longest, bins):
    monkeypatch.setattr(importance, "BINS", bins)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{data}/benchmark.parquet")
    rows = Counter(map(tuple, importance.resample(docs, target, percent, longest=longest).collect()))
    assert rows == plain_resample([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], percent, longest=longest)


def test_draws_of_odd_tables(spark):
    """Null, empty and repeated texts; one doc_id with a third of all rows; documents that share score and id."""
    same = "good words of the target text " * 5
    rows = [(None, same), (1, None), (2, ""), (3, "É Ü 12 ab-cd " * 9), (4, "x" * 9000)] + [(9, same)] * 40 + [(i, f"w{i} common other " * 8) for i in range(20, 60)] + [(None, same)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id int, text string, score int, rank int")
    target = spark.createDataFrame([("Good WORDS of",), (None,)], "text string")
    for percent in (10, 30, 55):
        assert Counter(map(tuple, importance.resample(docs, target, percent).collect())) == plain_resample(rows, ["Good WORDS of", None], percent)
    assert importance.resample(docs.limit(0), target).count() == 0
    out = importance.resample(docs, target.limit(0)).collect()
    assert len(out) == len(rows) and all(r.rank is None or r.rank > 0 for r in out)
