"""Every operator on odd tables, and the methods that SQL cannot check against plain versions."""

import hashlib
import html as entities
import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bytebpe, html, langid, media, minhash, neighbours, packing, pii, simhash, substring, urlfilter
from tidemark.llm.runtime import sliced, unused

ODD = [None, "", " \n\t", "word", "x" * 4000, "a b c d e f", "a b c d e f", "Ünï çôdé 1.2.3.4 me@mail.example.com"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty and repeated texts, and columns named as the operators' own."""
    rows = [(None if i == 3 else i // 2, t, ["en", None][i % 2], 0.25, "kept", "kept", 7, len(t or "")) for i, t in enumerate(ODD)]
    schema = "doc_id long, text string, lang string, score double, spans string, lang_pred string, sequence_id long, n_chars int"
    return spark.createDataFrame(rows + rows[-2:], schema)


def texts_of(frame):
    return Counter((r.doc_id, r.text) for r in frame.collect())


def test_slices_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 5, 0, 40, 1, 1)] + [None]})
    parts = [p.column(0).to_pylist() for p in sliced([batch], most=10)]
    assert sum(parts, []) == batch.column(0).to_pylist()
    assert [sum(len(t or "") for t in p) for p in parts] == [10, 40, 2]
    assert list(sliced([batch.slice(0, 0)])) == []
    assert unused("score", ["Score", "_score"]) == "__score"


def test_digest_queries_take_odd_tables(odd):
    n = odd.count()
    for digests, keys in (
        (pii.pii_digests, ["base_sha256"]), (bytebpe.encoding_digests, ["ids_sha256"]), (media.media_digests, ["media_sha256"]), (langid.language_rows, ["lang_pred"]),
        (substring.repeat_digests, []), (simhash.near_duplicate_digests, ["fingerprint"]),
    ):
        rows = digests(odd).collect()
        assert len(rows) == n
        assert digests(odd.limit(0)).count() == 0
        if keys:  # repeated rows get equal results
            assert len({r[keys[0]] for r in rows if r.doc_id == 3}) <= 2


def test_stages_keep_other_columns(odd):
    for stage in (langid.keep_identified, simhash.keep_one, minhash.keep_one, substring.remove_repeats, pii.redact):
        out = stage(odd)
        assert out.columns == odd.columns and out.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
        assert all((r.score, r.spans, r.lang_pred, r.sequence_id) == (0.25, "kept", "kept", 7) for r in out.collect())
        assert stage(odd.limit(0)).count() == 0
    assert all(r.n_chars == len(r.text or "") for r in pii.redact(odd).collect())


# --- personal data --------------------------------------------------------------------------------------------------


def test_all_labelled_secrets_are_found():
    field, found, there = pii.default_field(), 0, 0
    for text, spans in pii.labelled_table(300, seed=321):
        got = {s[:3] for s in pii.find([text], field)[0]}
        there += sum(s[0] == "secret" for s in spans)
        found += sum(s in got for s in spans if s[0] == "secret")
    assert there > 80 and found / there > 0.85
    assert not pii.is_key("covid-19-related-disease") and pii.is_key("sk_aZ3bYq0plMnXc9Qr")


def test_shapes_are_whole():
    start = "a1" * 40
    assert pii.word(start + "@x.org", 0, 86).shape.endswith("@x.x")


# --- packing --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(8))
def test_complements_are_complete(seed):
    """While counts fall, a single, pair or triple that fills a gap is found if and only if there is one."""
    rng = random.Random(seed)
    size = 24
    sums = packing.Complements({rng.randrange(1, size): rng.randrange(1, 4) for _ in range(9)}, size)
    for _ in range(40):
        taken, gap = rng.randrange(1, size), rng.randrange(1, size)
        free = Counter({n: c for n, c in enumerate(sums.free) if c})
        if not free[taken]:
            continue
        rest = sorted((free - Counter([taken])).elements())
        singles = {(a,) for a in rest}
        pairs = {(a, b) for i, a in enumerate(rest) for b in rest[i + 1 :]}
        triples = {(a, b, c) for i, a in enumerate(rest) for j, b in enumerate(rest[i + 1 :], i + 1) for c in rest[j + 1 :]}
        possible = any(sum(x) == gap for x in singles | pairs | triples)
        found = sums.fill(gap, taken)
        assert (found is not None) == possible
        if found:
            assert sum(found) == gap and not Counter([taken, *found]) - free
            sums.take([(n, k) for n, k in Counter([taken, *found]).items()], 1)


def test_equal_pieces_fill_buckets_evenly(spark):
    docs = spark.createDataFrame([(1, "same text")] * 3000, "doc_id long, text string")
    rows = packing.pack(docs, size=64).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("o"), F.count("*").alias("c")).collect()
    assert all(r.n <= 64 and r.o == r.c for r in rows) and sum(r.c for r in rows) == 3000


# --- byte-level BPE -------------------------------------------------------------------------------------------------


def test_byte_bpe_on_long_words_and_new_letters(spark):
    import tiktoken

    ranks = bytebpe.read_ranks(bytebpe.default_path())
    library = tiktoken.Encoding("own", pat_str=bytebpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"
    texts = ["a" * 5000, "".join(rng.choice(letters) for _ in range(200_000)), "".join(rng.choice("ab") for _ in range(bytebpe.LONG_WORD + 1)), "<|endoftext|>", None]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x10000, 0x33000)])) for _ in range(40)) for _ in range(1500)]
    rows = {r.doc_id: r.ids for r in bytebpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [i for i, t in enumerate(texts) if list(rows[i]) != library.encode_ordinary(t or "")] == []


def test_pair_table_is_exact():
    times, shifts, slots = bytebpe.pair_table(bytebpe.default_path())
    pairs = bytebpe.pair_ranks(bytebpe.read_ranks(bytebpe.default_path()))
    for pair, rank in pairs.items():
        assert slots[bytebpe._slot(pair, times, shifts[bytebpe._group(pair)], len(slots))] - 1 == pair << bytebpe.ID_BITS | rank
    assert sum(map(bool, slots)) == len(pairs)


# --- repeats --------------------------------------------------------------------------------------------------------


def plain_repeats(rows):
    seen, out = set(), []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for j in range(len(words) - 19):
            key = tuple(words[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        out.append((doc, len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batch", [None, 600])
def test_repeats_with_null_and_repeated_ids(spark, monkeypatch, batch):
    if batch:
        monkeypatch.setattr(substring, "LEAST_BATCH", batch)
        monkeypatch.setattr(substring, "UNIT", 100)
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(9999)}" for _ in range(rng.randrange(5, 60))]
        at = rng.randrange(len(words))
        rows.append((None if i % 10 == 0 else i, " ".join(words[:at] + shared[: rng.randrange(20, 31)] + words[at:])))
    rows += [(61, " ".join(shared) + " tail")] * 40  # a document that many rows repeat
    got = substring.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = plain_repeats(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    if batch is None:
        assert found == wanted
    else:  # null ids fill several batches and count in the order of a hash, the others do not depend on it
        pick = lambda c: Counter({k: v for k, v in c.items() if k[0] is not None})
        assert pick(found) == pick(wanted) and sum(found.values()) == len(rows)


def test_windows_are_told_apart_by_both_hashes():
    values = np.array([5, 5, 7, 9], np.uint64)
    assert substring._within_both(values, np.array([1, 2, 3, 4], np.uint32), (np.array([5, 5, 5, 9], np.uint64), np.array([3, 2, 9, 5], np.uint32))).tolist() == [False, True, False, False]
    assert substring._first_of_each(np.array([1, 1, 1, 2], np.uint64), np.array([4, 5, 4, 4], np.uint32)).tolist() == [True, True, False, True]


# --- pages ----------------------------------------------------------------------------------------------------------


def off(sizes, tags):
    """Clustering switched off: every line is content."""
    return np.ones(len(sizes), bool)


PROSE = "This is a long paragraph of running text that goes on for quite a while and says something. "


def test_clusters_find_the_article_of_given_pages_without_names(monkeypatch, data):
    """Elements that say what they are become plain ones and names of classes say nothing: the clusters alone find the
    text of at least 98 pages of 100, and with all lines as one cluster more than twice as many pages are wrong. (What
    the clusters leave out on these pages are lines of links: all lines with text outside links do as well.)"""
    pages = duckdb.sql(f"SELECT html FROM '{Path(data).parent}/sf0.1/pages.parquet'").fetchall()
    truth = [html.main_text(h) for (h,) in pages]
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", h or "") for (h,) in pages]
    assert [html.main_text(h) for h in plain] == truth
    for names in ("WORDS", "DOUBTFUL", "ROLES"):
        monkeypatch.setattr(html, names, frozenset())
    read = [html.Lines().finish(h) for h in plain]
    wrong = sum("\n".join(html.content(p)) != t for p, t in zip(read, truth))
    without = sum("\n".join(html.content(p, lambda sizes, tags: np.ones(len(sizes), bool))) != t for p, t in zip(read, truth))
    assert wrong <= 0.02 * len(pages) and without > 2 * wrong


def test_sections_beside_each_other_stay_together():
    side = "<div><p>Short.</p></div>"
    parts = [f"<section><p>{PROSE * n}</p></section>" for n in (6, 1, 1)]
    assert html.main_text(f"<body>{side}<div>{''.join(parts)}</div></body>") == "\n".join((PROSE * n).strip() for n in (6, 1, 1))


def test_clusters_decide_without_article_and_names():
    short = "".join(f"<li><b>{w}</b><i>said</i><span>so</span>" for w in ("Ann", "Bob", "Cleo", "Dan") * 12)
    page = f"<body><div><ul>{short}</ul></div><div><p>{PROSE * 3}<p>Be.<p>{PROSE * 3}</div><div><ul>{short}</ul></div>"
    text = "\n".join([(PROSE * 3).strip(), "Be.", (PROSE * 3).strip()])
    assert html.main_text(page) == text
    lines = html.Lines().finish(page)
    assert len(html.content(lines, off)) > 90  # all lines of the page
    flat = f"<body>{'<p><b>x</b><i>y</i>' * 30}<p>{PROSE}<p>{PROSE}{'<p><b>x</b><i>y</i>' * 30}"
    assert html.main_text(flat).count(PROSE.strip()) == 2 and len(html.main_text(flat).split("\n")) < 12
    assert len(html.content(html.Lines().finish(flat), off)) == 62


def test_names_weigh_and_do_not_decide():
    assert html.main_text(f"<div class='social banner'><p>{PROSE}<p>{PROSE}</div>") == "\n".join([PROSE.strip()] * 2)
    page = f"<nav>Home and more words here</nav><article><h1>T</h1><p>Short.</article><footer>{PROSE * 4}</footer>"
    assert html.main_text(page) == "T\nShort."
    inside = f"<article><p>{PROSE * 5}<div class=comments><p>First!</div><p>End.</article>"
    assert html.main_text(inside) == (PROSE * 5).strip() + "\nEnd."


def plain_article(page):
    """The article of the given pages, by patterns: their one template has an article of headings and paragraphs."""
    body = re.search(r"(?s)<article>(.*)</article>", page)[1]
    blocks = re.split(r"</?(?:h1|p)>", body.replace("<br>", " ").replace("<b>", ""))
    return "\n".join(t for b in blocks if (t := " ".join(entities.unescape(b).split())))


def test_pages_equal_a_plain_version(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in html.extract(rows).collect()}
    pages = rows.collect()
    assert pages and all(got[r.page_id].text == plain_article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) for r in pages)


def test_pages_as_a_table(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>text</p>", "x"), (2, "u", "<p>text</p>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(frame).collect()) == Counter([(1, None, "", 0), (None, "u", "", 0), (2, "u", "text", 4), (2, "u", "text", 4)])
    assert html.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text", "<a " * 50_000, "<!-- " * 50_000, ("<p><b>" + "</i></div>") * 40_000, "<" * 50_000])
def test_hostile_pages_take_linear_time(page):
    html.main_text(page)


# --- media ----------------------------------------------------------------------------------------------------------


def test_deep_boxes(spark):
    data = media.box(b"moov")
    for _ in range(5000):
        data = media.box(b"moov", data)
    rows = spark.createDataFrame([(1, data), (2, media.write_container(bytes(64)))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.probe_media(rows).collect()}
    assert (got[1].codec, got[1].error) == (None, None) and got[2].codec == "raw "


# --- language -------------------------------------------------------------------------------------------------------


def plain_scores(labelled, text):
    """The back-off over plain dictionaries."""
    languages = sorted({lang for lang, _ in labelled})
    tables = []
    for pick in (lambda w: [w], lambda w: [g for n in range(1, langid.LONGEST + 1) for g in langid.grams(w, n)]):
        counts = {lang: Counter() for lang in languages}
        for lang, t in labelled:
            counts[lang].update(x for w in langid.words(t) for x in pick(w))
        keys = set().union(*counts.values())
        total = {lang: sum(counts[lang].values()) for lang in languages}
        tables.append({k: [math.log((counts[lang][k] + langid.SMOOTH) / (total[lang] + langid.SMOOTH * len(keys))) for lang in languages] for k in keys})
    scores = np.zeros(len(languages))
    for w in langid.words(text):
        if w in tables[0]:
            scores += tables[0][w]
            continue
        for n in range(langid.LONGEST, 0, -1):
            known = [tables[1][g] for g in langid.grams(w, n) if g in tables[1]]
            if known:
                scores += np.mean(known, axis=0)
                break
    return languages, scores


def test_language_scores_equal_a_plain_version(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30)))
    rows = [(i, make("abcde") if i % 2 else make("defgh"), "xx" if i % 2 else "yy") for i in range(80)]
    rows += [(100, "same", "xx"), (101, "same", "yy"), (102, "² ½", "xx"), (103, "ñ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import zlib

    labelled = [(lang, t) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    got = {r.doc_id: r for r in langid.language_rows(docs).collect()}
    for i, text, _ in rows:
        languages, scores = plain_scores(labelled, text)
        if not langid.words(text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        best = int(scores.argmax())
        assert got[i].lang_pred == languages[best] and math.isclose(got[i].score, 1 / np.exp(scores - scores[best]).sum(), rel_tol=1e-9)
    assert got[103].lang_pred == "xx" and math.isclose(got[103].score, 0.5, abs_tol=0.2)  # of unknown characters only: a tie


def test_rejects_what_no_language_knows(spark):
    clean = ["the house is old and the garden is green"] * 40 + ["das haus ist alt und der garten ist schön"] * 40
    rows = [(i, t, ["en", "de"][i >= 40]) for i, t in enumerate(clean)] + [(100, "qzxv wkjq xxqz vvkq", None), (101, "漢字 仮名 文章", None), (102, "the garden is old", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.keep_identified(docs).collect()}
    assert kept == {*range(80), 102}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled).count() == docs.count()


# --- neighbours -----------------------------------------------------------------------------------------------------


def test_neighbours_of_extreme_and_repeated_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e-200, 1e-200]), (2, [1e-200, 0.0]), (50, [3.0, 4.0]), (50, [1.0, 1.0]), (3, [-1e-300, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in neighbours.nearest_rows(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = [(i, np.array(v) / max(map(abs, v))) for i, v in rows]
    for q in (0, 50):
        every = sorted(((float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), -j) for i, a in unit for j, b in unit if i == q != j), reverse=True)[:5]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in mine], [s for s, _ in every]) and np.isfinite([s for _, _, s in mine]).all()
    assert neighbours.nearest_rows(frame.limit(0)).count() == 0


# --- urls -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [None, 1])
def test_lists_from_tables(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(urlfilter, "MAX_LISTED", most)  # longer lists are joined
    urls = ["http://A.net/x", "https://sub.example.net/en/1", "http://example.com/de/", "x.org/fr/", None, "http://q.org/fr/?a", "http://b.bad.example.org/", "http://A.net/x"]
    pages = spark.createDataFrame([(i % 7, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    lists = [spark.createDataFrame([(k,) for k in keys], "key string") for keys in ([*urlfilter.BLOCK_RULES, None], [*urlfilter.ALLOW_RULES] * 2, ["bad.example.org", "worse.example.org"])]
    got = Counter((r.page_id, r.host, r.rule, r.verdict, r.listed) for r in urlfilter.judge(pages, *lists).collect())
    wanted = [
        (0, "a.net", "net/", "block", False), (1, "sub.example.net", "example.net/en/", "allow", False), (2, "example.com", "example.com/de/", "block", False), (3, "", None, "allow", False),
        (4, "", None, "allow", False), (5, "q.org", "org/fr/", "allow", False), (6, "b.bad.example.org", None, "block", True), (0, "a.net", "net/", "block", False),
    ]
    assert got == Counter(wanted)
    with pytest.raises(ValueError):
        urlfilter.judge(pages, lists[0], lists[0])
