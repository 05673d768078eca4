"""The training-data operators against brute force, and on nulls, empty tables, repeats, ties and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_minhash import brute_roots
from tests.support import assert_same
from tidemark.llm import bytebpe, html, langid, media, neighbours, packing, pii, queries, simhash, substring, urlfilter, wordbpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "the", "of", "and", "über", "naïve", "x1", "42"]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    shared = " ".join(rng.choice(WORDS) for _ in range(60))
    out = [None, "", " \t\n", "é", "a" * 5000, "mail me.now@mail.example.com or +1 (377) 555-0271 4539578763621486 10.0.0.1", "x " * 3000]
    for _ in range(n):
        own = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(120))]
        cut = rng.randrange(40)
        out.append(" ".join(own) + rng.choice(["", "\n" + shared, " " + " ".join(shared.split()[cut : cut + 25])]))
    return out + out[-3:]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, data, name):
    assert_same(queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


# --- 1 --------------------------------------------------------------------------------------------------------------


def plain_base(text):
    found = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def test_pii_base_is_the_patterns():
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice("ab1290 .-+()@%\n4") for _ in range(rng.randrange(40)))
        assert sorted(pii.base_spans(text)) == sorted(plain_base(text)), text


def test_pii_field_on_unseen_rows():
    field, right, wrong, missed = pii.default_field(), 0, 0, 0
    for text, spans in pii.labelled_table(200, seed=123):
        got = {s[:3] for s in pii.find([text], field)[0]}
        valid = {s for s in spans if pii._CHECKS[s[0]](text[s[1] : s[2]])}
        right, wrong, missed = right + len(got & valid), wrong + len(got - valid), missed + len(valid - got)
    assert right / (right + wrong) > 0.85 and right / (right + missed) > 0.85


def test_pii_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    n = len(pii.LABELS)
    field = pii.Field({}, np.zeros((0, n)), rng.normal(size=(n, n)))
    scores = rng.normal(size=(3, n))
    paths = {(a, b, c): field.step[0, a] + scores[0, a] + field.step[a, b] + scores[1, b] + field.step[b, c] + scores[2, c] + field.step[c, 0] for a in range(n) for b in range(n) for c in range(n)}
    assert tuple(field.decode([scores])[0]) == max(paths, key=paths.get)


def test_pii_rows(docs, nothing):
    rows = by_id(pii.pii_digests(docs))
    for i, text in enumerate(texts()):
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(text or ""))
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
    assert (rows[5].n_email, rows[5].n_ip, rows[5].n_card, rows[5].n_phone) == (1, 1, rows[5].n_card, 0 if rows[5].n_card == 0 else rows[5].n_phone)
    assert pii.pii_digests(nothing).count() == 0
    clean = by_id(pii.redact(docs))
    assert "[EMAIL]" in clean[5].text and clean[5].n_chars == len(clean[5].text) and clean[5].spans == "clash"
    assert clean[0].text is None and clean[7].text == texts()[7]


# --- 2 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 64, 4096])
    counts = Counter(min(size, max(1, int(rng.lognormvariate(3, 1.5)))) for _ in range(3000))
    patterns, held = packing.plan(counts, size), Counter()
    for p in patterns:
        assert sum(n * k for n, k in p.parts) <= size
        for n, k in p.parts:
            held[n] += k * p.times
    assert held == counts
    assert sum(p.times for p in patterns) <= 1.01 * sum(n * c for n, c in counts.items()) / size + 2


def test_word_bpe_is_the_library():
    encoder = wordbpe.Encoder(wordbpe.default_path())
    rng = random.Random(3)
    odd = ["".join(rng.choice("aB'sStTl 1٣²½ÀéßŸſ\n\tİ\u0085Σς<|endoftext|>!?.–中") for _ in range(rng.randrange(30))) for _ in range(2000)]
    assert encoder.encode(odd) == encoder.whole(odd)


def test_packing_rows(docs, nothing):
    rows = packing.pack(docs, size=64).collect()
    encoder, placed = wordbpe.Encoder(wordbpe.default_path()), {}
    for i, text in enumerate(texts()):
        ids = encoder.whole([text or ""])[0] + (1).to_bytes(4, "little")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in mine] == [(a, len(ids[4 * a : 4 * a + 256]) // 4, zlib.crc32(ids[4 * a : 4 * a + 256])) for a in range(0, len(ids) // 4, 64)]
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(nothing).count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------


def test_byte_bpe_is_tiktoken(docs, nothing):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=bytebpe.default_pattern(), mergeable_ranks=bytebpe.read_ranks(bytebpe.default_path()), special_tokens={})
    rows = by_id(bytebpe.encoding_digests(docs))
    for i, text in enumerate(texts()):
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    back = by_id(bytebpe.decode(bytebpe.encode(docs)))
    assert all(bytes(back[i].decoded).decode() == (t or "") for i, t in enumerate(texts()))
    assert bytebpe.encoding_digests(nothing).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------


def plain_repeats(rows):
    seen, out = set(), {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for j in range(len(words) - 19):
            key = tuple(words[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batch", [None, 2000])
def test_repeats(docs, nothing, monkeypatch, batch):
    if batch:
        monkeypatch.setattr(substring, "LEAST_BATCH", batch)
        monkeypatch.setattr(substring, "RANGE_HASHES", 300)
    rows = by_id(substring.repeat_digests(docs))
    expected = plain_repeats(list(enumerate(texts())))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in rows.items()} == expected
    assert any(v[1] for v in expected.values())
    assert substring.repeat_digests(nothing).count() == 0
    kept = by_id(substring.remove_repeats(docs))
    for i, (n, gone, digest) in expected.items():
        assert (i not in kept) == bool(n and n == gone)
        if i in kept:
            assert hashlib.sha256(" ".join((kept[i].text or "").split()).encode()).hexdigest() == digest or not gone
            assert gone or kept[i].text == texts()[i]


def test_packed_sets_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 8, 20, 48, 64):
        values = np.unique(rng.integers(0, 1 << bits, 500, dtype=np.uint64) if bits < 64 else rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2))
        assert np.array_equal(substring.unpack(substring.pack(values)), values)


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_main_text():
    page = "<title>t</title><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>T &amp; U</h1><p>Long  text\nhere<script>x</script> and on.<p>Be.</article><div id=comments><p>First!</div><footer>f</footer>"
    assert html.main_text(page) == "T & U\nLong text here and on.\nBe."
    soup = "<div id=nav>x</div><div class='content'><p>This is a long paragraph of text which goes on.</p><p>Be.</p><p>Another long paragraph with text.</p></div><form>q</form>"
    assert html.main_text(soup).split("\n")[1] == "Be."
    assert [html.main_text(x) for x in (None, "", "<article></article>", "plain")] == ["", "", "", "plain"]


# --- 6 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 64, 65, 64 * 256, 64 * 256 + 1, 100_000])
def test_container_round_trip(size):
    payload = media.pad(random.Random(size).randbytes(size))
    data = media.write_container(payload)
    (track,) = media.read_container(data)
    assert media.payload_of(data, track) == payload and track.samples == len(payload) // 64
    assert [n for _, n in track.keyframes] == [64] * -(-track.samples // media.KEY_EVERY)


def test_broken_containers(spark):
    whole = media.write_container(bytes(640))
    rows = [(1, whole), (2, whole[:-1]), (3, whole[:100]), (4, None), (5, b"xx")]
    got = {r.doc_id: (r.codec, r.error is None) for r in media.probe_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got == {1: ("raw ", True), 2: (None, False), 3: (None, False), 4: (None, True), 5: (None, False)}


def test_media_rows(docs, nothing):
    rows = by_id(media.media_digests(docs))
    for i, text in enumerate(texts()):
        payload = media.pad((text or "").encode())
        assert (rows[i].n_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len((text or "").encode()), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[7 + 57].media_sha256 == rows[7 + 60].media_sha256  # a repeated text
    assert media.media_digests(nothing).count() == 0


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_language(spark, data, docs, nothing):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.QUERIES["op7_langid"](spark, data).collect()]
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    some = by_id(langid.language_rows(docs))
    assert all((some[i].lang_pred, some[i].score) == ("und", 0.0) for i in (0, 1, 2)) and some[3].lang_pred in ("en", "fr")
    assert langid.language_rows(nothing).count() == 0
    assert {r.lang_pred for r in langid.language_rows(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- 8 --------------------------------------------------------------------------------------------------------------


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 40)
    monkeypatch.setattr(neighbours, "LEAST_GROUP", 3)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[100:160] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (450, [0.0] * 8), (500, [float("nan")] + [1.0] * 7), (550, [None] + [1.0] * 7), (600, [1.0, 2.0]), (None, [1.0] * 8)]
    got = {}
    for r in neighbours.nearest_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = vectors.astype(float)
    unit = np.sqrt((x * x).sum(1))
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for q, found in got.items():
        score = x @ x[q] / (unit * unit[q])
        order = [i for i in sorted(range(300), key=lambda i: (-round(score[i], 12), i)) if i != q][:5]
        assert [v for _, v, _ in sorted(found)] == order
        assert np.allclose([s for _, _, s in sorted(found)], score[order])


# --- 9 --------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def test_near_duplicates(docs, nothing):
    prints = {i: plain_fingerprint(t, 3) for i, t in enumerate(texts())}
    rows = by_id(simhash.near_duplicate_digests(docs))
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{prints[i]:016x}", c) for i, c in components(prints).items()}
    assert simhash.near_duplicate_digests(nothing).count() == 0
    kept = by_id(simhash.keep_one(docs, 3))
    assert set(kept) == set(components(prints).values()) and kept[5].spans == "clash"


@pytest.mark.parametrize("pairwise", [2, 512])
def test_meetings_find_every_link(monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(pairwise)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(40):
            near = base
            for _ in range(rng.randrange(6)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    prints = dict(enumerate(prints))
    fp, doc = np.array(list(prints.values()), np.uint64), np.arange(len(prints))
    flips = np.array([0, *(1 << i for i in range(32))], np.uint64)
    keys = [((own[:, None] ^ flips).reshape(-1) | np.uint64(h << 32)).view(np.int64) for h, own in ((0, fp >> np.uint64(32)), (1, fp & np.uint64(0xFFFFFFFF)))]
    home = np.tile(np.arange(33) == 0, 2 * len(fp))
    a, b = simhash.meet(np.concatenate(keys), np.tile(np.repeat(fp.view(np.int64), 33), 2), np.tile(np.repeat(doc, 33), 2), home)
    assert simhash._local_roots(len(fp), a, b).tolist() == list(components(prints).values())


# --- 10 -------------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = ["http://A.net/x", "https://sub.example.net/en/1", "http://example.com/de/", "http://example.com/de", "x.org/fr/", None, "http://q.org/fr/?a", "http://notnet/", "http://b.spam-farm.example.org", "http://x.net", "a://b://c/d#e"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(rows).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("example.com/de/", "block")
    assert got[3][2] is None and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow") and got[6][2:] == ("org/fr/", "allow")
    assert got[7][2] is None and got[8][2:] == (None, "block") and got[9][2] is None and got[10][:2] == ("b:", "//c/d")
    assert urlfilter.judge(rows.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = tuple(f"k{i}" for i in range(0, 3000, 7))
    (cascade, none) = urlfilter.build_cascades(universe, [urlfilter.key_table(spark, listed), urlfilter.key_table(spark, ())])
    got = universe.select("key", cascade.contains(F.col("key")).alias("hit"), none.contains(F.col("key")).alias("no")).collect()
    assert {r.key for r in got if r.hit} == set(listed) and not any(r.no for r in got)


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, data):
    import corpus_pipeline

    kept = spark.read.parquet(f"{data}/documents.parquet")
    columns = kept.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, kept = {r.doc_id: r.text for r in kept.collect()}, stage(spark, kept, data).cache()
        assert kept.columns == columns
        after = {r.doc_id: r.text for r in kept.collect()}
        if i == 0:
            assert after == {k: t for k, t in before.items() if langid.words(t)}
        if i == 1:
            assert set(after) == set(brute_roots(before).values())  # similarity of 0.8 or more of five-word shingles
        if i == 2:
            for k, (n, gone, digest) in plain_repeats(sorted(before.items())).items():
                assert (k in after) == (n != gone or not n)
                assert k not in after or hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", after[k])).encode()).hexdigest() == digest
        if i == 3:
            assert all(after[k] == pii.mask(t, pii.find([t], pii.default_field())[0]) for k, t in before.items())
    final = {(r.doc_id, r.piece): r.length for r in corpus_pipeline.run(spark, data).collect()}
    assert {k for k, _ in final} == set(after)
