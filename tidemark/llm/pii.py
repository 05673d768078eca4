"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers by pattern. The field reads words
(runs without white space) and labels those that hold a digit or ``@``; all other words are fixed to *outside*, in
training and in decoding alike, so the best labelling of a text splits exactly into runs of adjacent such words, which
are decoded by Viterbi in numpy batches of equal length. A span of the field is added if it touches no base span and,
for the four base kinds, if its digits pass the base's check (octets, Luhn, 8 to 15 digits); the field also knows
``secret``, a key of 16 or more mixed characters (``is_key``). Base spans always stay.

Offsets are code points, end exclusive; spans are ordered by kind (email, ip, card, phone, secret), then start.

Defined results: a null or empty text has no spans; so has a text without digits and ``@``. Repeated rows give
repeated results, an empty table an empty one. Texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import begin, sliced

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_O = 0

# --- base -----------------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_KEY = re.compile(r"[A-Za-z0-9_-]+")
_CAMEL = re.compile(r"[a-z][A-Z]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    parts = [p for p in re.split(r"[^0-9]+", text) if p]
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _is_card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 8 <= len(_NOT_DIGIT.sub("", text)) <= 15


def is_key(text: str) -> bool:
    """16 or more letters, digits, ``-`` and ``_``; letters and digits among them, of these four digits or capitals
    after small letters (so a hyphenated phrase with a number is none)."""
    if len(text) < 16 or not _KEY.fullmatch(text):
        return False
    digits = len(_NOT_DIGIT.sub("", text))
    return 1 <= digits <= len(text) - 2 and (digits >= 4 or bool(_CAMEL.search(text)))


_CHECKS = {"email": lambda t: bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", t)), "ip": _is_ip, "card": _is_card, "phone": _is_phone, "secret": is_key}


def emails(text: str) -> Iterable[tuple[int, int]]:
    """From each ``@`` outwards: the local part reaches back to the last character outside its class, or to the
    match before, so a long word without ``@`` costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        done = match.end() if match else at + 1
        if match:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four patterns, leftmost and non-overlapping within each kind; matches that fail their check are dropped."""
    found = [("email", a, b) for a, b in emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        check = _CHECKS[kind]
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if check(m[0])]
    return found


# --- the field ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Word:
    start: int
    end: int
    shape: str
    digits: int
    mixed: bool


_EDGE_LEFT = re.compile(r"[^A-Za-z0-9+(]*")
_UPPER, _LOWER, _DIGIT = "X", "x", "d"
_RUNS = re.compile(r"([Xxd?])\1+")
_CLASS = {**{c: _UPPER for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: _LOWER for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: _DIGIT for c in "0123456789"}, **{c: c for c in "@.+()-_=:/%"}}


def word(text: str, start: int, end: int) -> Word:
    """A word without the marks around it, and its shape: classes of characters with runs drawn together."""
    a = _EDGE_LEFT.match(text, start, end).end()
    b = end
    while b > a and not (text[b - 1].isascii() and (text[b - 1].isalnum() or text[b - 1] == ")")):
        b -= 1
    inner = text[a:b]
    if inner.endswith(")") and "(" not in inner:
        b, inner = b - 1, inner[:-1]
    if inner.startswith("(") and ")" not in inner:
        a, inner = a + 1, inner[1:]
    shape = _RUNS.sub(r"\1", "".join(_CLASS.get(c, "?") for c in inner))
    return Word(a, b, shape, sum(map(inner.count, "0123456789")), is_key(inner))


def _count_class(n: int) -> str:
    for top in (0, 2, 3, 4, 7, 11, 15, 19):
        if n <= top:
            return f"<={top}"
    return ">19"


EDGE = Word(0, 0, "", 0, False)


def features(before: Word, this: Word, after: Word) -> tuple[str, ...]:
    size = _count_class(this.digits)
    return (
        "bias",
        f"s={this.shape}",
        f"n={size}",
        f"s={this.shape},n={size}",
        f"mixed={this.mixed}",
        f"dots={min(this.shape.count('.'), 4)},at={'@' in this.shape}",
        f"before={before.shape},{_count_class(before.digits)}",
        f"after={after.shape},{_count_class(after.digits)}",
        f"before={before.shape},s={this.shape}",
        f"after={after.shape},s={this.shape},n={size}",
    )


@dataclass(frozen=True)
class Field:
    """Weights: ``emit[feature, label]``, ``step[label, label]``; runs start and end next to *outside*."""

    names: dict[str, int]
    emit: np.ndarray
    step: np.ndarray

    def scores(self, run: list[tuple[str, ...]]) -> np.ndarray:
        known = [[self.names[f] for f in fs if f in self.names] for fs in run]
        return np.stack([self.emit[k].sum(axis=0) for k in known])

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each run: Viterbi over all runs of one length at once."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(runs)
        by_length: dict[int, list[int]] = {}
        for i, run in enumerate(runs):
            by_length.setdefault(len(run), []).append(i)
        for length, members in by_length.items():
            for low in range(0, len(members), 4096):
                some = members[low : low + 4096]
                scores = np.stack([runs[i] for i in some])
                best = scores[:, 0] + self.step[_O]
                back = np.zeros((len(some), length, len(LABELS)), np.int8)
                for t in range(1, length):
                    paths = best[:, :, None] + self.step[None]
                    back[:, t] = paths.argmax(axis=1)
                    best = paths.max(axis=1) + scores[:, t]
                labels = np.zeros((len(some), length), int)
                labels[:, -1] = (best + self.step[:, _O]).argmax(axis=1)
                for t in range(length - 1, 0, -1):
                    labels[:, t - 1] = back[np.arange(len(some)), t, labels[:, t]]
                for i, row in zip(some, labels):
                    out[i] = row
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.5, l2: float = 1e-3) -> Field:
    """Fit a field to labelled texts, by AdaGrad on the conditional likelihood (forward and backward in log space).

    ``rows``: a small table of (text, spans); a span's words are those that lie inside it.
    """
    runs, golds = [], []
    for text, spans in rows:
        for run in word_runs(text):
            gold = []
            for _, w, _ in run:
                kind, first = next(((k, a) for k, a, b in spans if a <= w.start and w.end <= b), (None, 0))
                before = gold[-1] if gold else "O"
                same = kind and before[2:] == kind and any(k == kind and a <= run[len(gold) - 1][1].start and w.end <= b for k, a, b in spans)
                gold.append("O" if kind is None else f"{'I' if same else 'B'}-{kind}")
            runs.append([features(*x) for x in run])
            golds.append([LABELS.index(g) for g in gold])
    names = {f: i for i, f in enumerate(dict.fromkeys(f for run in runs for fs in run for f in fs))}
    width = len(runs[0][0])
    emit, step = np.zeros((len(names), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    emit_sq, step_sq = np.full_like(emit, 1e-8), np.full_like(step, 1e-8)
    groups = []
    for length in sorted({len(r) for r in runs}):
        some = [i for i, r in enumerate(runs) if len(r) == length]
        ids = np.array([[[names[f] for f in fs] for fs in runs[i]] for i in some])
        groups.append((ids, np.array([golds[i] for i in some])))
    for _ in range(rounds):
        emit_grad, step_grad = -l2 * emit, -l2 * step
        for ids, gold in groups:
            n, length = gold.shape
            scores = emit[ids].sum(axis=2)
            ahead = np.empty_like(scores)
            ahead[:, 0] = scores[:, 0] + step[_O]
            for t in range(1, length):
                ahead[:, t] = _logsum(ahead[:, t - 1][:, :, None] + step, 1) + scores[:, t]
            behind = np.empty_like(scores)
            behind[:, -1] = step[:, _O]
            for t in range(length - 2, -1, -1):
                behind[:, t] = _logsum(step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            total = _logsum(ahead[:, -1] + step[:, _O], 1)
            delta = -np.exp(ahead + behind - total[:, None, None])
            delta[np.arange(n)[:, None], np.arange(length), gold] += 1
            np.add.at(emit_grad, ids.reshape(-1), np.repeat(delta.reshape(-1, len(LABELS)), width, axis=0))
            for t in range(1, length):
                pair = ahead[:, t - 1][:, :, None] + step + (scores[:, t] + behind[:, t])[:, None, :]
                step_grad -= np.exp(pair - total[:, None, None]).sum(axis=0)
                np.add.at(step_grad, (gold[:, t - 1], gold[:, t]), 1)
            ends = -delta
            for t, across in ((0, False), (length - 1, True)):
                hoped = (ends[:, t]).sum(axis=0)
                grad = -hoped
                if across:
                    step_grad[:, _O] += grad
                else:
                    step_grad[_O] += grad
        for value, grad, square in ((emit, emit_grad, emit_sq), (step, step_grad, step_sq)):
            square += grad * grad
            value += rate * grad / np.sqrt(square)
    return Field(names, emit, step)


def labelled_table(size: int = 600, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: invented sentences with personal data, and with numbers that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    fours = lambda sep: sep.join(digits(4) for _ in range(4))
    make = {
        "email": [lambda: f"{letters(5)}@{letters(6)}.com", lambda: f"{letters(4)}.{digits(2)}@{letters(4)}{digits(1)}.example.org", lambda: f"{letters(3)}.{letters(5)}@{letters(7)}.net"],
        "ip": [lambda: ".".join(str(rng.randrange(256)) for _ in range(4))],
        "card": [lambda: digits(16), lambda: fours(" "), lambda: fours("-"), lambda: fours(".")],
        "phone": [lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(7)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"],
        "secret": [lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24)), lambda: f"{letters(2)}{rng.choice('-_')}" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(20))],
        None: [
            lambda: digits(rng.randrange(1, 9)), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}%", lambda: f"{letters(4)}{digits(2)}",
            lambda: f"{letters(7)}-{digits(2)}-{letters(8)}", lambda: f"{digits(1)}.{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"@{letters(6)}", lambda: f"({digits(1)})", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(1)} {digits(3)} {digits(3)}", lambda: digits(rng.randrange(20, 30)),
        ],
    }
    kinds = [*KINDS, None, None]
    rows = []
    for _ in range(size):
        text, spans = "", []
        for _ in range(rng.randrange(1, 4)):
            text += "".join(letters(rng.randrange(2, 8)) + rng.choice([" ", " ", ", ", ". "]) for _ in range(rng.randrange(0, 5)))
            kind = rng.choice(kinds)
            found = rng.choice(make[kind])()
            if kind == "secret" and rng.random() < 0.7:
                text += 'token = "'
            if kind:
                spans.append((kind, len(text), len(text) + len(found)))
            text += found + rng.choice([" ", ". ", ", ", "\n", '" '])
        rows.append((text + letters(5), spans))
    return rows


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


_HIT = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\S+")


def _word_before(text: str, end: int) -> Word:
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return word(text, start, end) if start < end else EDGE


def word_runs(text: str) -> Iterable[list[tuple[Word, Word, Word]]]:
    """Runs of adjacent words with a digit or ``@``, each word with its neighbours."""
    spots: list[list[tuple[int, int]]] = []
    done = 0
    match = _HIT.search(text)
    while match:
        start = match.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, match.end())
        end = space.start() if space else len(text)
        if spots and not text[done:start].strip():
            spots[-1].append((start, end))
        else:
            spots.append([(start, end)])
        done = end
        match = _HIT.search(text, end)
    for run in spots:
        first, last = run[0][0], run[-1][1]
        right = _WORD.search(text, last)
        after = word(text, *right.span()) if right else EDGE
        around = [_word_before(text, first), *(word(text, a, b) for a, b in run), after]
        yield list(zip(around, around[1:], around[2:]))


def find(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """Spans (kind, start, end, base?) of each text."""
    runs, scores = [], []
    bases = []
    for i, text in enumerate(texts):
        if not text:
            bases.append([])
            continue
        bases.append(base_spans(text))
        for run in word_runs(text):
            runs.append((i, [w for _, w, _ in run]))
            scores.append(field.scores([features(*x) for x in run]))
    added: dict[int, list[tuple[str, int, int, bool]]] = {}
    for (i, words), labels in zip(runs, field.decode(scores)):
        if not labels.any():
            continue
        t = 0
        while t < len(words):
            name = LABELS[labels[t]]
            end = t + 1
            while name != "O" and end < len(words) and LABELS[labels[end]] == f"I-{name[2:]}":
                end += 1
            if name != "O":
                a, b = words[t].start, words[end - 1].end
                if a < b and _CHECKS[name[2:]](texts[i][a:b]):
                    added.setdefault(i, []).append((name[2:], a, b, False))
            t = end
    out = []
    for i, base in enumerate(bases):
        found = [(*s, True) for s in base]
        edges = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in edges]
        reach = np.maximum.accumulate([b for _, b in edges]) if edges else []
        for span in added.get(i, ()):
            k = int(np.searchsorted(starts, span[2]))
            if not k or reach[k - 1] <= span[1]:
                found.append(span)
        out.append(sorted(found, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


SPANS = "spans array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id`` and ``spans`` of every document. Narrow: no shuffle; the weights travel with the task."""
    field = field or default_field()

    def scan(batches):
        begin("pii")
        for batch in sliced(batches):
            spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in x] for x in find(batch.column(1).to_pylist(), field)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS_TYPE)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, {SPANS}")


def mask(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, done = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` (if there, of any whole type) brought in line; all
    other columns as they were, whatever their names."""
    field = field or default_field()

    def rewrite(batches):
        begin("pii")
        for batch in sliced(batches):
            names = batch.schema.names
            texts = batch.column(names.index("text")).to_pylist()
            clean = [mask(t, s) for t, s in zip(texts, find(texts, field))]
            new = {"text": pa.array(clean, pa.string())}
            if "n_chars" in names:
                old = batch.column(names.index("n_chars"))
                new["n_chars"] = pa.array([o if c == t else len(c) for o, c, t in zip(old.to_pylist(), clean, texts)], old.type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names)

    return docs.mapInArrow(rewrite, docs.schema)


def pii_digests(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Contract rows, derived from the spans of ``find_pii``."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_pii(docs, field).select(
        "doc_id",
        *(count(k) for k in ("email", "ip", "card", "phone")),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
