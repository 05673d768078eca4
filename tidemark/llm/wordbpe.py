"""Token ids of texts by a public ``tokenizers`` file, with each distinct word of a task encoded once.

The vocabulary in question normalises (NFC, one space for white space, lower case), splits by a pattern and merges
within each piece, so the ids of a text are those of its pieces one after the other. For texts of characters that
normalisation leaves alone but for their case, the pieces come from the pattern directly and are looked up in a table
of the pieces seen so far; every other text goes to the library whole. Either way the ids are the library's.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from tidemark.llm.runtime import hold

#: The split of the vocabulary file (its "Split" pre-tokenizer); fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable Latin: composed already, no marks to reorder, one lower case of one character each.
_PLAIN = r"\t\n\r\x20-\x7e¡-¬®-įĲ-ňŊ-ž"
_ODD = re.compile(f"[^{_PLAIN}]")


def _plain_split() -> re.Pattern:
    """The pattern for such texts, with its classes written out, which the standard library matches faster."""
    plain = [c for c in map(chr, range(0x180)) if not _ODD.match(c)]
    kinds = lambda first: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == first)
    return re.compile(PATTERN.replace(r"\s\p{L}\p{N}", r"\s" + kinds("L") + kinds("N")).replace(r"\p{L}", kinds("L")).replace(r"\p{N}", kinds("N")))


_SPLIT = _plain_split()
#: Pieces kept by a Python worker; beyond that the table starts anew, so its memory is bounded.
TABLE_SIZE = 600_000
_TOGETHER = 2000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids are handed out as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.table: dict[str, bytes] = {}
        self.usual = "Replace" in str(self.library.normalizer) and "Lowercase" in str(self.library.normalizer)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of pieces, many to a call: with spaces between them each piece is one word of the call's text."""
        for low in range(0, len(words), _TOGETHER):
            some = words[low : low + _TOGETHER]
            found = self.library.encode(" ".join(some), add_special_tokens=False)
            of = np.array(found.word_ids)
            cuts = (np.flatnonzero(np.diff(of)) + 1) * 4
            data = np.array(found.ids, "<u4").tobytes()
            ends = [0, *cuts.tolist(), len(data)]
            each = [data[a:b] for a, b in zip(ends, ends[1:])]
            self.table.update(zip(some, each if len(each) == len(some) else self.whole(some)))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.usual and not _ODD.search(t) for t in texts]
        pieces = [_SPLIT.findall(t.lower()) if p else () for t, p in zip(texts, plain)]
        new: set[str] = set()
        for words in pieces:
            new.update(set(words).difference(self.table))
        if len(self.table) + len(new) > TABLE_SIZE:
            self.table.clear()
            new = {w for words in pieces for w in words}
        self._learn(list(new))
        get = self.table.__getitem__
        odd = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        return [b"".join(map(get, words)) if p else next(odd) for words, p in zip(pieces, plain)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)


hold("wordbpe", encoder.cache_clear)
