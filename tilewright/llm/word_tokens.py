"""Tokenizing with the tokenizers library through a bounded cache of words.

Texts are cut where the library's own pre-tokenizer always cuts, the distinct
words are encoded by the library in batches, and a text's ids are the
concatenation of its words' ids.  A text where such a cut is not certain, or
that may hold a token added to the vocabulary (``<|endoftext|>`` and the like,
which the library takes out of the text first), is encoded whole by the library.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer

from tilewright.llm.common import keep_cache

# A worker has one core; the library's own threads would only spin.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Words of a worker's cache (about 200 bytes each); it is emptied beyond that.
CACHE_WORDS = 800_000
#: Words that go to the library as one text.
WORDS_AT_ONCE = 2000
#: Stands between them: a pre-token of its own that merges with nothing.
MARK = "\0"
#: Plain letters are those before this one: Latin letters, on which all Unicode versions agree.
LATIN_END = "\u0250"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    bytes for themselves, the others for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]

_two_spaces = re.compile(r"\s\s")


class WordTokenizer:
    """``keep_space``: a word keeps the blank before it (byte-level BPE whose
    pre-tokens are `` ?letters`` etc.); else white space is dropped by the
    tokenizer (word-end BPE)."""

    def __init__(self, path: str, keep_space: bool, dtype: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Upper and lower case are one here: a normalizer may drop case before tokens are looked for.
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.keep_space, self.dtype = keep_space, np.dtype(dtype)
        self.first: dict[str, bytes] = keep_cache({})
        self.later: dict[str, bytes] = keep_cache({}) if keep_space else self.first
        self.byte_letters = byte_letters()
        self.endings = dict(zip(",.;:!?", self._whole(list(",.;:!?"))))
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        tied = [t for t, i in self.tokenizer.get_vocab().items() if "\u0100" in t and t not in ("\u0100", "\u0100</w>")]
        self.mark = mark[0] if len(mark) == 1 and not tied else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of each word, encoded as one text with marks between."""
        if self.mark is None or any(MARK in w for w in words):
            return self._whole([lead + w for w in words])
        between = MARK if self.keep_space else f" {MARK} "
        texts = [between.join([lead + w for w in words[i : i + WORDS_AT_ONCE]]) for i in range(0, len(words), WORDS_AT_ONCE)]
        out: list[bytes] = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            raw, size = ids.tobytes(), self.dtype.itemsize
            ends = (np.append(np.flatnonzero(ids == self.mark), len(ids)) * size).tolist()
            at = 0
            for end in ends:
                out.append(raw[at:end])
                at = end + size
        if len(out) != len(words):
            raise ValueError("a word holds the mark")
        return out

    def _letters(self, words: list[str], lead: str) -> list[bytes]:
        """The ids of each word of plain letters, in lower case where the
        tokenizer drops case: one pre-token, so the library's model gets it
        directly."""
        tokenize, letters = self.tokenizer.model.tokenize, self.byte_letters
        code = "H" if self.dtype.itemsize == 2 else "I"
        first = letters[32] if lead else ""
        out = []
        for w in words:
            if not w.isascii():
                w = "".join(map(letters.__getitem__, w.encode()))
            out.append(array(code, [t.id for t in tokenize(first + w)]).tobytes())
        return out

    def _learn(self, cache: dict[str, bytes], words: set[str], lead: str) -> None:
        """Add words to a cache.  Letters and one mark after them are always two
        pre-tokens, so such a word is its letters' ids and the mark's; where the
        tokenizer drops case, plain letters are looked up in lower case."""
        stems: dict[str, str] = {}
        for w in words:
            stem = w
            if not w.isalpha() and w[-1:] in self.endings and w[:-1].isalpha():
                stem = w[:-1]
            if not self.keep_space and stem.isalpha():
                low = stem.lower()
                if not (low.isalpha() and (stem.isascii() or max(stem) < LATIN_END)):
                    low = w  # its case or its letters are left to the library, with the mark
                stem = low
            stems[w] = stem
        new = [x for x in dict.fromkeys(stems.values()) if x not in cache]
        plain = []
        if sys.byteorder == "little":
            plain = [x for x in new if x.isalpha() and (x.isascii() or max(x) < LATIN_END) and (self.keep_space or x == x.lower())]
        cache.update(zip(plain, self._letters(plain, lead)))
        new = [x for x in new if x not in cache] if plain else new
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            cache.update(zip(some, self._words(some, lead)))
        for w, stem in stems.items():
            if w is not stem and w not in cache:
                end = w[-1:]
                cache[w] = cache[stem] + (self.endings[end] if end in self.endings and len(w) > len(stem) else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        parts: list[list[str] | None] = []
        if max(len(self.first), len(self.later)) > CACHE_WORDS:
            self.first.clear()
            self.later.clear()
        heads, tails = set(), set()
        for t in texts:
            if self.added and self.added.search(t):
                p = None
            elif not self.keep_space:
                p = t.replace("\n", " ").split(" ")
                tails.update(p)
            elif _two_spaces.search(t) or t[:1] == " ":
                p = None
            else:
                p = t.split(" ")
                heads.add(p[0])
                tails.update(p[1:])
            parts.append(p)
        for cache, words, lead in ((self.first, heads, ""), (self.later, tails, " " if self.keep_space else "")):
            self._learn(cache, words.difference(cache), lead)
        out = []
        for t, p in zip(texts, parts):
            if p is None:
                out.append(self._whole([t])[0])
            elif self.keep_space:
                out.append(self.first[p[0]] + b"".join(map(self.later.__getitem__, p[1:])))
            else:
                out.append(b"".join(map(self.first.__getitem__, p)))
        return out


_open: dict[tuple[str, bool, str], WordTokenizer] = keep_cache({})


def word_tokenizer(path: str, keep_space: bool, dtype: str) -> WordTokenizer:
    key = (path, keep_space, dtype)
    if key not in _open:
        _open[key] = WordTokenizer(*key)
    return _open[key]
