"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (one to three
letters, words padded with a blank) over all labelled training rows; a
document goes to the language whose profile has the smallest out-of-place
distance from the document's own list.

Training counts are gathered in each task, then summed by (language, n-gram);
what reaches the driver is languages x ``profile_size`` rows.  A text that is
null or has no letter is ``und`` with score 0; with no training rows every
text is ``und``.  Ties in counts go by the n-gram's code points, ties between
languages by name.  A row without an id has no remainder: it is neither learned
from nor held out.  Rows are independent of each other; columns besides the named
ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import free_caches, prepare, small_batches

PROFILE_SIZE = 1000
DOC_GRAMS = 400
BLANK = 1
BITS = np.int64(21)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> np.ndarray:
    """Keys of all n-grams of one to three letters: 21 bits for each, blanks 1."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letter_table()[c]
    c = np.where(letter, c, BLANK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = c[keep]
    if len(c) < 3:
        return np.empty(0, np.int64)
    two = (c[:-1] << BITS) | c[1:]
    three = ((two[:-1] << BITS) | c[2:])[c[1:-1] != BLANK]
    return np.concatenate([c[c != BLANK], two, three])


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys; ``keys`` ascend, so ties do too."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Rank table of all languages' n-grams, for distances by one lookup."""

    def __init__(self, profiles: dict[str, list[int]], profile_size: int = PROFILE_SIZE, doc_grams: int = DOC_GRAMS):
        self.langs = sorted(profiles)
        self.size, self.doc_grams = profile_size, doc_grams
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.int64))
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)
        for j, name in enumerate(self.langs):
            self.rank[np.searchsorted(self.keys, np.array(profiles[name], np.int64)), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if text else ()
        if not len(g) or not self.langs:
            return "und", 0.0
        keys, counts = np.unique(g, return_counts=True)
        top = ranked(keys, counts, self.doc_grams)
        at = np.minimum(np.searchsorted(self.keys, top), len(self.keys) - 1)
        at = np.where(self.keys[at] == top, at, len(self.keys))
        r = self.rank[at]
        d = np.where(r < 0, self.size, np.abs(r - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(d))
        return self.langs[best], float(1 - d[best] / (self.size * len(top)))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", profile_size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """Profiles of all rows whose language is known: language -> n-grams by rank."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([p[0] for p in parts])
            u, inv = np.unique(keys, return_inverse=True)
            return u, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)

        def rows(name: str) -> pa.RecordBatch:
            u, n = merged(held.pop(name))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u), pa.array(n)], names=["lang", "gram", "n"])

        for b in small_batches(batches, "text", 1 << 18):
            by: dict[str, list[str]] = {}
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(name, []).append(text)
            for name, texts in by.items():
                own = held.setdefault(name, [])
                own.append(np.unique(grams("\n".join(texts)), return_counts=True))
                if len(own) > 8:
                    own[:] = [merged(own)]
                    if len(own[0][0]) > 700_000:
                        yield rows(name)
        for name in list(held):
            yield rows(name)

    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    top = counts.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= profile_size)
    out: dict[str, list[int]] = {}
    for x in sorted(top.collect(), key=lambda x: (x.lang, x.r)):
        out.setdefault(x.lang, []).append(x.gram)
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), profile_size: int = PROFILE_SIZE) -> DataFrame:
    """``lang_pred`` and ``score`` of every row, with the columns ``keep``."""
    prepare(docs.sparkSession)
    model = Profiles(profiles, profile_size)

    columns = ["doc_id", *(c for c in keep if c != "doc_id")]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), *columns[1:], *([] if text_col in columns else [F.col(text_col).alias("__text")]))
    at = own.columns.index(text_col if text_col in columns else "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for b in batches:
            got = [model.predict(v.as_py()) for v in b.column(at)]
            found = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), *found], names=[*columns, "lang_pred", "score"])

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "lang_pred string", "score double"]))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; remainder 2 is held out of training.
    Null without an id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
