"""Removal of repeated word sequences by level-wise doubling.

A window is ``min_words`` consecutive words of one document.  A word goes if a
window over it has the same words as one that starts earlier (smaller doc_id,
or earlier in the same document).

Levels have ``first_words``, twice that, and so on, the last being
``min_words``.  At each level below the last, every window that is still a
candidate names one of its shorter windows: the one with the least hash, so
that equal windows name equal ones and neighbours mostly name the same.  A
named window that occurs but once ends the candidates that named it; windows
repeated at this length alone go on to twice the length, until the last level
compares the windows themselves.  No repeated window is ever lost.

What travels is one row for each named window (about one in six words at the
first level), then one for each candidate window; singles and first
occurrences come back to their documents.  Counting is by hash with partial
sums, so a passage that a third of the documents share is one row a task.

Words are runs of other bytes than ASCII white space.  A null or empty text has
none.  Fewer than ``min_words`` words are never removed.  A null doc_id comes
before all others.  Rows that share a doc_id, or have none, are told apart and
ordered by a hash of their text (``row``; 0 for all where each has an id of its
own); rows that repeat a text under one doc_id are one document and remove
nothing from each other.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import WordHashes, covered, drop_path, free_caches, free_shuffles, mixed, prepare, saved, scratch, small_batches, text_bytes, window_hashes

NO_ID = -(1 << 63)
_word_spans = re.compile(rb"[^\x20\x09-\x0D]+")


def levels_of(min_words: int, first_words: int) -> list[int]:
    """Lengths below ``min_words``, each twice the one before."""
    out = []
    while first_words < min_words:
        out.append(first_words)
        first_words *= 2
    return out


def named(h: np.ndarray, length: int, min_words: int) -> np.ndarray:
    """For each window of ``min_words``, where its named window of ``length``
    begins: the leftmost of the least hashes."""
    short = mixed(window_hashes(h, length))
    if len(short) < min_words - length + 1:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(short, min_words - length + 1)
    return np.arange(len(view)) + view.argmin(axis=1)


def candidates(h: np.ndarray, levels: list[int], singles: list, min_words: int) -> np.ndarray:
    """Mask of the windows whose named windows were repeated at each level so far."""
    alive = np.ones(max(0, len(h) - min_words + 1), bool)
    for length, gone in zip(levels, singles):
        if len(gone) and len(alive):
            alive &= ~np.isin(named(h, length, min_words), np.asarray(gone))
    return alive


def _state_columns(levels: list[int]) -> list[str]:
    return [f"single_{n}" for n in levels]


def _with_state(src: DataFrame, states: list[tuple[str, DataFrame]]) -> DataFrame:
    for _, state in states:
        src = src.join(state, ["doc_id", "row"], "left")
    return src


def _level(src: DataFrame, done: list[int], states: list, length: int, min_words: int) -> DataFrame:
    """(doc_id, row, single_N): the document's named windows that occur but once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        cache = WordHashes()
        for b in small_batches(batches, "b", 4 << 20):
            docs, own, places, hashes = [], [], [], []
            for i, (doc, row) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                h = cache.of((b.column(2)[i].as_py() or b"").split())
                alive = candidates(h, done, [b.column(3 + j)[i].as_py() or () for j in range(len(done))], min_words)
                if alive.any():
                    at = np.unique(named(h, length, min_words)[alive])
                    docs.append(np.full(len(at), doc))
                    own.append(np.full(len(at), row))
                    places.append(at)
                    hashes.append(mixed(window_hashes(h, length))[at].view(np.int64))
            if docs:
                columns = [np.concatenate(x) for x in (hashes, docs, own, places)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns[:3], columns[3].astype(np.int32))], names=["h", "doc_id", "row", "place"])

    rows = _with_state(src, states).mapInArrow(run, "h long, doc_id long, row long, place int")
    once = rows.groupBy("h").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("doc_id", "row", "place"))).filter("n = 1")
    return once.groupBy("doc_id", "row").agg(F.collect_list("place").alias(f"single_{length}"))


def _firsts(src: DataFrame, levels: list[int], states: list, min_words: int, alone: bool) -> DataFrame:
    """(doc_id, row, firsts): hashes of candidate windows that occur in no
    earlier document.  ``alone``: each row has a doc_id of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        cache = WordHashes()
        for b in small_batches(batches, "b", 4 << 20):
            docs, own, high, low = [], [], [], []
            for i, (doc, row) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                h = cache.of((b.column(2)[i].as_py() or b"").split())
                alive = candidates(h, levels, [b.column(3 + j)[i].as_py() or () for j in range(len(levels))], min_words)
                if alive.any():
                    one, at = np.unique(window_hashes(h, min_words)[alive], return_index=True)
                    docs.append(np.full(len(one), doc))
                    own.append(np.full(len(one), row))
                    high.append(one.view(np.int64))
                    # A second hash, so that chance equality of 64 bits decides nothing.
                    low.append((mixed(window_hashes(mixed(h), min_words))[np.flatnonzero(alive)[at]] >> np.uint64(33)).astype(np.int32))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (high, low, docs, own)], names=["h", "g", "doc_id", "row"])

    rows = _with_state(src, states).mapInArrow(run, "h long, g int, doc_id long, row long").groupBy("h", "g")
    # Two numbers are aggregated by hash, a struct of them by a sort.
    first = rows.agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")) if alone else rows.agg(F.min(F.struct("doc_id", "row")).alias("at")).select("h", "at.*")
    return first.groupBy("doc_id", "row").agg(F.collect_list("h").alias("firsts"))


def repeated(h: np.ndarray, alive: np.ndarray, firsts, min_words: int) -> np.ndarray:
    """Mask of the words to remove.  ``firsts``: hashes of the windows whose
    first occurrence is in this document."""
    if not alive.any():
        return np.zeros(len(h), bool)
    at = np.flatnonzero(alive)
    w = window_hashes(h, min_words)[at].view(np.int64)
    again = ~np.isin(w, np.asarray(firsts, np.int64))
    _, first = np.unique(w, return_index=True)
    later = np.ones(len(w), bool)
    later[first] = False
    return covered(at[again | later], min_words, len(h))


def cut_text(data: bytes, gone: np.ndarray) -> bytes:
    """The text without its removed words and the white space after them."""
    spans = [m.span() for m in _word_spans.finditer(data)]
    out, at = [], 0
    for i, (start, _) in enumerate(spans):
        if gone[i]:
            if i == 0 or not gone[i - 1]:
                out.append(data[at:start])
            at = spans[i + 1][0] if i + 1 < len(spans) else len(data)
    return b"".join(out) + data[at:]


def substring_dedup(docs: DataFrame, min_words: int = 20, first_words: int = 10, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row for each document: n_words, n_removed, kept_sha256 (of the kept
    words joined by one blank), the columns ``keep`` and, on demand,
    ``kept_text``: the text with the removed words cut out."""
    spark = docs.sparkSession
    prepare(spark)
    levels = levels_of(min_words, first_words)
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    alone = docs.groupBy(doc_id.alias("doc_id")).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | (F.col("doc_id") == NO_ID)).isEmpty()
    identity = [doc_id.alias("doc_id"), (F.lit(0).cast("long") if alone else F.xxhash64(text_bytes(docs, text_col))).alias("row"), text_bytes(docs, text_col).alias("b")]
    src = docs.select(*identity)
    states: list[tuple[str, DataFrame]] = []
    paths = []
    for k, length in enumerate(levels):
        paths.append(scratch(spark, f"singles-{length}"))
        states.append((paths[-1], saved(_level(src, levels[:k], states, length, min_words), paths[-1])))
        free_shuffles(spark)
    paths.append(scratch(spark, "firsts"))
    firsts = saved(_firsts(src, levels, states, min_words, alone), paths[-1])
    free_shuffles(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        cache = WordHashes()
        n_keep = len(keep)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                data = b.column(2)[i].as_py() or b""
                words = data.split()
                h = cache.of(words)
                state = [b.column(3 + n_keep + j)[i].as_py() or () for j in range(len(levels) + 1)]
                gone = repeated(h, candidates(h, levels, state[:-1], min_words), state[-1], min_words)
                n = int(np.count_nonzero(gone))
                kept = b" ".join(words if not n else [w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((len(words), n, hashlib.sha256(kept).hexdigest(), (cut_text(data, gone) if n else data) if with_text else None))
            cols = list(zip(*rows)) or [()] * 4
            ids = b.column(0)
            out = [pa.array([None if x == NO_ID else x for x in ids.to_pylist()], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(cols[3], pa.binary()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([*out, *(b.column(3 + j) for j in range(n_keep))], names=[*names, *(f"keep_{c}" for c in keep)])

    own = docs.select(*identity, *(F.col(c).alias(f"keep_{c}") for c in keep))
    kinds = dict(own.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * with_text + "".join(f", `keep_{c}` {kinds[f'keep_{c}']}" for c in keep)
    joined = _with_state(own, states).join(firsts, ["doc_id", "row"], "left")
    result = joined.mapInArrow(run, schema).withColumnsRenamed({f"keep_{c}": c for c in keep})
    if with_text:
        result = result.withColumn("kept_text", F.col("kept_text").cast("string"))
    return result
