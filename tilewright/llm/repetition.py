"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Rolling hashes of every word n-gram length are computed in numpy, one document
at a time; nothing is shuffled and no document meets another.  A text that is
null, empty or white space has no words and fails the base rule.  Rows are
independent, so repeated rows and ids give repeated results; other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import WordHashes, covered, free_caches, prepare, text_bytes, window_hashes


@dataclass(frozen=True)
class RepetitionRules:
    """Limits on shares of a document's lines, word characters and words.

    ``top``: n -> share inside all occurrences of the most frequent n-gram.
    ``duplicated``: n -> share inside n-grams that occur twice or more.
    """

    min_words: int = 50
    repeat_window: int = 3
    max_repeat_percent: int = 50
    max_dup_line_share: float = 0.50
    max_dup_line_chars: float = 0.30
    top: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    duplicated: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.29), (7, 0.28), (8, 0.27), (9, 0.26), (10, 0.25))
    max_symbols_per_word: float = 0.10


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, top_chars array<long>, dup_chars array<long>"
)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def _repeated(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Positions whose value occurs twice or more, their values' group number
    and the groups' sizes; None if all differ."""
    s = np.sort(h)
    if len(s) < 2 or not (s[1:] == s[:-1]).any():
        return None
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    many = sizes[group] > 1
    return order[many], group[many], sizes


def measure(data: bytes, rules: RepetitionRules, cache: WordHashes) -> tuple:
    """All measures of one text, in the order of SCHEMA after doc_id."""
    arr = np.frombuffer(data, np.uint8)
    words = data.split()
    n = len(words)
    heads = (arr & 0xC0) != 0x80
    word_chars = int(np.count_nonzero(heads) - np.count_nonzero(SPACES[arr]))
    n_symbols = int(np.count_nonzero(SYMBOLS[arr]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_dup_lines = dup_line_chars = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for x in lines:
            if x in seen:
                n_dup_lines += 1
                dup_line_chars += sum(len(w.decode("utf-8", "replace")) for w in x.split())
            seen.add(x)
    h = cache.of(words)
    if word_chars == sum(map(len, words)):
        lens = np.fromiter(map(len, words), np.int64, n)
    else:
        lens = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, n)
    tops, dups = dict(rules.top), dict(rules.duplicated)
    top_chars, dup_chars, n_repeat = {}, {}, 0
    roll, length, live = h, 1, True
    for k in sorted({*tops, *dups, rules.repeat_window}):
        found = None
        if live and n > k:
            while length < k:
                roll = roll[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[length:]
                length += 1
            found = _repeated(roll)
            live = found is not None  # no repeated n-gram: no longer one either
        at = np.sort(found[0]) if found else np.empty(0, np.int64)
        mask = covered(at, k, n) if len(at) else None
        if k == rules.repeat_window and mask is not None:
            n_repeat = int(np.count_nonzero(mask))
        if k in dups:
            dup_chars[k] = int(lens[mask].sum()) if mask is not None else 0
        if k in tops:
            best = 0
            if found:
                # Of equally frequent n-grams the one that comes first; positions ascend within a group.
                where, group, sizes = found
                g = group[where == where[sizes[group] == sizes.max()].min()][0]
                best = int(lens[covered(np.sort(where[group == g]), k, n)].sum())
            top_chars[k] = best
    base_failed = n < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n
    kept = not base_failed and not (
        n_dup_lines > rules.max_dup_line_share * len(lines)
        or dup_line_chars > rules.max_dup_line_chars * word_chars
        or n_symbols > rules.max_symbols_per_word * n
        or any(top_chars[k] > m * word_chars for k, m in rules.top)
        or any(dup_chars[k] > m * word_chars for k, m in rules.duplicated)
    )
    return (n, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, dup_line_chars,
            [top_chars[k] for k, _ in rules.top], [dup_chars[k] for k, _ in rules.duplicated])


def repetition_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the measures, ``base_failed`` and ``kept``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        cache = WordHashes()
        for b in batches:
            rows = [measure(x or b"", rules, cache) for x in (v.as_py() for v in b.column(1))]
            cols = list(zip(*rows)) if rows else [()] * 10
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.list_(pa.int64())] * 2
            arrays = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("b")).mapInArrow(run, SCHEMA)
