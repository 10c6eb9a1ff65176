"""What the corpus operators share: the shared folder, batches, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tilewright.shared import clear_scratch, drop_path, saved, scratch, shared_dir  # noqa: F401
from tilewright.shipping import ship

#: Entries of a per-worker word cache; it is emptied beyond that, so its memory is bounded.
CACHE_ENTRIES = 200_000
#: Multiplier of the polynomial window hashes (odd, 64 bits).
WINDOW_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Rows of an Arrow batch.
BATCH_ROWS = 512
ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_READ = "spark.sql.parquet.columnarReaderBatchSize"

def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound the rows that Python gets and that the Parquet
    reader decodes at once: ``BATCH_ROWS``.

    Spark's own bounds of 10,000 and 4096 rows are too much for long texts,
    whose batches must fit a worker's memory and 2 GB.  A smaller bound of the session stays.
    """
    ship(spark)
    for name in (ROWS_AT_ONCE, ROWS_READ):
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished steps now."""
    gc.collect()
    spark._jvm.System.gc()
    trim_memory()


def text_bytes(docs: DataFrame, text_col: str = "text"):
    """The text column as UTF-8 bytes (null stays null)."""
    return F.col(text_col).cast("binary")


_caches: list[dict] = []


def keep_cache(cache: dict) -> dict:
    """A worker's cache that outlives its task, until ``free_caches``."""
    _caches.append(cache)
    return cache


def trim_memory() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def free_caches() -> None:
    """Empty what earlier tasks of other operators left in this worker."""
    for c in _caches:
        c.clear()
    trim_memory()


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes each
    (one longer value makes a slice by itself)."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        start, acc = 0, 0
        for i, s in enumerate(sizes.tolist()):
            if acc and acc + s > limit:
                yield b.slice(start, i - start)
                start, acc = i, 0
            acc += s
        if len(sizes) > start:
            yield b.slice(start)


class WordHashes(dict):
    """word (bytes) -> xxh64; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of ``n`` values."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= WINDOW_MULTIPLIER
        out += h[k : len(h) - n + 1 + k]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that all bits are usable."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the positions inside windows of ``n`` that begin at ``starts``."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, starts, 1)
    np.subtract.at(d, np.minimum(starts + n, size), 1)
    return np.cumsum(d[:-1]) > 0
