"""Harmonic packing of documents into sequences of a fixed capacity.

Full sequences are cut off a document's front.  What is left, whole, belongs to
the reciprocal-capacity class k = capacity // length, whose bins take a fixed
count of k pieces.  A bin with its k pieces has room for less than one more; where
that room is more than ``MOST_PADDING`` of the capacity, the bin waits, and the
next documents' rests are cut to fill waiting bins before what is left of them
goes to a class.  So a rest is cut only where padding would be more than that
share, and at most one bin waits for each document.

Workers fill bins on their own.  What is left of a worker's open bins is strung
together and cut at the capacity; its last rest is cut at powers of two, so it
needs no padding.

A sequence number is (worker << 33) + running number: unique, not gapless.  A
null text counts as empty and is the end id alone.  A repeated row is packed
again, once for each; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import prepare, small_batches, trim_memory
from tilewright.llm.word_tokens import word_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Share of a sequence that may be padding.
MOST_PADDING = 1 / 128


class Bins:
    """The bins of one worker: for each class an open one with fewer pieces than
    fill it, and those that wait for the last few ids."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next = capacity, worker << 33
        self.open: dict[int, list[tuple]] = {}
        self.waiting: deque[list] = deque()  # [pieces, room]
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        """pieces: (doc_id, start, ids, doc_tokens); they become a sequence."""
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """Place all ids of a document."""
        total = len(ids)
        at = total - total % self.capacity
        for start in range(0, at, self.capacity):
            self._close([(doc, start, ids[start : start + self.capacity], total)])
        while at < total and self.waiting:
            bin_ = self.waiting[0]
            take = min(bin_[1], total - at)
            bin_[0].append((doc, at, ids[at : at + take].copy(), total))
            bin_[1] -= take
            at += take
            if not bin_[1]:
                self._close(self.waiting.popleft()[0])
        if at < total:
            k = self.capacity // (total - at)
            pieces = self.open.setdefault(k, [])
            pieces.append((doc, at, ids[at:].copy(), total))
            if len(pieces) == k:
                del self.open[k]
                room = self.capacity - sum(len(p[2]) for p in pieces)
                if room > MOST_PADDING * self.capacity:
                    self.waiting.append([pieces, room])
                else:
                    self._close(pieces)

    def finish(self) -> None:
        """String the left pieces together, longest class first; cut at the capacity, the last rest at powers of two."""
        left = [p for pieces, _ in self.waiting for p in pieces] + [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        self.waiting.clear()
        total = sum(len(p[2]) for p in left)
        room = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if (total % self.capacity) >> b & 1]
        queue = iter(left)
        doc, start, ids, n = next(queue, (None, 0, np.empty(0, np.uint32), 0))
        for size in room:
            own = []
            while size:
                if not len(ids):
                    doc, start, ids, n = next(queue)
                take = min(size, len(ids))
                own.append((doc, start, ids[:take], n))
                start, ids, size = start + take, ids[take:], size - take
            self._close(own)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: which ids of which document, and where they lie."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        tok = word_tokenizer(tokenizer_path, True, "<u4")
        end = np.array([end_id], "<u4").tobytes()
        bins = Bins(TaskContext.get().partitionId(), capacity)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*bins.out)) or [()] * 7
            bins.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in small_batches(batches, "text", 4 << 20):
            for doc, raw in zip(b.column(0).to_pylist(), tok.encode(b.column(1).to_pylist())):
                bins.add(doc, np.frombuffer(raw + end, "<u4"))
            yield flush()
        bins.finish()
        yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
