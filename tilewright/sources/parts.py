"""Single files that the executors put together in a folder they share.

Each task writes its rows to a part of its own; once all sizes are known, tasks
copy the parts to their places.  The driver sees a row for each part.  Parts are
named by the attempt that wrote them, so retries do no harm.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilewright.shipping import ship


def staged(df: DataFrame, folder: str, write: Callable[[Iterator[pa.RecordBatch], str], bytes]) -> list[tuple[int, str, int, bytes]]:
    """(partition, path, size, what ``write`` returned) of a part for each
    partition of ``df``, in order; ``write`` fills the file it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = os.path.join(folder, uuid.uuid4().hex)
        note = write(batches, path)
        size = os.path.getsize(path) if os.path.exists(path) else 0
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [path], "size": [size], "note": [note]})

    ship(df.sparkSession)
    os.makedirs(folder, exist_ok=True)
    return sorted(tuple(r) for r in df.mapInArrow(run, "part long, path string, size long, note binary").collect())


def placed(spark: SparkSession, path: str, places: list[tuple[str, int]], also: Callable[[str, int], bytes] | None = None) -> list[bytes]:
    """Copy parts (file, offset) into ``path``, one task each; ``also`` may do
    more with a part, and its results are returned in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part, at in zip(*(c.to_pylist() for c in b.columns)):
                with open(part, "rb") as src, open(path, "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(src, out, 1 << 20)
                note = also(part, at) if also else b""
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "note": pa.array([note], pa.binary())})

    rows = [(i, p, at) for i, (p, at) in enumerate(places)]
    if not rows:
        return []
    df = spark.createDataFrame(rows, "i int, part string, at long").repartition(len(rows), "i")
    return [bytes(r.note) for r in sorted(df.mapInArrow(run, "i int, note binary").collect())]


def joined(df: DataFrame, path: str, encode: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], head: bytes = b"", between: bytes = b"", tail: bytes = b"") -> None:
    """One file of ``head``, the bytes of each partition in order with
    ``between`` after all but the last of those that have any, and ``tail``."""

    def write(batches: Iterator[pa.RecordBatch], part: str) -> bytes:
        with open(part, "wb") as f:
            f.writelines(encode(batches))
        return b""

    folder = f"{path}.parts"
    parts = [(p, size) for _, p, size, _ in staged(df, folder, write) if size]
    with open(path, "wb") as f:
        f.write(head)
        at, places = len(head), []
        for i, (p, size) in enumerate(parts):
            if i:
                _put(f, at, between)
                at += len(between)
            places.append((p, at))
            at += size
        _put(f, at, tail)
        f.truncate(at + len(tail))
    placed(df.sparkSession, path, places)
    shutil.rmtree(folder, ignore_errors=True)


def _put(f: BinaryIO, at: int, data: bytes) -> None:
    f.seek(at)
    f.write(data)
