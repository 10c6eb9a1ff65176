"""Media columns: content-addressed payloads in tar shards.

A text's payload (its UTF-8 bytes, zero bytes up to a positive multiple of 64)
is stored losslessly as a grey 8-bit PNG image of 64 columns.  Each task writes
tar shards whose members are named by the payload's SHA-256, once for each
payload; rows carry digest, shard, offset and length of the copy that their own
task wrote.  So no row looks for its payload, and copies that a third of all
rows share are read in as many tasks as wrote them.  ``addressed`` gives the one
place of each payload over all shards.

Metadata columns come from reading the image header alone, at its place in the
shard; the columns of the content then come from the rest.

A shard is written to a temporary name and renamed, so a repeated or lost task
does no harm.  A null text counts as empty: 64 zero bytes.  Repeated rows share
one stored payload; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import free_caches, prepare, saved, scratch, text_bytes

WIDTH = 64
SHARD_BYTES = 256 << 20
#: Stored bytes that one task reads back.
READ_BYTES = 64 << 20
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(data: bytes, level: int = 6) -> bytes:
    """A PNG image, grey with 8 bits, ``WIDTH`` columns, no row filters."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of an image, from its first ``HEADER_BYTES``."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def from_image(data: bytes) -> bytes:
    """The samples of an image that ``to_image`` made."""
    width, height, _ = header(data)
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("an image's chunk is damaged")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("row filters are not expected")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, and which columns' means lie above it, as hexadecimal bits."""
    a = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    sums = a.sum(axis=0, dtype=np.int64)
    bits = np.packbits(sums * WIDTH > sums.sum())
    return f"{int(sums.sum() * 1000 // a.size):06d}-{bits.tobytes().hex()}"


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store all payloads; a row for each document: doc_id, n_bytes, digest,
    shard, offset, length."""
    prepare(docs.sparkSession)
    schema = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        to, folder = fs.FileSystem.from_uri(path)
        to.create_dir(folder, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        known: dict[bytes, tuple[str, int, int]] = {}
        out = tar = None
        tmp = f"{folder}/.{uuid.uuid4().hex}.tmp"

        def close() -> None:
            nonlocal out, tar, number
            if tar is not None:
                tar.close()
                out.close()
                to.move(tmp, f"{folder}/media-{part:06d}-{number:04d}.tar")
                number, out, tar = number + 1, None, None
                known.clear()

        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                data = payload(text)
                digest = hashlib.sha256(data).digest()
                if digest not in known:
                    if tar is None:
                        out = to.open_output_stream(tmp)
                        tar = tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT)
                    image = to_image(data)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(image)
                    known[digest] = (f"{path}/media-{part:06d}-{number:04d}.tar", tar.offset + tarfile.BLOCKSIZE, len(image))
                    tar.addfile(info, io.BytesIO(image))
                rows.append((doc, len(text or b""), digest, *known[digest]))
                if tar is not None and tar.offset > shard_bytes:
                    close()
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])
        close()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, text_col).alias("b"))
    return saved(src.mapInArrow(run, schema), f"{path}/rows")


def addressed(rows: DataFrame) -> DataFrame:
    """One row for each digest: where its first copy lies."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


HEADER = "width int, height int, bits int"
CONTENT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _header(read, length: int) -> tuple:
    return header(read(0, min(HEADER_BYTES, length)))


def _content(read, length: int, digest: bytes) -> tuple:
    image = read(0, length)
    samples = from_image(image)
    own = hashlib.sha256(samples)
    if own.digest() != digest:
        raise ValueError("a payload does not have its address")
    return (len(samples), own.hexdigest(), zlib.crc32(samples[-WIDTH:]), length, hashlib.sha256(image).hexdigest(), feature(samples))


def header_columns(rows: DataFrame) -> DataFrame:
    """The rows with width, height and bits, by range reads of the headers."""
    return _read(rows, HEADER, lambda read, length, digest: _header(read, length))


def content_columns(rows: DataFrame) -> DataFrame:
    """The rows with the header's columns and, from the payload read back whole,
    its sizes, digests and feature."""
    return _read(rows, f"{HEADER}, {CONTENT}", lambda read, length, digest: (*_header(read, length), *_content(read, length, digest)))


def _read(rows: DataFrame, schema: str, columns) -> DataFrame:
    """``rows`` (digest, shard, offset, length and others) with the columns that
    ``columns`` reads at each place.  Rows are dealt in order of their places by
    a range sort, a task for each ``READ_BYTES``, so a shard is read forwards and
    a payload once for all rows of a task that have it."""
    spark = rows.sparkSession
    prepare(spark)
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // READ_BYTES + 1)
    near = rows.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    names = near.columns
    place = [names.index(c) for c in ("shard", "offset", "length", "digest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        name = file = last = None
        values: tuple = ()
        for b in batches:
            out = []
            for shard, offset, length, digest in zip(*(b.column(i).to_pylist() for i in place)):
                if (shard, offset) != last:
                    if shard != name:
                        where, own = fs.FileSystem.from_uri(shard)
                        name, file = shard, where.open_input_file(own)
                    values = columns(lambda at, n, base=offset: file.read_at(n, base + at), length, digest)
                    last = (shard, offset)
                out.append(values)
            cols = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields))], names=[*names, *(n for n, _ in fields)])

    own = ", ".join(f"`{c}` {t}" for c, t in near.dtypes)
    return near.mapInArrow(run, f"{own}, {schema}")


def media_columns(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with its payload's columns."""
    path = path or scratch(docs.sparkSession, "media")
    read = content_columns(write_shards(docs, path, id_col, text_col))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
