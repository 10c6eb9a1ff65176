"""Token ids in files: documents in order of their ids, coded by rANS blocks.

A store is a folder with one frequency table (``table.bin``) and shards that
follow each other in document order.  A shard is a header, coded blocks, an
index (documents with their token counts, places of the blocks) and a trailer.
Each block decodes by itself, so shards, blocks and parts of blocks can be read
in parallel; ``read_range`` does so for any range of ids.

Texts are tokenized once and kept in the shared folder, counted over all
documents, dealt by ranges of doc_id and written by one task a shard: to a
temporary name, then renamed, so a repeated or lost task does no harm.

A null text counts as empty and holds the end id alone; an empty table gives a
store without shards.  A doc_id that occurs repeatedly stands once for each
row, in order of the ids; a null doc_id comes first.  Other columns are not
read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm import rans
from tilewright.llm.common import drop_path, free_shuffles, prepare, saved, scratch, small_batches, trim_memory
from tilewright.llm.word_tokens import word_tokenizer

MAGIC = b"TWTOKEN1"
NO_ID = -(1 << 63)
BLOCK_IDS = 1 << 20
SHARD_IDS = 1 << 22
TRAILER = "<QQI8s"  # place and size of the index, its crc32, magic


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian 16-bit integers, the end id last."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_memory()
        tok = word_tokenizer(tokenizer_path, False, "<u2")
        if tok.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        end = np.array([end_id], "<u2").tobytes()
        for b in small_batches(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x + end for x in tok.encode(b.column(1).to_pylist())], pa.binary())], names=["doc_id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; ``vocabulary`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in small_batches(batches, "ids", 8 << 20):
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2"), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for x in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[x.id] = x.n
    return out


def write_store(tokens: DataFrame, path: str, counts: np.ndarray, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the shards; a row for each: shard, path, n_docs, n_ids, n_bytes."""
    spark = tokens.sparkSession
    prepare(spark)
    freq = rans.scaled(counts)
    table = zlib.compress(freq.astype("<u4").tobytes())
    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/table.bin") as f:
        f.write(table)
    shards = max(1, -(-int(counts.sum()) // shard_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(freq)
        shard = TaskContext.get().partitionId()
        to, folder = fs.FileSystem.from_uri(path)
        name, tmp = f"{folder}/shard-{shard:06d}.tok", f"{folder}/.{uuid.uuid4().hex}.tmp"
        doc_ids: list[int] = []
        sizes: list[int] = []
        places: list[tuple[int, int]] = []
        held: list[np.ndarray] = []
        out, at, n_held = None, 0, 0

        def put(data: bytes) -> None:
            nonlocal at
            out.write(data)
            at += len(data)

        def blocks(all_: bool) -> None:
            nonlocal held, n_held
            ids = np.concatenate(held) if held else np.empty(0, "<u2")
            i = 0
            while len(ids) - i >= block_ids or all_ and i < len(ids):
                data = coder.encode(ids[i : i + block_ids])
                places.append((at, len(data)))
                put(data)
                i += block_ids
            held, n_held = [ids[i:]], max(0, len(ids) - i)

        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                out = to.open_output_stream(tmp)
                put(MAGIC)
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(raw.as_buffer(), "<u2")
                doc_ids.append(NO_ID if doc is None else doc)
                sizes.append(len(ids))
                held.append(ids)
                n_held += len(ids)
                if n_held >= 4 * block_ids:
                    blocks(False)
        if out is None:
            return
        blocks(True)
        index = zlib.compress(struct.pack("<QQ", len(doc_ids), len(places)) + np.array(doc_ids, "<i8").tobytes() + np.array(sizes, "<i8").tobytes() + np.array(places, "<i8").tobytes())
        put(index + struct.pack(TRAILER, at, len(index), zlib.crc32(index), MAGIC))
        out.close()
        to.move(tmp, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{path}/shard-{shard:06d}.tok"], "n_docs": [len(doc_ids)], "n_ids": [sum(sizes)], "n_bytes": [at]})

    dealt = tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    return saved(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_ids long, n_bytes long"), f"{path}/manifest")


class Shard:
    """Random access to one shard file."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path)
        folder = name.rpartition("/")[0]
        with where.open_input_stream(f"{folder}/table.bin") as f:
            freq = np.frombuffer(zlib.decompress(f.read()), "<u4")
        self.coder = rans.Coder(freq)
        self.file = where.open_input_file(name)
        size, tail = self.file.size(), struct.calcsize(TRAILER)
        place, n, crc, magic = struct.unpack(TRAILER, self.file.read_at(tail, size - tail))
        index = self.file.read_at(n, place)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{path} is not a whole shard")
        raw = zlib.decompress(index)
        docs, blocks = struct.unpack_from("<QQ", raw)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 16)
        self.sizes = np.frombuffer(raw, "<i8", docs, 16 + 8 * docs)
        self.places = np.frombuffer(raw, "<i8", 2 * blocks, 16 + 16 * docs).reshape(-1, 2)

    def block(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        return self.coder.decode(self.file.read_at(int(self.places[k, 1]), int(self.places[k, 0])), first, last)

    def read_range(self, first: int, last: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
        """Ids ``first`` to ``last`` of the shard."""
        parts = [self.block(k, max(0, first - k * block_ids), last - k * block_ids) for k in range(first // block_ids, -(-last // block_ids)) if k < len(self.places)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def read_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files.

    The shards' totals are summed up over the manifest, which has one row a
    shard; each shard is decoded by one task, block by block.
    """
    prepare(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(path)
                crcs = np.zeros(len(s.sizes), np.int64)
                doc, crc, left = 0, 0, int(s.sizes[0])
                for k in range(len(s.places)):
                    raw = memoryview(s.block(k).astype("<u4").tobytes())
                    at = 0
                    while at < len(raw):
                        take = min(left, (len(raw) - at) // 4)
                        crc = zlib.crc32(raw[at : at + 4 * take], crc)
                        at, left = at + 4 * take, left - take
                        if not left:
                            crcs[doc] = crc
                            doc, crc = doc + 1, 0
                            left = int(s.sizes[doc]) if doc < len(s.sizes) else 0
                starts = base + np.cumsum(s.sizes) - s.sizes
                ids = pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(s.sizes), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("path", "base").repartitionByRange(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_documents(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, path: str | None = None) -> DataFrame:
    """Tokenize, write the store at ``path`` (a new folder of the shared one if
    None) and return its manifest."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-store")
    kept = scratch(spark, "token-ids")
    tokens = saved(tokenized(docs, tokenizer_path, end_id), kept)
    manifest = write_store(tokens, path, id_counts(tokens, vocabulary))
    drop_path(spark, kept)
    free_shuffles(spark)
    return manifest
