"""Byte-level BPE by given ranks: overlapping chunks, stitched, then encoded.

Texts longer than ``chunk`` code points are cut into overlapping chunks, which
are spread over the cluster and pre-tokenised apart.  Two neighbours
resynchronise at a pre-token boundary that both find in their overlap; only
boundaries where white space follows other characters count, since those hold
whatever stands before.  Where an overlap has none (a run without such a
boundary), the neighbours stay together as one piece, which is exact too.  The
pieces are encoded in parallel and a document's ids are their concatenation.
Shorter texts are one piece and never shuffled.

A null text counts as empty and has no ids.  Rows are told apart by a row
number, so repeated ids are kept apart; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import free_caches, prepare



CHUNK = 1 << 15
OVERLAP = 1 << 10
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder over a rank file of ``base64-token rank`` lines."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        # White space as Unicode has it, which the standard classes of this module exceed.
        self.pretoken = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def boundaries(self, text: str, first: int, last: int) -> list[int]:
        """Starts of pre-tokens in [first, last) that begin with white space
        after other characters."""
        out = []
        for m in self.pretoken.finditer(text, max(0, first - 1)):
            b = m.start()
            if b >= last:
                break
            if b >= max(1, first) and self.space.match(text, b) and not self.space.match(text, b - 1):
                out.append(b)
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    key = (rank_file, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of chunks of ``chunk`` code points, each sharing
    ``overlap`` with the one before."""
    step = chunk - overlap
    n = max(1, -(-(len(text) - overlap) // step))
    return [(k * step, text[k * step : k * step + chunk]) for k in range(n)]


def encoded(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the ids of each row as little-endian 32-bit integers."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        c = codec(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(v.as_py()).tobytes() for v in b.column(1)], pa.binary())], names=["doc_id", "ids"])

    short = src.filter(~is_long).mapInArrow(whole, "doc_id long, ids binary")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for b in batches:
            for row, doc, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for k, (start, part) in enumerate(chunks(text, chunk, overlap)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), pa.array([doc], pa.int64()), pa.array([k], pa.int32()), pa.array([start], pa.int64()), pa.array([part], pa.string())],
                        names=["row", "doc_id", "k", "start", "part"],
                    )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        c = codec(rank_file, pattern)
        for b in batches:
            starts, parts = b.column(3).to_pylist(), b.column(4).to_pylist()
            head = [[s + x for x in c.boundaries(t, 0, overlap)] for s, t in zip(starts, parts)]
            tail = [[s + x for x in c.boundaries(t, max(0, chunk - overlap), chunk)] for s, t in zip(starts, parts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=[*b.schema.names, "head", "tail"])

    cut = src.filter(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = cut.mapInArrow(split, "row long, doc_id long, k int, start long, part string").repartition("row", "k")
    cut = cut.mapInArrow(pretokenise, "row long, doc_id long, k int, start long, part string, head array<long>, tail array<long>")
    order = Window.partitionBy("row").orderBy("k")
    cut = cut.withColumn("sync", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    cut = cut.withColumn("piece", F.sum(F.when(F.col("sync").isNull(), 0).otherwise(1)).over(order))
    pieces = cut.groupBy("row", "doc_id", "piece").agg(F.array_sort(F.collect_list(F.struct("k", "start", "part"))).alias("parts"), F.max("sync").alias("begin"))
    pieces = pieces.withColumn("end", F.lead("begin").over(Window.partitionBy("row").orderBy("piece")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        c = codec(rank_file, pattern)
        for b in batches:
            out = []
            for parts, begin, end in zip(*(b.column(i).to_pylist() for i in range(3, 6))):
                first = parts[0]["start"]
                text = "".join(p["part"] if i == len(parts) - 1 else p["part"][: parts[i + 1]["start"] - p["start"]] for i, p in enumerate(parts))
                out.append(c.encode(text[(begin or first) - first : None if end is None else end - first]).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=["row", "doc_id", "piece", "ids"])

    ids = pieces.select("row", "doc_id", "piece", "parts", "begin", "end").mapInArrow(encode, "row long, doc_id long, piece long, ids binary")
    whole_docs = ids.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(x["ids"] for x in v.as_py()) for v in b.column(1)], pa.binary())], names=["doc_id", "ids"])

    return short.unionByName(whole_docs.select("doc_id", "p").mapInArrow(join, "doc_id long, ids binary"))


def round_trip(ids: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Decode each row's ids; digests of the ids and of the decoded bytes."""
    prepare(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        c = codec(rank_file, pattern)
        for b in batches:
            raw = [v.as_py() for v in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in raw], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([hashlib.sha256(c.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in raw], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return ids.select("doc_id", "ids").mapInArrow(run, SCHEMA)
