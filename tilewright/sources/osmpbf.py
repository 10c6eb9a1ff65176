"""Reader and writer of OSM PBF files as a Python data source.

``spark.read.format("osmpbf").option("entity", "nodes").load(paths)`` with
entity nodes, ways or relations; several paths are joined by commas and told
apart by ``input_idx``.  The driver lists the blobs by their headers alone;
each partition decodes some of them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilewright.sources.parts import joined

#: Limits in bytes of a blob's header and content.
MOST_HEADER, MOST_BLOB = 64 << 10, 32 << 20
BYTES_PER_PARTITION = 16 << 20
SCHEMAS = {
    "nodes": "input_idx int, id long, lon double, lat double",
    "ways": "input_idx int, id long, node_ids array<long>, tags map<string,string>",
    "relations": "input_idx int, id long, tags map<string,string>, members array<struct<type:int,ref:long,role:string>>",
}


class PbfError(ValueError):
    """The file is damaged or uses what is not supported."""


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(raw):
            raise PbfError("a number is cut off")
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise PbfError("a number is too long")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; bytes for what has a length."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
            yield key >> 3, value
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
            if at > len(raw):
                raise PbfError("a message is cut off")
        elif kind == 2:
            n, at = varint(raw, at)
            if at + n > len(raw):
                raise PbfError("a message is cut off")
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            raise PbfError(f"wire type {kind}")


def packed(raw: bytes) -> list[int]:
    """Numbers of a packed list; a damaged one is empty."""
    out, at = [], 0
    try:
        while at < len(raw):
            v, at = varint(raw, at)
            out.append(v)
    except PbfError:
        return []
    return out


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _sums(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += zigzag(v)
        out.append(total)
    return out


def blobs(path: str) -> list[tuple[str, int, int]]:
    """(kind, offset, size) of each blob, from the headers."""
    out = []
    with open(path, "rb") as f:
        while head := f.read(4):
            if len(head) < 4:
                raise PbfError("the file ends inside a header")
            (n,) = struct.unpack(">I", head)
            if not 0 < n <= MOST_HEADER:
                raise PbfError("a header's size is impossible")
            raw = f.read(n)
            if len(raw) < n:
                raise PbfError("the file ends inside a header")
            kind, size = "", -1
            for k, v in fields(raw):
                kind, size = (v.decode(), size) if k == 1 else (kind, v) if k == 3 else (kind, size)
            if not 0 <= size <= MOST_BLOB:
                raise PbfError("a blob's size is impossible")
            out.append((kind, f.tell(), size))
            f.seek(size, 1)
            if f.tell() > _size(path):
                raise PbfError("the file ends inside a blob")
    return out


def _size(path: str) -> int:
    import os

    return os.path.getsize(path)


def unpacked(raw: bytes) -> bytes:
    """A blob's content: raw or zlib."""
    for k, v in fields(raw):
        if k == 1:
            return v
        if k == 3:
            d = zlib.decompressobj()
            out = d.decompress(v, MOST_BLOB + 1)
            if len(out) > MOST_BLOB:
                raise PbfError("a blob is too large")
            return out
    raise PbfError("a blob's compression is not supported")


class Block:
    """A primitive block: string table, scale and groups."""

    def __init__(self, raw: bytes):
        self.strings: list[str] = []
        self.granularity, self.lat0, self.lon0 = 100, 0, 0
        self.groups: list[bytes] = []
        for k, v in fields(raw):
            if k == 1:
                self.strings = [s.decode("utf-8", "replace") for n, s in fields(v) if n == 1]
            elif k == 2:
                self.groups.append(v)
            elif k == 17:
                self.granularity = v
            elif k == 19:
                self.lat0 = _signed(v)
            elif k == 20:
                self.lon0 = _signed(v)

    def _place(self, lon: int, lat: int) -> tuple[float, float]:
        return (self.lon0 + self.granularity * lon) / 1e9, (self.lat0 + self.granularity * lat) / 1e9

    def _tags(self, keys: list[int], values: list[int]) -> dict[str, str]:
        n = len(self.strings)
        return {self.strings[k]: self.strings[v] for k, v in zip(keys, values) if k < n and v < n}

    def nodes(self) -> Iterator[tuple]:
        for g in self.groups:
            for k, v in fields(g):
                if k == 1:
                    own = {n: zigzag(x) for n, x in fields(v) if n in (1, 8, 9)}
                    yield own.get(1, 0), *self._place(own.get(9, 0), own.get(8, 0))
                elif k == 2:
                    own = {n: _sums(packed(x)) for n, x in fields(v) if n in (1, 8, 9)}
                    ids, lats, lons = (own.get(n, []) for n in (1, 8, 9))
                    if not len(ids) == len(lats) == len(lons):
                        raise PbfError("dense nodes differ in length")
                    for i, lat, lon in zip(ids, lats, lons):
                        yield i, *self._place(lon, lat)

    def ways(self) -> Iterator[tuple]:
        for g in self.groups:
            for k, v in fields(g):
                if k == 3:
                    own = dict(fields(v))
                    lists = {n: packed(own[n]) if n in own else [] for n in (2, 3, 8)}
                    yield _signed(own.get(1, 0)), _sums(lists[8]), self._tags(lists[2], lists[3])

    def relations(self) -> Iterator[tuple]:
        for g in self.groups:
            for k, v in fields(g):
                if k == 4:
                    own = dict(fields(v))
                    lists = {n: packed(own[n]) if n in own else [] for n in (2, 3, 8, 9, 10)}
                    refs, types = _sums(lists[9]), lists[10]
                    if len(refs) != len(types):
                        raise PbfError("members differ in length")
                    roles = [self.strings[r] if r < len(self.strings) else "" for r in lists[8]]
                    roles += [""] * (len(refs) - len(roles))
                    yield _signed(own.get(1, 0)), self._tags(lists[2], lists[3]), list(zip(types, refs, roles))


@dataclass
class _Part(InputPartition):
    idx: int
    path: str
    places: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.entity = options.get("entity", "nodes")
        seen = dict.fromkeys(p.strip().removeprefix("file://") for p in options["path"].split(",") if p.strip())
        self.paths = list(seen)

    def partitions(self) -> list[_Part]:
        out = []
        for idx, path in enumerate(self.paths):
            own, size = [], 0
            for kind, at, n in blobs(path):
                if kind != "OSMData":
                    continue
                own.append((at, n))
                size += n
                if size >= BYTES_PER_PARTITION:
                    out.append(_Part(idx, path, own))
                    own, size = [], 0
            if own:
                out.append(_Part(idx, path, own))
        return out or [_Part(0, "", [])]

    def read(self, part: _Part) -> Iterator[tuple]:
        if not part.places:
            return
        with open(part.path, "rb") as f:
            for at, n in part.places:
                f.seek(at)
                for row in getattr(Block(unpacked(f.read(n))), self.entity)():
                    yield part.idx, *row


class OsmPbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("entity", "nodes")]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


# --- writers ----------------------------------------------------


def _v(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _z(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _msg(k: int, body: bytes) -> bytes:
    return _v(k << 3 | 2) + _v(len(body)) + body


def _deltas(values: list[int]) -> bytes:
    return b"".join(_v(_z(b - a)) for a, b in zip([0, *values], values))


def _block(nodes: list[tuple[int, float, float]], ways: list[tuple[int, list[int], dict]], relations: list[tuple[int, dict, list[tuple[int, int, str]]]], dense: bool) -> bytes:
    strings = {"": 0}

    def s(text: str) -> int:
        return strings.setdefault(text, len(strings))

    at = lambda v: round(v * 1e7)
    if dense:
        body = _msg(1, _deltas([i for i, _, _ in nodes])) + _msg(8, _deltas([at(y) for _, _, y in nodes])) + _msg(9, _deltas([at(x) for _, x, _ in nodes]))
        groups = [_msg(2, body)]
    else:
        groups = [b"".join(_msg(1, _v(8) + _v(_z(i)) + _v(64) + _v(_z(at(y))) + _v(72) + _v(_z(at(x)))) for i, x, y in nodes)]
    tag = lambda t: _msg(2, b"".join(_v(s(k)) for k in t)) + _msg(3, b"".join(_v(s(v)) for v in t.values()))
    groups.append(b"".join(_msg(3, _v(8) + _v(i) + tag(t) + _msg(8, _deltas(refs))) for i, refs, t in ways))
    groups.append(b"".join(_msg(4, _v(8) + _v(i) + tag(t) + _msg(8, b"".join(_v(s(r)) for _, _, r in m)) + _msg(9, _deltas([x for _, x, _ in m])) + _msg(10, b"".join(_v(k) for k, _, _ in m))) for i, t, m in relations))
    return b"".join(_msg(2, g) for g in groups if g) + _msg(1, b"".join(_msg(1, x.encode()) for x in strings))


def _blob(kind: str, block: bytes, compress: bool = True) -> bytes:
    content = _msg(1, block) if kind == "OSMHeader" or not compress else _msg(3, zlib.compress(block))
    head = _msg(1, kind.encode()) + _v(24) + _v(len(content))
    return struct.pack(">I", len(head)) + head + content


def write(path: str, nodes: list[tuple[int, float, float]], ways: list[tuple[int, list[int], dict]], relations: list[tuple[int, dict, list[tuple[int, int, str]]]] = (), dense: bool = True, compress: bool = True) -> None:
    with open(path, "wb") as f:
        f.write(_blob("OSMHeader", b"") + _blob("OSMData", _block(nodes, ways, relations, dense), compress))


#: Entities of a block, and the node ids or members in it, at most but for one entity.
BLOCK_ENTITIES, BLOCK_REFS = 8000, 200_000


def write_entities(df: DataFrame, path: str, entity: str, dense: bool = True, compress: bool = True) -> None:
    """A file of any size of nodes (id, lon, lat), ways (id, node_ids, tags) or
    relations (id, tags, members), written by the executors block by block."""
    columns = {"nodes": ["id", "lon", "lat"], "ways": ["id", "node_ids", "tags"], "relations": ["id", "tags", "members"]}[entity]

    def block(rows: list[tuple]) -> bytes:
        kinds = {"nodes": [], "ways": [], "relations": []} | {entity: rows}
        return _blob("OSMData", _block(kinds["nodes"], kinds["ways"], kinds["relations"], dense), compress)

    def encode(batches: Iterator) -> Iterator[bytes]:
        rows, refs = [], 0
        for b in batches:
            for values in zip(*b.columns):
                row = tuple(v.as_py() for v in values)
                if entity == "ways":
                    row = (row[0], row[1], dict(row[2]))
                elif entity == "relations":
                    row = (row[0], dict(row[1]), [(m["type"], m["ref"], m["role"]) for m in row[2]])
                rows.append(row)
                refs += len(row[1]) if entity == "ways" else len(row[2]) if entity == "relations" else 1
                if len(rows) >= BLOCK_ENTITIES or refs >= BLOCK_REFS:
                    yield block(rows)
                    rows, refs = [], 0
        if rows:
            yield block(rows)

    joined(df.select(*columns), path, encode, _blob("OSMHeader", b""))
