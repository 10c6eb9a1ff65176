"""Sequential files of tiles: a Python data source to read them, and a writer.

Eight bytes of magic, metadata as JSON behind its 32-bit length, then records of
zoom (8 bits), column, row (32), length (64) and data, all big-endian, rows TMS.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilewright.sources.parts import joined

#: Magic and limits in bytes.
MAGIC = b"TTMG0001"
MOST_METADATA, MOST_TILE = 1 << 20, 64 << 20
RECORD = ">BIIQ"


def write(path: str, metadata: dict[str, str], tiles: Iterable[tuple[int, int, int, bytes]]) -> None:
    head = json.dumps(metadata, sort_keys=True).encode()
    if len(head) > MOST_METADATA:
        raise ValueError("the metadata is too large")
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack(">I", len(head)) + head)
        for z, x, y, data in tiles:
            if len(data) > MOST_TILE:
                raise ValueError("a tile is too large")
            f.write(struct.pack(RECORD, z, x, y, len(data)) + data)


def write_tiles(path: str, metadata: dict[str, str], tiles: DataFrame) -> None:
    """The same for tiles (z, x, y, data) of any size, written by the executors."""
    head = json.dumps(metadata, sort_keys=True).encode()
    if len(head) > MOST_METADATA:
        raise ValueError("the metadata is too large")

    def encode(batches: Iterator) -> Iterator[bytes]:
        for b in batches:
            for z, x, y, data in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                data = data.as_py()
                if len(data) > MOST_TILE:
                    raise ValueError("a tile is too large")
                yield struct.pack(RECORD, z, x, y, len(data)) + data

    joined(tiles.select("z", "x", "y", "data"), path, encode, MAGIC + struct.pack(">I", len(head)) + head)


def _head(f) -> dict[str, str]:
    raw = f.read(12)
    if raw[:8] != MAGIC or len(raw) < 12:
        raise ValueError("not a tile stream")
    (n,) = struct.unpack(">I", raw[8:])
    if n > MOST_METADATA:
        raise ValueError("the metadata is too large")
    return json.loads(f.read(n))


def metadata(path: str) -> dict[str, str]:
    with open(path, "rb") as f:
        return _head(f)


def records(path: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(z, x, y, offset, length) of each tile, without reading the data."""
    size = struct.calcsize(RECORD)
    with open(path, "rb") as f:
        _head(f)
        end = f.seek(0, 2)
        f.seek(0)
        _head(f)
        while raw := f.read(size):
            if len(raw) < size:
                raise ValueError("the file ends inside a record")
            z, x, y, n = struct.unpack(RECORD, raw)
            if n > MOST_TILE or f.tell() + n > end:
                raise ValueError("a tile's length is impossible")
            yield z, x, y, f.tell(), n
            f.seek(n, 1)


class _Part(InputPartition):
    def __init__(self, at: int, n: int):
        self.at, self.n = at, n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"].removeprefix("file://"), int(options.get("rowsPerPartition", 4096))

    def partitions(self) -> list[_Part]:
        """Runs of records by the place of the first and their number."""
        out, size = [], struct.calcsize(RECORD)
        for i, (_, _, _, at, _) in enumerate(records(self.path)):
            if i % self.most == 0:
                out.append(_Part(at - size, 0))
            out[-1].n += 1
        return out or [_Part(0, 0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        size = struct.calcsize(RECORD)
        with open(self.path, "rb") as f:
            f.seek(part.at)
            for _ in range(part.n):
                z, x, y, n = struct.unpack(RECORD, f.read(size))
                yield z, x, y, f.read(n)


class TileStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilestream"

    def schema(self) -> str:
        return "z int, x long, y long, data binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
