"""Reader and writer of MBTiles (SQLite) as a Python data source.

``spark.read.format("mbtiles").load(path)`` gives (z, x, y, data) of a flat or
normalized file; option ``layout`` forces one (auto, flat, normalized), option
``table`` reads ``tiles``, ``metadata``, ``map`` or ``images``.  Partitions are
ranges of row numbers; comparisons of z, x and y are pushed down.  A folder of
such files is read as one set: SQLite has no writers side by side, so executors
write a file each (``write_set``), all with the set's metadata.
"""

from __future__ import annotations

import itertools
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from tilewright.sources.parts import staged

COLUMNS = {"z": "zoom_level", "x": "tile_column", "y": "tile_row"}
ROWS_PER_PARTITION = 50_000
SCHEMAS = {
    "tiles": "z int, x long, y long, data binary",
    "map": "z int, x long, y long, tile_id string",
    "images": "tile_id string, data binary",
    "metadata": "name string, value string",
}


def _open(path: str) -> sqlite3.Connection:
    path = path.removeprefix("file://").removeprefix("file:")
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def files(path: str) -> list[str]:
    """The files of a set: those of a folder by name, or the file itself."""
    path = path.removeprefix("file://").removeprefix("file:")
    if not os.path.isdir(path):
        return [path]
    return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".mbtiles"))


def layout(path: str) -> str:
    """``normalized`` where the file has map and images, ``flat`` where it has a
    tiles table; an error otherwise, or where a set's files differ."""
    kinds = {_layout(f) for f in files(path)}
    if len(kinds) != 1:
        raise ValueError(f"{path} holds files of {len(kinds)} layouts")
    return kinds.pop()


def _layout(path: str) -> str:
    with _open(path) as db:
        names = {n for (n,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    if {"map", "images"} <= names:
        return "normalized"
    if "tiles" in names:
        return "flat"
    raise ValueError(f"{path} holds neither tiles nor map and images")


def cheapest_layout(path: str) -> str:
    """``flat`` unless a normalized file uses a payload more than once."""
    if layout(path) == "flat":
        return "flat"
    with _open(*files(path)) as db:  # of one file: ids of a set's files are their own
        n, unique = db.execute("SELECT count(*), count(DISTINCT tile_id) FROM map").fetchone()
    return "flat" if n == unique else "normalized"


def metadata(path: str) -> dict[str, str]:
    """The metadata table; a null is an error."""
    with _open(files(path)[0]) as db:
        rows = db.execute("SELECT name, value FROM metadata ORDER BY name").fetchall()
    if any(v is None for _, v in rows):
        raise ValueError("metadata holds a null value")
    return dict(rows)


def write(path: str, tiles: Iterable[tuple[int, int, int, bytes]], meta: dict[str, str], normalized: bool = False) -> None:
    """A small file, for tests and exports of subsets."""
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", meta.items())
        if not normalized:
            db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
            db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", tiles)
            return
        db.execute("CREATE TABLE map (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_id TEXT)")
        db.execute("CREATE TABLE images (tile_id TEXT PRIMARY KEY, tile_data BLOB)")
        known: dict[bytes, str] = {}
        for z, x, y, data in tiles:
            if data not in known:
                known[data] = f"id-{len(known)}"
                db.execute("INSERT INTO images VALUES (?, ?)", (known[data], data))
            db.execute("INSERT INTO map VALUES (?, ?, ?, ?)", (z, x, y, known[data]))


def write_set(tiles: DataFrame, folder: str, meta: dict[str, str], normalized: bool = False) -> None:
    """A set of any size in a folder: each task writes its tiles (z, x, y, data)
    to a file of its own; a normalized one holds a payload once a file."""

    def fill(batches: Iterator, part: str) -> bytes:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for z, x, y, data in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                    yield z, x, y, data.as_py()

        rows_ = rows()
        first = next(rows_, None)
        if first is None:
            return b""
        with tempfile.TemporaryDirectory() as own:  # SQLite wants a local disk
            path = os.path.join(own, "t.mbtiles")
            write(path, itertools.chain([first], rows_), meta, normalized)
            shutil.copyfile(path, part)
        return b"some"

    os.makedirs(folder)
    parts = [p for _, p, _, note in staged(tiles.select("z", "x", "y", "data"), f"{folder}.parts", fill) if note]
    for i, p in enumerate(parts):
        os.rename(p, os.path.join(folder, f"{i:06d}.mbtiles"))
    if not parts:
        write(os.path.join(folder, "000000.mbtiles"), [], meta, normalized)
    shutil.rmtree(f"{folder}.parts", ignore_errors=True)


@dataclass
class _Part(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class _Reader(DataSourceReader):
    path: str
    table: str
    layout: str
    where: list[tuple[str, str, int]] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "=", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if self.table in ("tiles", "map") and type(f) in kinds and column in COLUMNS and isinstance(f.value, int):
                self.where.append((COLUMNS[column], kinds[type(f)], f.value))
            else:
                yield f

    def _base(self) -> str:
        if self.table == "tiles":
            return "map" if self.layout == "normalized" else "tiles"
        return self.table

    def partitions(self) -> list[_Part]:
        out = []
        for path in files(self.path)[: 1 if self.table == "metadata" else None]:
            with _open(path) as db:
                low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self._base()}").fetchone()
            out += [_Part(path, i, min(i + ROWS_PER_PARTITION - 1, high)) for i in range(low, high + 1, ROWS_PER_PARTITION)]
        return out or [_Part(files(self.path)[0], 0, -1)]

    def read(self, part: _Part) -> Iterator[tuple]:
        base = self._base()
        columns = {"metadata": "name, value", "images": "tile_id, tile_data", "map": "zoom_level, tile_column, tile_row, tile_id"}
        sql, dangling = f"SELECT {columns.get(self.table, 'zoom_level, tile_column, tile_row, tile_data')} FROM {base}", False
        if self.table == "tiles" and base == "map":
            sql, dangling = "SELECT zoom_level, tile_column, tile_row, tile_data FROM map LEFT JOIN images USING (tile_id)", True
        sql += f" WHERE {base}.rowid BETWEEN ? AND ?" + "".join(f" AND {c} {op} ?" for c, op, _ in self.where)
        with _open(part.path) as db:
            for row in db.execute(sql, (part.first, part.last, *(v for _, _, v in self.where))):
                if dangling and row[3] is None:
                    raise ValueError(f"tile {row[:3]} has no payload")
                yield row


class MBTilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "tiles")]

    def reader(self, schema) -> _Reader:
        wanted = self.options.get("layout", "auto").lower()
        if wanted not in ("auto", "flat", "normalized"):
            raise ValueError("layout must be auto, flat or normalized")
        path = self.options["path"]
        return _Reader(path, self.options.get("table", "tiles"), layout(path) if wanted == "auto" else wanted)
