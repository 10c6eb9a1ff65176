import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tilewright.operators import tileset
from tilewright.sources import mbtiles, pmtiles, register, tilestream

FLAT = [(8, x, x + 15, bytes([1, x, x + 15])) for x in range(1, 13)]
META = {"format": "pbf", "name": "flat fixture"}


def tiles(spark, rows):
    return spark.createDataFrame(rows, "z int, x long, y long, data binary")


def test_mbtiles(spark, tmp_path):
    register(spark)
    a, b, c = (str(tmp_path / n) for n in ("a", "b", "c"))
    mbtiles.write(a, FLAT, META)
    mbtiles.write(b, FLAT, META, normalized=True)
    mbtiles.write(c, [*FLAT[:11], (8, 12, 27, FLAT[0][3])], META, normalized=True)
    for path in (a, b):
        df = spark.read.format("mbtiles").load(path)
        assert sorted((r.z, r.x, r.y, bytes(r.data)) for r in df.collect()) == FLAT
        assert [bytes(r.data) for r in df.filter("z = 8 and x = 2 and y = 17").collect()] == [b"\x01\x02\x11"]
        assert df.filter("x = 200").count() == 0 and df.filter("x >= 3 and x <= 5 and y > 18").count() == 2
    assert mbtiles.cheapest_layout(b) == "flat" and mbtiles.cheapest_layout(c) == "normalized"
    assert mbtiles.metadata(a) == META
    assert spark.read.format("mbtiles").option("table", "images").load(c).count() == 11


def test_dedup_4097(spark):
    kinds = [b"water" * 512, b"land" * 512, b"transparent" * 256]
    df = tiles(spark, [(13, x, 1, kinds[x % 3]) for x in range(4097)])
    s = tileset.dedup_stats(df).first()
    assert (s.tiles, s.unique_tiles, s.reused_tiles) == (4097, 3, 4094)
    images, keyed = tileset.content_ids(df)
    assert sorted(r.tile_id for r in images.collect()) == ["0", "1", "2"]
    back = {r.x: bytes(r.data) for r in tileset.flat(keyed, images).collect()}
    assert all(back[x] == kinds[x % 3] for x in range(4097))


def test_ids_beyond_base_36(spark):
    df = tiles(spark, [(9, x, 0, bytes([x])) for x in range(50)])
    assert {r.x: r.tile_id for r in tileset.content_ids(df)[1].collect()} == {x: ("0123456789abcdefghijklmnopqrstuvwxyz"[x] if x < 36 else "1" + "0123456789abcdef"[x - 36]) for x in range(50)}


def test_digest_and_tree(spark):
    df = tiles(spark, FLAT[::-1])
    h = hashlib.sha256()
    for z, x, y, d in FLAT:
        h.update(struct.pack(">4Q", z, x, y, len(d)) + d)
    assert tileset.tile_digest(df.repartition(3)).first().sha256 == h.hexdigest()
    a = tileset.tree_digest(df).first().sha256
    assert a == tileset.tree_digest(df.repartition(3)).first().sha256
    assert a != tileset.tree_digest(tiles(spark, FLAT[1:])).first().sha256


def test_publish(spark, tmp_path):
    path = str(tmp_path / "set")
    df, meta = tiles(spark, FLAT), spark.createDataFrame(list(META.items()), "name string, value string")
    m = tileset.publish(df, meta, path, source="fixture")
    assert tileset.table_rows(m, "tiles") == 12 and tileset.table_rows(m, "none") == -1
    assert tileset.validate(spark, path) == []
    assert tileset.metadata_map(tileset.read_metadata(spark, path)) == META
    assert tileset.read_manifest(spark, path) == json.loads(json.dumps(m))
    with pytest.raises(FileExistsError):
        tileset.publish(df, meta, path)
    with pytest.raises(ValueError):
        tileset.publish(tiles(spark, [*FLAT, FLAT[0]]), meta, path, replace=True)
    assert tileset.validate(spark, path) == []
    tileset.publish(tiles(spark, FLAT[:3]), meta, path, replace=True)
    assert tileset.read_tiles(spark, path).count() == 3
    (tmp_path / "set" / "COMPLETE").unlink()
    with pytest.raises(ValueError):
        tileset.read_tiles(spark, path)


@pytest.mark.parametrize("internal", [pmtiles.NONE, pmtiles.GZIP])
def test_pmtiles(spark, tmp_path, internal):
    register(spark)
    p = str(tmp_path / "a.pmtiles")
    ocean = {(1, x, y): b"ocean" for x in (0, 1) for y in (0, 1)}
    pmtiles.write_archive(p, {(0, 0, 0): b"zero", **ocean}, {"name": "n", "vector_layers": []}, internal=internal)
    assert pmtiles.inspect(p) == {"tiles": 5, "bytes": 24, "largest": 5}
    rows = spark.read.format("pmtiles").load(p).orderBy("tile_id").collect()
    assert [(r.z, bytes(r.data)) for r in rows] == [(0, b"zero")] + [(1, b"ocean")] * 4
    assert {(r.x, r.y) for r in rows[1:]} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    m = pmtiles.metadata_rows(p)
    assert m["format"] == "pbf" and m["name"] == "n" and json.loads(m["json"]) == {"vector_layers": []}


def test_pmtiles_leaves_and_damage(spark, tmp_path):
    p = str(tmp_path / "a.pmtiles")
    pmtiles.write_archive(p, {(4, x, y): bytes([x, y]) for x in range(16) for y in range(16)}, leaf_entries=20)
    assert pmtiles.inspect(p)["tiles"] == 256
    raw = bytearray(open(p, "rb").read())
    for at, value in ((7, 2), (0, 0), (72, 9), (100, 30)):
        bad = bytearray(raw)
        bad[at] = value
        open(p, "wb").write(bytes(bad))
        with pytest.raises(pmtiles.ArchiveError):
            pmtiles.inspect(p)
    for broken in (b"", b"\x00", b"\x02\x01", b"\x01\x00\x01\x01\x00", b"\xff" * 12):
        with pytest.raises(pmtiles.ArchiveError):
            pmtiles.parse_directory(broken)


def test_tilestream(spark, tmp_path):
    register(spark)
    p = str(tmp_path / "s")
    tilestream.write(p, META, FLAT)
    assert tilestream.metadata(p) == META
    df = spark.read.format("tilestream").option("rowsPerPartition", 5).load(p)
    assert sorted((r.z, r.x, r.y, bytes(r.data)) for r in df.collect()) == FLAT
    s = tileset.stream_stats(df).first()
    assert (s.tiles, s.bytes, s.largest) == (12, 36, 3)
    open(p, "ab").write(b"\x01")
    with pytest.raises(ValueError):
        list(tilestream.records(p))


def test_batches(spark):
    c = F.lit
    one = spark.range(1)
    got = one.select(tileset.auto_batch(c(100), c(64 << 20)), tileset.auto_batch(c(100), c(1)), tileset.stream_batch(c(0), c(100), c(64 << 20)), tileset.stream_batch(c(7), c(100), c(64 << 20)), tileset.stream_batch(c(0), c(100), c(0))).first()
    assert list(got) == [(62 << 20) // (16384 + 768), 1000, 8192, 7, 1]
