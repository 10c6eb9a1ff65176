"""Versions behind a pointer, tiles and verbs of published sets, progress of a synchronisation."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import documents as D
from tilewright.functions import kernels as K
from tilewright.operators import sync, tileset, versions
from tilewright.operators import territory as R
from tilewright.operators.store import Manifest, TileStore
from tilewright.sources import pmtiles

TILES, META = "z int, x long, y long, data binary", "name string, value string"


def tiles(spark, n, data=b"x"):
    return spark.createDataFrame([(3, i % 8, i // 8, data + bytes([i])) for i in range(n)], TILES)


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([("format", "pbf")], META)


def test_swap(spark, meta, tmp_path):
    root = str(tmp_path / "set")
    with pytest.raises(ValueError):
        versions.current_tiles(spark, root)
    first, before = versions.publish_version(tiles(spark, 5), meta, root)
    assert before is None and versions.current(spark, root) == first
    reader = versions.current_tiles(spark, root)
    second, before = versions.publish_version(tiles(spark, 9), meta, root)
    assert before == first and versions.current_tiles(spark, root).count() == 9
    assert reader.count() == 5  # who began before the swap ends with the old version
    with pytest.raises(ValueError):
        versions.swap(spark, root, "none")
    assert versions.current(spark, root) == second
    assert versions.swap(spark, root, first) == second and versions.swap(spark, root, second) == first
    assert versions.retire(spark, root) == 1 and os.listdir(f"{root}/versions") == [second]
    assert [x for x in os.listdir(root) if x.endswith(".tmp")] == []


def test_replace_keeps_what_stands(spark, meta, tmp_path):
    path = str(tmp_path / "set")
    tileset.publish(tiles(spark, 4), meta, path)
    with pytest.raises(FileExistsError):
        tileset.publish(tiles(spark, 5), meta, path)
    twice = tiles(spark, 4).unionByName(tiles(spark, 4))
    with pytest.raises(ValueError):
        tileset.publish(twice, meta, path, replace=True)
    assert tileset.validate(spark, path) == [] and tileset.read_tiles(spark, path).count() == 4
    m = tileset.publish(tiles(spark, 6), meta, path, replace=True, provenance={"mode": "test"})
    assert tileset.read_manifest(spark, path) == m and m["provenance"] == {"mode": "test"}
    assert m["tile_digest_sha256"] and m["tile_tree_sha256"] == tileset.set_digest(tiles(spark, 6))
    assert os.listdir(tmp_path) == ["set"]


def test_verbs(spark, meta, tmp_path):
    path, out = str(tmp_path / "set"), str(tmp_path / "t.mvt")
    tileset.publish(tiles(spark, 4), meta, path)
    assert tileset.run_verb(spark, "tile", path, "3", "2", "0", out) == (tileset.DONE, b"x\x02")
    with open(out, "rb") as f:
        assert f.read() == b"x\x02"
    assert tileset.run_verb(spark, "tile", path, "3", "7", "7") == (tileset.ABSENT, None)
    assert tileset.run_verb(spark, "tile", path, "3", "a", "7")[0] == tileset.MISUSED
    assert tileset.run_verb(spark, "tile", path)[0] == tileset.MISUSED and tileset.run_verb(spark, "none")[0] == tileset.MISUSED
    code, manifest = tileset.run_verb(spark, "validate", path)
    assert code == tileset.DONE and tileset.run_verb(spark, "inspect", path) == (tileset.DONE, manifest)
    extra = tiles(spark, 1, b"y").drop("z")
    extra.write.mode("append").parquet(f"{path}/tiles/z=3")
    assert tileset.run_verb(spark, "validate", path)[0] == tileset.REFUSED and tileset.run_verb(spark, "inspect", path)[0] == tileset.REFUSED
    assert tileset.run_verb(spark, "validate", str(tmp_path / "none"))[0] == tileset.REFUSED


def test_progress(spark, tmp_path):
    s, seen = TileStore(spark, str(tmp_path / "store")), []
    keys = spark.createDataFrame([(5, i, 1) for i in range(6)], "z int, x long, y long")
    none = spark.createDataFrame([], "z int, x_min long, x_max long, y_min long, y_max long")
    s.synchronise(Manifest("d", "r", "/{z}/{x}/{y}"), keys, none, lambda z, x, y: b"t", progress=seen.append)
    assert [seen[0].phase, seen[-1].phase] == ["manifest", "published"]
    assert (seen[-1].total, seen[-1].downloaded, seen[-1].completed) == (6, 6, 6)
    assert all(a.completed <= b.completed for a, b in zip(seen, seen[1:]))
    seen.clear()
    s.synchronise(Manifest("d", "r", "/{z}/{x}/{y}"), keys, none, lambda z, x, y: b"t", progress=seen.append)
    assert (seen[-1].reused, seen[-1].downloaded) == (6, 0)
    with pytest.raises(ValueError, match="range"):
        s.synchronise(Manifest("d", "r", "/{z}/{x}/{y}"), keys, spark.createDataFrame([(2, 3, 1, 0, 0)], none.schema), lambda z, x, y: b"t")


def test_tile_stored_twice(spark, tmp_path):
    s = TileStore(spark, str(tmp_path / "store"))
    row = spark.createDataFrame([(5, 1, 1, b"t")], TILES).select(F.lit("d").alias("dataset"), F.lit("r").alias("revision"), "*", F.sha2("data", 256).alias("checksum"))
    s.put(row)
    s.put(row)
    assert s.tiles("d", "r").count() == 1
    keys = row.select("z", "x", "y")
    got = sync.result(sync.plan(keys, s._rows("d", "r"), "d", "r")).first()
    assert (got.total, got.reused) == (1, 1)


def test_rings_over_an_index():
    def slow(ways):
        rest, rings = [list(w) for w in ways if len(w) >= 2], []
        while rest:
            ring = rest.pop(0)
            while ring[0] != ring[-1] and (fit := [i for i, w in enumerate(rest) if ring[-1] in (w[0], w[-1])]):
                way = rest.pop(fit[0])
                ring = ring + (way[1:] if way[0] == ring[-1] else way[-2::-1])
            if ring[0] == ring[-1] and len(ring) >= 4:
                rings.append(ring)
        return rings

    r = random.Random(6)
    for _ in range(300):
        ways = [[r.randrange(9) for _ in range(r.randint(1, 4))] for _ in range(r.randint(0, 14))]
        assert K.join_ways(ways) == slow(ways)
    n = 20_000
    assert len(K.join_ways([[i, i + 1] for i in range(n)] + [[n, 0]])) == 1


def test_directory_with_bytes_left():
    entries = [(1, 0, 5, 1), (7, 5, 6, 2)]
    raw = pmtiles.build_directory(entries)
    assert pmtiles.parse_directory(raw + b"\x01\x02") == pmtiles.parse_directory(raw) == entries
    with pytest.raises(pmtiles.ArchiveError):
        pmtiles.parse_directory(raw[:-1])


def test_style_and_report(spark):
    meta = {"format": "pbf", "json": '{"vector_layers": [{"id": "water"}, {"id": "unknown"}, {"id": "transportation"}]}'}
    vector = D.style(meta, "/t/{z}/{x}/{y}.mvt")
    assert vector["version"] == 8 and {x.get("source-layer") for x in vector["layers"]} <= {None, "water", "transportation"}
    assert any(x.get("source-layer") == "water" for x in vector["layers"])
    raster = D.style({"format": "png"}, "/t/{z}/{x}/{y}.png", vector=False)
    assert [x["type"] for x in raster["layers"]] == ["background", "raster"]
    t = spark.createDataFrame([("a", 1, ["x"])], "territory_id string, n int, source_values array<string>")
    assert R.for_report(t).columns == ["territory_id", "n"] and R.REPORT_SIMPLIFY_METRES == 50.0
