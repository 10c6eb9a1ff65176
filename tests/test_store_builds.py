import hashlib
import json

import pytest

from tilewright.operators import builds, routes, tileset
from tilewright.operators import territory as R
from tilewright.operators.store import Manifest, TileStore
from tilewright.sources import http, mbtiles, osmpbf, pmtiles

KEYS, RANGES = "z int, x long, y long", "z int, x_min long, x_max long, y_min long, y_max long"


def test_synchronise(spark, tmp_path):
    s = TileStore(spark, str(tmp_path / "store"))
    keys = spark.createDataFrame([(5, 20, 1)], KEYS)
    ranges = spark.createDataFrame([(5, 0, 2, 0, 1)], RANGES)
    none = spark.createDataFrame([], KEYS)
    r1, r2 = (Manifest("berlin", r, "/{z}/{x}/{y}") for r in ("r1", "r2"))

    def failing(z, x, y):
        raise OSError("down")

    with pytest.raises(Exception):
        s.synchronise(r1, keys, ranges, failing)
    assert s.manifest("berlin") is None
    got = s.synchronise(r1, keys, ranges, lambda z, x, y: bytes([z, x, y]))
    assert (got.total, got.reused, got.downloaded, got.changed) == (7, 0, 7, True)
    got = s.synchronise(r1, keys, ranges, failing)
    assert (got.reused, got.downloaded, got.changed) == (7, 0, False)
    with pytest.raises(Exception):
        s.synchronise(r2, keys, ranges, failing)
    assert s.manifest("berlin").revision == "r1"
    got = s.synchronise(r2, none, ranges, lambda z, x, y: b"2", prune=True)
    assert got.pruned and len(s.revisions("berlin")) == 1 and s.manifest("berlin") == r2
    with pytest.raises(ValueError, match="key in range"):
        s.synchronise(r2, spark.createDataFrame([(5, 1, 1)], KEYS), ranges, failing)
    with pytest.raises(ValueError, match="overlap"):
        s.synchronise(r2, none, spark.createDataFrame([(5, 0, 2, 0, 1), (5, 2, 3, 1, 1)], RANGES), failing)
    with pytest.raises(ValueError, match="dataset"):
        s.synchronise(Manifest(" x", "r", "/{z}/{x}/{y}"), none, ranges, failing)


def test_corrupt_tile(spark, tmp_path):
    s = TileStore(spark, str(tmp_path / "store"))
    keys, no = spark.createDataFrame([(5, 20, 1)], KEYS), spark.createDataFrame([], RANGES)
    s.put(spark.createDataFrame([("d", "r", 5, 20, 1, b"x", "00")], "dataset string, revision string, z int, x long, y long, data binary, checksum string"))
    with pytest.raises(ValueError, match="checksum"):
        s.synchronise(Manifest("d", "r", "/{z}/{x}/{y}"), keys, no, lambda z, x, y: b"x")


def test_http():
    def opener(url, headers):
        if url.endswith("manifest.json"):
            return (304, {}, b"") if headers.get("If-None-Match") == '"r"' else (200, {}, json.dumps({"revision": "r"}).encode())
        return 200, {"X-Checksum-SHA256": hashlib.sha256(b"t").hexdigest()}, b"t" if "/1/" in url else b"bad"

    f = http.TileFetcher("https://h/a/", "t/{revision}/{z}/{x}/{y}.mvt", "r {z}", opener)
    assert f.url(3, 1, 2) == "https://h/a/t/r%20%7Bz%7D/3/1/2.mvt" and f(3, 1, 2) == b"t"
    with pytest.raises(OSError, match="checksum"):
        f(3, 4, 2)
    assert http.fetch_manifest("https://h/manifest.json", "", opener) == {"revision": "r"}
    assert http.fetch_manifest("https://h/manifest.json", "r", opener) is None


def test_imports(spark, tmp_path):
    p, m = str(tmp_path / "a.bin"), str(tmp_path / "b.bin")
    pmtiles.write_archive(p, {(0, 0, 0): b"zero", (1, 0, 1): b"one"}, {"name": "n"})
    mbtiles.write(m, [(1, 0, 0, b"one"), (0, 0, 0, b"zero")], {"name": "n"})
    a = builds.import_archive(spark, p, str(tmp_path / "pa"))
    b = builds.import_archive(spark, m, str(tmp_path / "mb"))
    assert a["tile_digest_sha256"] == b["tile_digest_sha256"]
    meta = tileset.metadata_map(tileset.read_metadata(spark, str(tmp_path / "pa")))
    assert meta["source:files"] == "a.bin" and str(tmp_path) not in json.dumps(meta)
    assert builds.size_ratio(spark, p, str(tmp_path / "pa"))["source_bytes"] > 0
    with pytest.raises(ValueError):
        builds.import_archive(spark, p, str(tmp_path))
    with pytest.raises(ValueError):
        builds.checked_inputs([" "], "x")


def test_build(spark, tmp_path):
    square = [(1, 10.0, 50.0), (2, 10.1, 50.0), (3, 10.1, 50.1), (4, 10.0, 50.1)]
    osmpbf.write(tmp_path / "p.pbf", square, [(100, [1, 2, 3, 4, 1], {"highway": "primary"})], [(500, {"boundary": "postal_code", "ref": "777"}, [(1, 100, "outer")])])
    out = str(tmp_path / "out")
    m = builds.build_pbf(spark, [str(tmp_path / "p.pbf")], out, preset="fast", postal_codes=True, sidecar=str(tmp_path / "s.geojson"))
    assert m["tables"][0]["rows"] > 0 and tileset.validate(spark, out) == []
    doc = json.loads((tmp_path / "s.geojson").read_text())
    assert [f["properties"]["postcode"] for f in doc["features"]] == ["777"]
    osmpbf.write(tmp_path / "q.pbf", square, [(100, [1, 2], {})])
    with pytest.raises(ValueError, match="drawn"):
        builds.build_pbf(spark, [str(tmp_path / "q.pbf")], out)


def test_options(spark):
    assert R.parse_aggregations("a=first, b=sum") == {"a": "first", "b": "sum"}
    assert R.parse_group("prefix:2", False) == ("prefix", 2) and R.parse_group("team", True) == ("mapping", "team")
    for call in (lambda: R.parse_aggregations("a=best"), lambda: R.parse_group("prefix:2", True), lambda: R.parse_group("prefix:0", False), lambda: R.parse_group("team", False)):
        with pytest.raises(ValueError):
            call()


def test_routes(spark):
    schema = "route_id long, pos int, longitude double, latitude double"
    p = spark.createDataFrame([(1, 0, -135.0, 0.0), (1, 1, 45.0, 0.0), (2, 0, 170.0, 0.0), (2, 1, -170.0, 0.0)], schema)
    keys = [(r.x, r.y) for r in routes.route_tiles(p.filter("route_id = 1"), 2).orderBy("pos").collect()]
    assert keys == [(0, 1), (1, 1), (2, 1)]
    assert [(r.x, r.y) for r in routes.route_tiles(p.filter("route_id = 2"), 3).orderBy("pos").collect()] == [(7, 3), (0, 3)]
    cut = routes.route_tiles(p.filter("route_id = 1"), 2, most=2).collect()
    assert len(cut) == 2 and all(r.truncated for r in cut)
    with pytest.raises(Exception):
        routes.route_tiles(spark.createDataFrame([(1, 0, 0.0, 91.0)], schema), 2).collect()
    for bad in ({"zoom": -1}, {"zoom": 2, "radius": 9}, {"zoom": 2, "most": -1}):
        with pytest.raises(ValueError):
            routes.route_tiles(p, **bad)
    assert routes.sync_request(p, 3, 1).count() == routes.sync_request(p, 3, 1).distinct().count()
