import gzip

import pytest

from tilewright.operators import osm
from tilewright.sources import osmpbf, register

#: Fixed values of a build whose counts are known: 14 roads over all zooms, 71 tiles.
NODES = [(1, 11.50, 48.10), (2, 11.51, 48.10), (3, 11.55, 48.14), (4, 11.60, 48.14), (5, 11.50, 48.20), (6, 11.52, 48.20), (7, 11.52, 48.22), (8, 11.50, 48.22)]
WAYS = [(1, [1, 2], {"highway": "motorway"}), (2, [3, 4], {"highway": "residential"}), (3, [5, 6, 7, 8, 5], {"building": "yes"}), (4, [2, 4, 6, 8, 2], {"natural": "water"})]
SQUARE = [(1, 10.0, 50.0), (2, 10.1, 50.0), (3, 10.1, 50.1), (4, 10.0, 50.1)]


def load(spark, paths):
    register(spark)
    read = lambda e: spark.read.format("osmpbf").option("entity", e).load(",".join(map(str, paths)))
    return read("nodes"), read("ways"), read("relations")


@pytest.mark.parametrize("dense", [True, False])
def test_read(spark, tmp_path, dense):
    osmpbf.write(tmp_path / "a.pbf", NODES, WAYS, [(9, {"boundary": "postal_code"}, [(1, 2, "outer"), (0, 1, "")])], dense=dense, compress=dense)
    n, w, r = load(spark, [tmp_path / "a.pbf"])
    assert {x.id: (x.lon, x.lat) for x in n.collect()} == {i: (x, y) for i, x, y in NODES}
    assert [(x.id, x.node_ids, x.tags) for x in w.orderBy("id").collect()] == WAYS
    assert [(m.type, m.ref, m.role) for m in r.first().members] == [(1, 2, "outer"), (0, 1, "")]


def test_damaged(tmp_path):
    osmpbf.write(tmp_path / "a.pbf", NODES, WAYS)
    raw = (tmp_path / "a.pbf").read_bytes()
    (tmp_path / "b.pbf").write_bytes(raw[:-5])
    with pytest.raises(osmpbf.PbfError):
        osmpbf.blobs(str(tmp_path / "b.pbf"))
    with pytest.raises(osmpbf.PbfError):
        osmpbf.unpacked(b"\x22\x01x")
    assert osmpbf.packed(b"\x80") == []


def build(spark, paths, **more):
    n, w, r = load(spark, paths)
    return osm.build_osm(n, w, **more), (n, w, r)


def test_whole_build_one_file_and_two(spark, tmp_path):
    osmpbf.write(tmp_path / "a.pbf", NODES, WAYS)
    (tiles, feats), (n, w, _) = build(spark, [tmp_path / "a.pbf"])
    rows = {(t.z, t.x, t.y): gzip.decompress(bytes(t.data)) for t in tiles.collect()}
    assert len(rows) == 71
    assert osm.road_counts(feats, 5, 14).groupBy().sum("roads").first()[0] == 14
    box = osm.bounds(n, osm.renderable(w)).first()
    meta = osm.stream_metadata("x", (box.min_lon, box.min_lat, box.max_lon, box.max_lat), 5, 14)
    assert meta["bounds"] == "11.500000,48.100000,11.600000,48.220000"
    osmpbf.write(tmp_path / "b.pbf", NODES, WAYS[:2])
    osmpbf.write(tmp_path / "c.pbf", NODES, WAYS[2:])
    (again, _), _ = build(spark, [tmp_path / "b.pbf", tmp_path / "c.pbf"])
    assert {(t.z, t.x, t.y): gzip.decompress(bytes(t.data)) for t in again.collect()} == rows


def test_classes(spark):
    tags = [{"highway": "trunk_link"}, {"highway": "construction"}, {"building": "no"}, {"building": " yes "}, {"natural": "wood"}, {"waterway": "riverbank"}, {"landuse": "vineyard"}, {"highway": "track", "building": "yes"}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "id long, tags map<string,string>")
    got = {r.id: (r.c.layer, r.c["class"], r.c.min_zoom) for r in osm.renderable(df).collect()}
    assert got == {0: ("transportation", "trunk", 6), 3: ("building", "building", 14), 4: ("landcover", "forest", 9), 5: ("water", "water", 8), 6: ("landcover", "farmland", 10), 7: ("transportation", "service", 13)}


def test_postal(spark, tmp_path):
    rel = [(500, {"boundary": "postal_code", "postal_code": "12345"}, [(1, 100, "outer")]), (501, {"boundary": "other", "ref": "1"}, [(1, 100, "outer")])]
    osmpbf.write(tmp_path / "p.pbf", SQUARE, [(100, [1, 2, 3, 4, 1], {"highway": "path"})], rel)
    n, w, r = load(spark, [tmp_path / "p.pbf"])
    f = osm.postal_features(r, w, n).collect()
    assert len(f) == 1 and f[0].props == {"postcode": "12345"} and [len(x.points) for x in f[0].rings] == [5]
    tiles, _ = osm.build_osm(n, w, r, 5, 8)
    data = gzip.decompress(bytes(tiles.filter("z = 8").first().data))
    assert b"postal_code" in data and b"12345" in data
    plain, _ = osm.build_osm(n, w, None, 5, 14)
    assert not any(b"postal_code" in gzip.decompress(bytes(t.data)) for t in plain.collect())


def test_options():
    assert osm.preset() == (5, 14, 4.0, False) and osm.preset("detailed")[1] == 16
    with pytest.raises(ValueError):
        osm.preset("none")
    for bad in ({"bbox": (0, 1, 2, 3)}, {"centre": (1, 2)}, {"bbox": (1, 1, 2, 3), "radius_km": 3}):
        with pytest.raises(ValueError):
            osm.in_area(None, **bad)
