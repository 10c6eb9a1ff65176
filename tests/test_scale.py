"""Work that must not grow faster than its input, and results far from the origin."""

import hashlib
import random
import struct
import time

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilewright.functions import digests
from tilewright.functions import geometry as G
from tilewright.operators import routes, spatial, tileset
from tilewright.sources import mbtiles, pmtiles, register


def square(x, y, w=1.0):
    at = lambda dx, dy: F.struct((x + dx).cast("double").alias("lon"), (y + dy).cast("double").alias("lat"))
    return F.array(at(0, 0), at(w, 0), at(w, w), at(0, w), at(0, 0))


def test_area_far_from_the_origin(spark):
    y = F.col("id") + 20_000
    own = G.area_km2(F.array(F.array(square(F.lit(39), y))))
    wide = F.cos((5 * y + 2) / F.lit(5.0) * F.pi() / 180) * G.KM_PER_DEGREE * G.KM_PER_DEGREE
    assert spark.range(2000).filter(F.round(own, 4) != F.round(wide, 4)).count() == 0


def test_holes_at_one_place_in_equal_exteriors(spark):
    n = 20_000
    ext = spark.range(n).select((F.col("id") + 5).alias("exterior_id"), square(F.lit(0), F.lit(0)).alias("ring"))
    wide = spark.range(1).select(F.lit(1).cast("long").alias("exterior_id"), square(F.lit(-1), F.lit(-1), 3.0).alias("ring"))
    holes = spark.range(n).select(F.col("id").alias("hole_id"), square(F.lit(0.5), F.lit(0.5), 0.1).alias("ring"))
    start = time.time()
    got = spatial.nest_holes(ext.union(wide), holes, 1.0).groupBy("exterior_id").count().collect()
    assert [tuple(r) for r in got] == [(5, n)] and time.time() - start < 60


def test_equal_boxes_are_compared_once(spark):
    n = 100_000
    at = (F.col("id") % 2).cast("double")
    empty = spark.range(2 * n).select("id", at.alias("min_x"), at.alias("max_x"), at.alias("min_y"), at.alias("max_y"))
    start = time.time()
    assert spatial.overlapping_pairs(empty, 4.0).count() == 0 and time.time() - start < 60
    box = spark.createDataFrame([(3, 0.0, 1.0), (1, 0.0, 1.0), (2, 0.5, 2.0), (4, 1.0, 1.0)], "id long, low double, high double")
    box = box.select("id", *(F.col(c).alias(f"{n}_{a}") for a in "xy" for n, c in (("min", "low"), ("max", "high"))))
    assert sorted(map(tuple, spatial.overlapping_pairs(box, 4.0).collect())) == [(1, 2), (1, 3), (2, 3), (2, 4)]
    assert len(spatial.overlapping_pairs(box, 4.0, touching=True).collect()) == 6


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pmtiles_read", "pmtiles_inspect", "pmtiles_metadata", "import_published", "mbtiles_flat_read", "mbtiles_normalized_read", "mbtiles_pushdown", "mbtiles_metadata", "tilestream_read", "osmpbf_nodes", "osmpbf_ways", "osmpbf_relations", "geojson_read"])
def test_no_rows_through_the_driver(spark, monkeypatch, name):
    def refused(*_, **__):
        raise AssertionError("rows are sent to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", refused)
    assert entry.queries()[name](spark, SF).count() > 0


def test_archive_by_executors(spark, tmp_path):
    p = str(tmp_path / "a.pmtiles")
    n = 20_000
    tiles = spark.range(n).select((F.col("id") * F.col("id") + 4**9).alias("number"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).cast("binary").alias("data"))
    pmtiles.write_tiles(tiles, p, {"name": "n"}, leaf_entries=4)
    assert pmtiles.inspect(p) == {"tiles": n, "bytes": 2 * n, "largest": 2} and pmtiles.metadata_rows(p)["name"] == "n"
    register(spark)
    got = spark.read.format("pmtiles").load(p).select(F.col("tile_id").alias("number"), "data")
    assert got.exceptAll(tiles).isEmpty() and tiles.exceptAll(got).isEmpty()
    with pytest.raises(Exception, match="stands twice"):
        pmtiles.write_tiles(tiles.union(tiles), str(tmp_path / "b.pmtiles"))


def test_set_of_files(spark, tmp_path):
    rows = spark.range(0, 100, 1, 5).select(F.lit(9).alias("z"), F.col("id").alias("x"), F.col("id").alias("y"), F.lit(b"same").alias("data"))
    register(spark)
    for normalized in (True, False):
        p = str(tmp_path / f"s{normalized}")
        mbtiles.write_set(rows, p, {"a": "b"}, normalized)
        assert len(mbtiles.files(p)) == 5 and mbtiles.metadata(p) == {"a": "b"}
        assert mbtiles.layout(p) == ("normalized" if normalized else "flat")
        assert spark.read.format("mbtiles").load(p).exceptAll(rows).isEmpty()
        assert spark.read.format("mbtiles").load(p).count() == 100
        assert spark.read.format("mbtiles").option("table", "metadata").load(p).count() == 1
    mbtiles.write_set(rows.limit(0), str(tmp_path / "none"), {"a": "b"})
    assert spark.read.format("mbtiles").load(str(tmp_path / "none")).count() == 0


def test_routes_are_streamed(spark, monkeypatch):
    """A route's points reach Python one after another, not as one row's array."""
    points = spark.range(30_000).select((F.col("id") % 2).alias("route_id"), F.col("id").alias("pos"), ((F.col("id") * 7919) % 360 - 180).cast("double").alias("longitude"), ((F.col("id") * 31) % 170 - 85).cast("double").alias("latitude"))
    df = routes.route_tiles(points, 5, 1, 40)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = df.groupBy("route_id").agg(F.count("*"), F.max("pos"), F.min("truncated")).collect()
    assert sorted(map(tuple, got)) == [(0, 40, 39, True), (1, 40, 39, True)]


def test_tiles_and_areas_are_streamed(spark):
    for name, word in (("mvt_encode", "collect_list(struct(ord"), ("postal_areas", "FlatMapGroupsInPandas")):
        assert word not in entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    text = entry.queries()["postal_areas"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text


def test_digest_part_by_part(spark, monkeypatch):
    r = random.Random(5)
    rows = [(z, x, y, r.randbytes(r.choice([0, 3, 64, 200, 1500]))) for z in (2, 9) for x in range(12) for y in range(4 if z == 2 else 12)]
    rows[7] = (*rows[7][:3], r.randbytes(9000))  # larger than a part
    h = hashlib.sha256()
    for z, x, y, data in rows:
        h.update(struct.pack(">4Q", z, x, y, len(data)) + data)
    tiles = spark.createDataFrame(r.sample(rows, len(rows)), "z int, x long, y long, data binary").repartition(3)
    assert tuple(tileset.tile_digest(tiles).first()) == (len(rows), h.hexdigest())
    counts, plain = [], tileset._hashed

    def seen(part, *args, **options):
        counts.append(part.agg(F.count("*"), F.sum(F.octet_length("data") + 32), F.max(F.octet_length("data") + 32)).first())
        return plain(part, *args, **options)

    monkeypatch.setattr(tileset, "_hashed", seen)
    monkeypatch.setattr(tileset, "PART_BYTES", 4096)
    assert tuple(tileset.tile_digest(tiles).first()) == (len(rows), h.hexdigest())
    assert sum(n for n, _, _ in counts) == len(rows) and all(size - largest <= 4096 for _, size, largest in counts)
    monkeypatch.setattr(tileset, "_chained", lambda _: None)  # no worker can take up a hash
    assert tuple(tileset.tile_digest(tiles).first()) == (len(rows), h.hexdigest())


def test_hash_taken_up():
    assert digests.resumable()
    r = random.Random(3)
    for cuts in ([], [0], [1, 55, 56, 63, 64, 65], [64, 128, 1000]):
        data, h, at = r.randbytes(1200), digests.Sha256(), 0
        for cut in [*cuts, 1200]:
            h = digests.Sha256(h.state())
            h.update(data[at:cut])
            at = cut
            assert h.hexdigest() == hashlib.sha256(data[:cut]).hexdigest()
