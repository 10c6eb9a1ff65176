import json

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import places, spatial, sync
from tilewright.operators import territory as R
from tilewright.sources import geojson

BOXES = {"84130": (0, 0, 1, 1), "84131": (1, 0, 2, 1), "84140": (0, 2, 1, 3), "84230": (5, 5, 6, 6), "84307": (10, 10, 11, 11), "84323": (11, 10, 12, 11), "84399": (50, 50, 51, 51), "94405": (20, 20, 21, 21)}


def ring(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def feature(code, *rings):
    return {"type": "Feature", "properties": {"postcode": code}, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in r] for r in rings]}}


@pytest.fixture(scope="module")
def nine(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("g") / "nine.geojson"
    fs = [feature(k, ring(*b)) for k, b in BOXES.items()] + [feature("77000", ring(30, 30, 34, 34), ring(31, 31, 33, 33)[::-1])]
    p.write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    return geojson.read_features(spark, str(p)).cache()


def test_prefixes(nine):
    assert nine.count() == 9
    for n, groups in ((1, ["7", "8", "9"]), (2, ["77", "84", "94"]), (3, ["770", "841", "842", "843", "944"])):
        t = {r.territory_id: r for r in R.build(R.by_prefix(nine, "postcode", n), simplify_metres=1.0).collect()}
        assert sorted(t) == groups
    assert t["841"].source_feature_count == 3 and len(t["841"].geometry) == 2 and len(t["843"].geometry) == 2
    assert t["841"].source_values == ["84130", "84131", "84140"]
    merged = max(t["841"].geometry, key=lambda p: max(q.lon for q in p[0]))
    assert len(merged[0]) == 5
    assert [len(p) for p in t["770"].geometry] == [2]


MAPPING = """postcode,territory,employee,vehicle
84130,North,Anna,VAN-01
84131,North,Ben,VAN-01
84230,Other,Cara,VAN-02
84307,South,Dora,VAN-03
84323,South,Dora,VAN-03
99999,South,Emil,VAN-04
84130,North,Anna,VAN-01
"""


def test_mapping(spark, nine, tmp_path):
    (tmp_path / "m.csv").write_text(MAPPING)
    m = geojson.read_mapping(spark, str(tmp_path / "m.csv"))
    members = R.by_mapping(nine, "postcode", m, "postcode", "territory")
    t = {r.territory_id: r for r in R.build(members, {"employee": "unique", "vehicle": "unique"}).collect()}
    assert {k: v.source_feature_count for k, v in t.items()} == {"North": 3, "Other": 1, "South": 2}
    assert t["North"].employee == ["Anna", "Ben"] and t["North"].vehicle == ["VAN-01"] and len(t["North"].geometry) == 1
    assert sorted(r.key for r in R.unmatched_geometry(nine, "postcode", m, "postcode").collect()) == ["77000", "84140", "84399", "94405"]
    assert [r.key for r in R.unmatched_mapping(nine, "postcode", m, "postcode").collect()] == ["99999"]
    assert [r.key for r in R.duplicate_keys(m, "postcode").collect()] == ["84130"]
    assert not R.validate(nine, "postcode", m, "postcode", "territory").first().ok
    csv = {r.territory_id: r for r in R.to_csv_columns(R.summaries(members, {"employee": "unique"})).collect()}
    assert csv["North"].employee == "Anna|Ben"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        geojson.read_mapping(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "m.json").write_text('[{"postcode": 84130, "territory": " N "}]')
    assert geojson.read_mapping(spark, str(tmp_path / "m.json")).first().territory == "N"


def test_sinks(spark, nine, tmp_path):
    t = R.build(R.by_prefix(nine, "postcode", 2))
    geojson.write_features(t, str(tmp_path / "o.geojson"), "territory_id")
    doc = json.loads((tmp_path / "o.geojson").read_text())
    assert [f["properties"]["territory_id"] for f in doc["features"]] == ["77", "84", "94"]
    again = geojson.read_features(spark, str(tmp_path / "o.geojson"))
    area = lambda df: [round(r[0], 3) for r in df.orderBy("ord").select(G.area_km2(F.col("geometry"))).collect()]
    assert area(again) == [round(r.area_km2, 3) for r in t.orderBy("territory_id").collect()]
    topo = json.loads(geojson.topojson(t))
    assert len(topo["arcs"]) == sum(len(p) for f in doc["features"] for p in f["geometry"]["coordinates"])
    assert geojson.output_format("a.topojson") == "topojson" and geojson.output_format("x", "csv") == "csv"


def test_bad_geometry(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}))
    with pytest.raises(Exception, match="feature 0"):
        geojson.read_features(spark, str(tmp_path / "p.json")).collect()


POINT = "array<array<array<struct<lon:double,lat:double>>>>"


def shapes(spark, *polygons):
    return spark.createDataFrame([(i, [[[(float(x), float(y)) for x, y in r] for r in p]]) for i, p in enumerate(polygons)], f"ord long, geometry {POINT}")


def test_repair_and_winding(spark):
    s = shapes(spark, [[(0, 0), (1, 0), (1, 1), (1, 1), (0, 1)], [(0, 0), (1, 1)]], [ring(0, 0, 4, 4)[::-1], ring(1, 1, 2, 2)])
    r = s.select(G.repaired(F.col("geometry")).alias("g"), G.repair_warnings(F.col("geometry"), F.lit("a")).alias("w")).collect()
    assert [len(x) for x in r[0].g[0]] == [5] and len(r[0].w) == 2
    turn = s.filter("ord = 1").select(*(G.shoelace(F.get(F.get(G.repaired(F.col("geometry")), F.lit(0)), F.lit(i))) for i in (0, 1))).first()
    assert turn[0] > 0 > turn[1]


def test_holes_and_points(spark):
    s = shapes(spark, [ring(0, 0, 4, 4), ring(1, 1, 3, 3)[::-1]]).withColumn("polygon_id", F.lit("a"))
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 9.0, 9.0)], "point_id long, lon double, lat double")
    assert [r.point_id for r in spatial.point_in_polygon(p, s, 1.0).collect()] == [1]
    assert abs(s.select(G.area_km2(F.col("geometry"))).first()[0] / (12 * G.KM_PER_DEGREE**2) - 1) < 0.01


def test_overlap(spark):
    m = shapes(spark, [ring(0, 0, 2, 2)], [ring(1, 1, 3, 3)], [ring(3, 1, 5, 3)]).withColumn("key", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("ord") + 1).cast("int")))
    assert [r.warning for r in R.overlap_warnings(m).collect()] == ["A and B"]


def test_places(spark):
    rows = [(0, {"postcode": "84130", "name": "Passau-Nord"}, [[ring(12.6, 48.6, 12.7, 48.68)]]), (1, {"postcode": "94405", "name": "Landau"}, [[ring(13.0, 48.6, 13.1, 48.7)]]), (2, {"postcode": " "}, [[ring(0, 0, 1, 1)]])]
    rows = [(i, p, [[[(float(x), float(y)) for x, y in r] for r in q] for q in g]) for i, p, g in rows]
    index = places.load(spark.createDataFrame(rows, f"ord long, props map<string,string>, geometry {POINT}"))
    assert index.count() == 2 and places.search(index, "841").count() == 1 and places.search(index, "").count() == 2
    p = spark.createDataFrame([(1, 12.65, 48.64), (2, 0.0, 0.0)], "point_id long, lon double, lat double")
    assert [(r.point_id, r.code) for r in places.at_points(index, p).collect()] == [(1, "84130")]


def test_sync(spark):
    keys = spark.createDataFrame([(3, x, 0) for x in range(5)], "z int, x long, y long")
    none = spark.createDataFrame([], "dataset string, revision string, z int, x long, y long, data binary, checksum string")
    planned = sync.plan(keys, none, "d", "r")
    got = sync.download(planned, lambda z, x, y: bytes([z, x, y]), "d", "r")
    again = sync.result(sync.plan(keys, got, "d", "r")).first()
    assert (again.reused, again.downloaded, again.published) == (5, 0, True)
    assert sync.prune(got, "d", "other").count() == 0

    def broken(z, x, y):
        raise OSError("no network")

    with pytest.raises(Exception):
        sync.download(planned, broken, "d", "r").collect()
