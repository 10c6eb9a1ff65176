"""Queries on territories, polygons and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import text as X
from tilewright.operators import spatial
from tilewright.operators import territory as R
from tilewright.plans import inputs as I
from tilewright.plans.registry import query

C = F.col


def _prefix_sql(n: int) -> str:
    return f"""WITH {I.FEATURES} SELECT substring(postcode, 1, {n}) AS territory_id, count(*) AS source_feature_count, string_agg(DISTINCT postcode, '|' ORDER BY postcode) AS source_values
FROM features WHERE whole AND postcode <> '' GROUP BY 1"""


def _by_prefix(spark: SparkSession, sf: str, n: int) -> DataFrame:
    s = R.summaries(R.by_prefix(I.features(spark, sf), "postcode", n))
    return s.withColumn("source_values", X.list_cell(C("source_values")))


@query(_prefix_sql(3))
def territory_prefix3(spark: SparkSession, sf: str) -> DataFrame:
    return _by_prefix(spark, sf, 3)


@query(_prefix_sql(2))
def territory_prefix2(spark: SparkSession, sf: str) -> DataFrame:
    return _by_prefix(spark, sf, 2)


@query(_prefix_sql(1))
def territory_prefix1(spark: SparkSession, sf: str) -> DataFrame:
    return _by_prefix(spark, sf, 1)


_trim = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_members = f"""{I.FEATURES}, {I.MAPPING}, members AS (SELECT {_trim.format('territory')} AS grp, f.ord, m.ord AS "row", f.postcode AS key, segment, rank, {_trim.format('employee')} AS employee, {_trim.format('amount')} AS amount
FROM features f JOIN mapping m ON lower({_trim.format('f.postcode')}) = lower({_trim.format('m.postcode')}) WHERE whole AND f.postcode <> '' AND {_trim.format('territory')} <> '')"""


def _members_df(spark: SparkSession, sf: str) -> DataFrame:
    return R.by_mapping(I.features(spark, sf), "postcode", I.mapping(spark, sf), "postcode", "territory")


@query(f"WITH {_members} SELECT grp AS territory_id, count(*) AS source_feature_count, string_agg(DISTINCT key, '|' ORDER BY key) AS source_values FROM members GROUP BY 1")
def territory_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return R.summaries(_members_df(spark, sf)).withColumn("source_values", X.list_cell(C("source_values")))


@query(f"""WITH {_members} SELECT grp AS territory_id, ord, "row", key, concat_ws('&', 'amount=' || amount, 'employee=' || employee, 'rank=' || rank, 'segment=' || segment) AS props FROM members""")
def territory_members(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _members_df(spark, sf).select(C("group").alias("territory_id"), "ord", "row", "key", F.array_join(pairs, "&").alias("props"))


def _agg(name: str, field: str, how: str, sql: str, show=lambda c: c):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = R.summaries(_members_df(spark, sf), {field: how})
        return s.select("territory_id", show(C(field)).alias("value"))

    run.__name__ = name
    query(f"WITH {_members} SELECT grp AS territory_id, {sql} AS value FROM members GROUP BY 1")(run)


_num = "CASE WHEN regexp_full_match(amount, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(amount AS DOUBLE) END"
_agg("territory_agg_first", "employee", "first", "arg_min(employee, {'o': ord, 'r': \"row\"}) FILTER (employee <> '')")
_agg("territory_agg_unique", "employee", "unique", "string_agg(DISTINCT employee, '|' ORDER BY employee) FILTER (employee <> '')", R.scalarised)
_agg("territory_agg_list", "segment", "list", "string_agg(segment, '|' ORDER BY ord, \"row\") FILTER (segment <> '')", R.scalarised)
_agg("territory_agg_count", "employee", "count", "count(DISTINCT employee) FILTER (employee <> '')")
_agg("territory_agg_sum", "amount", "sum", f"sum({_num})")
_agg("territory_agg_min", "amount", "min", f"min({_num})")
_agg("territory_agg_max", "amount", "max", f"max({_num})")


@query(f"""WITH {_members} SELECT grp AS territory_id, grp AS territory_name, string_agg(DISTINCT employee, '|' ORDER BY employee) AS employee, CAST(count(DISTINCT rank) AS VARCHAR) AS rank,
string_agg(DISTINCT key, '|' ORDER BY key) AS source_values, CAST(count(*) AS VARCHAR) AS source_feature_count FROM members GROUP BY 1""")
def territory_csv(spark: SparkSession, sf: str) -> DataFrame:
    return R.to_csv_columns(R.summaries(_members_df(spark, sf), {"employee": "unique", "rank": "count"}))


@query(f"""WITH {I.FEATURES}, {I.MAPPING} SELECT DISTINCT postcode AS key FROM features WHERE whole AND postcode <> '' AND lower({_trim.format('postcode')}) NOT IN (SELECT lower({_trim.format('postcode')}) FROM mapping)""")
def territory_unmatched_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return R.unmatched_geometry(I.features(spark, sf), "postcode", I.mapping(spark, sf), "postcode")


@query(f"""WITH {I.FEATURES}, {I.MAPPING} SELECT DISTINCT lower({_trim.format('postcode')}) AS key FROM mapping WHERE lower({_trim.format('postcode')}) NOT IN (SELECT lower(postcode) FROM features WHERE whole AND postcode <> '')""")
def territory_unmatched_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return R.unmatched_mapping(I.features(spark, sf), "postcode", I.mapping(spark, sf), "postcode")


@query(f"WITH {I.MAPPING} SELECT lower({_trim.format('postcode')}) AS key, count(*) AS n FROM mapping GROUP BY 1 HAVING count(*) > 1")
def territory_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return R.duplicate_keys(I.mapping(spark, sf), "postcode")


@query(f"""WITH {I.FEATURES}, {I.MAPPING}, fk AS (SELECT postcode AS k FROM features WHERE whole AND postcode <> ''), mk AS (SELECT lower({_trim.format('postcode')}) AS k, territory FROM mapping),
c AS (SELECT (SELECT count(DISTINCT k) FROM fk WHERE k NOT IN (SELECT k FROM mk)) AS unmatched_geometry_keys, (SELECT count(DISTINCT k) FROM mk WHERE k NOT IN (SELECT k FROM fk)) AS unmatched_mapping_keys,
 (SELECT count(*) FROM (SELECT k FROM mk GROUP BY k HAVING count(*) > 1)) AS duplicate_mapping_keys,
 (SELECT count(*) FROM features WHERE postcode = '') + (SELECT count(*) FROM fk JOIN mk USING (k) WHERE {_trim.format('territory')} = '') AS empty_group_keys,
 (SELECT count(*) FROM features WHERE NOT whole AND postcode <> '') AS repair_warnings, 0::BIGINT AS overlap_warnings)
SELECT *, false AS ok FROM c""")
def territory_validate(spark: SparkSession, sf: str) -> DataFrame:
    return R.validate(I.features(spark, sf), "postcode", I.mapping(spark, sf), "postcode", "territory")


@query(f"WITH {I.MAPPING} SELECT count(*) AS rows, 4::BIGINT AS columns, (SELECT count(*) FROM (SELECT 1 FROM mapping GROUP BY lower({_trim.format('postcode')}) HAVING count(*) > 1)) AS duplicate_keys, false AS ok FROM mapping")
def territory_mapping_report(spark: SparkSession, sf: str) -> DataFrame:
    return R.mapping_report(I.mapping(spark, sf))


_km = G.KM_PER_DEGREE


@query(f"""WITH {I.FEATURES} SELECT CASE WHEN postcode = '' THEN CAST(ord AS VARCHAR) ELSE postcode END AS id, 1::BIGINT AS components,
CASE WHEN whole THEN round(cos((5 * gy + 2) / 5.0 * pi() / 180) * {_km!r} * {_km!r}, 4) ELSE 0.0::DOUBLE END AS area_km2,
CAST(gx AS DOUBLE) AS min_lon, CAST(gx + 1 AS DOUBLE) AS max_lon, CAST(gy AS DOUBLE) AS min_lat, CAST(gy + CASE WHEN whole THEN 1 ELSE 0 END AS DOUBLE) AS max_lat FROM features""")
def territory_inspect(spark: SparkSession, sf: str) -> DataFrame:
    return R.inspect(I.features(spark, sf))


@query("SELECT unnest(['postcode', 'rank', 'segment']) AS key")
def territory_property_keys(spark: SparkSession, sf: str) -> DataFrame:
    return R.property_keys(I.features(spark, sf))


def _grouped_squares(spark: SparkSession, sf: str) -> DataFrame:
    """Each square by its customer's nation; every 25th stands twice."""
    f = I.features(spark, sf).join(I.squares(spark, sf).select("ord", "grp"), "ord").filter("ord % 61 <> 0")
    m = f.select(C("grp").cast("string").alias("group"), "ord", C("props")["postcode"].alias("key"), "props", "geometry")
    return m.unionByName(m.filter("ord % 25 = 0").withColumn("ord", C("ord") + 1_000_000))


_edges_sql = f"""{I.SQUARES}, own AS (SELECT CAST(grp AS VARCHAR) AS grp, gx, gy FROM squares WHERE ord % 61 <> 0),
e AS (SELECT DISTINCT grp, gx * 10000000 + d[1] AS ax, gy * 10000000 + d[2] AS ay, gx * 10000000 + d[3] AS bx, gy * 10000000 + d[4] AS "by"
 FROM own, (SELECT unnest([[0, 0, 10000000, 0], [10000000, 0, 10000000, 10000000], [10000000, 10000000, 0, 10000000], [0, 10000000, 0, 0]]) AS d)),
outline AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.grp = e.grp AND r.ax = e.bx AND r.ay = e."by" AND r.bx = e.ax AND r."by" = e.ay))"""


@query(f'WITH {_edges_sql} SELECT grp AS "group", ax, ay, bx, "by" FROM outline')
def dissolve_edges(spark: SparkSession, sf: str) -> DataFrame:
    return R.dissolve_edges(_grouped_squares(spark, sf)).select("group", "ax", "ay", "bx", "by")


@query(f"""WITH {_edges_sql} SELECT grp AS "group", round(sum((ax / 10000000) * ("by" / 10000000) - (bx / 10000000) * (ay / 10000000)) / 2, 6) AS area FROM outline GROUP BY 1""")
def dissolve_area(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda c: C(c) / 10000000
    twice = F.sum(q("ax") * q("by") - q("bx") * q("ay"))
    return R.dissolve_edges(_grouped_squares(spark, sf)).groupBy("group").agg(F.round(twice / 2, 6).alias("area"))


@query(f"WITH {_edges_sql} SELECT CAST(grp AS VARCHAR) AS \"group\", CAST(count(*) AS DOUBLE) AS area FROM own GROUP BY 1")
def dissolve_polygons(spark: SparkSession, sf: str) -> DataFrame:
    shapes = R.dissolved(_grouped_squares(spark, sf))
    area = F.aggregate(F.transform("geometry", lambda p: F.aggregate(F.transform(p, lambda r: G.shoelace(r) / 2), F.lit(0.0), lambda s, a: s + a)), F.lit(0.0), lambda s, a: s + a)
    return shapes.select("group", F.round(area, 6).alias("area"))


@query()
def territory_build(spark: SparkSession, sf: str) -> DataFrame:
    """Whole territories by mapping: fields, area, dissolved and simplified geometry as GeoJSON."""
    t = R.build(_members_df(spark, sf), {"employee": "unique", "amount": "sum"}, simplify_metres=50.0)
    return t.select("territory_id", "source_feature_count", "area_km2", X.list_cell(C("employee")).alias("employee"), "amount", G.geojson_geometry(C("geometry")).alias("geometry"))


@query(f"""WITH {I.SQUARES} SELECT CAST(ord AS BIGINT) AS ord FROM squares WHERE ord % 61 <> 0""")
def polygon_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Of polygons over the same exterior points in a group, the first."""
    from pyspark.sql import Window

    p = _grouped_squares(spark, sf).select("group", "ord", G.ring_signature(F.get(F.get("geometry", F.lit(0)), F.lit(0))).alias("signature"))
    first = Window.partitionBy("group", "signature").orderBy("ord")
    return p.withColumn("r", F.row_number().over(first)).filter("r = 1").select("ord")


_boxes_sql = """b AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1000 / 10.0 AS x, (c_custkey * 104729) % 1000 / 10.0 AS y, 0.5 + c_custkey % 5 AS w FROM customer)"""


@query(f"WITH {_boxes_sql} SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.id < q.id AND p.x < q.x + q.w AND q.x < p.x + p.w AND p.y < q.y + q.w AND q.y < p.y + p.w")
def bbox_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    k = C("c_custkey")
    b = I.table(spark, sf, "customer").select(k.alias("id"), ((k * 7919) % 1000 / 10).alias("min_x"), ((k * 104729) % 1000 / 10).alias("min_y"), (k % 5 + 0.5).alias("w"))
    return spatial.overlapping_pairs(b.withColumn("max_x", C("min_x") + C("w")).withColumn("max_y", C("min_y") + C("w")), cell=4.0)


_ring_sql = """r AS (SELECT c_custkey AS id, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 53 AS DOUBLE) AS y, CAST(1 + c_custkey % 4 AS DOUBLE) AS w, CAST(1 + c_custkey % 3 AS DOUBLE) AS h, c_custkey % 2 = 0 AS cw FROM customer)"""


def _rings(spark: SparkSession, sf: str) -> DataFrame:
    k = C("c_custkey")
    r = I.table(spark, sf, "customer").select(k.alias("id"), (k % 97).cast("double").alias("x"), (k % 53).cast("double").alias("y"), (1 + k % 4).cast("double").alias("w"), (1 + k % 3).cast("double").alias("h"), (k % 2 == 0).alias("cw"))
    pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    x, y, w, h = (C(c) for c in "xywh")
    ring = F.array(pt(x, y), pt(x + w, y), pt(x + w, y), pt(x + w, y + h), pt(x, y + h))
    return r.withColumn("ring", F.when(C("cw"), F.reverse(ring)).otherwise(ring))


@query(f"WITH {_ring_sql} SELECT id, CASE WHEN cw THEN -2 ELSE 2 END * w * h AS twice_area, cw AS clockwise, round(w * h * cos((CASE WHEN cw THEN 5 * y + 3 * h ELSE 5 * y + 2 * h END) / 5 * pi() / 180) * {_km!r} * {_km!r}, 4) AS area_km2 FROM r")
def ring_area_winding(spark: SparkSession, sf: str) -> DataFrame:
    r = _rings(spark, sf).withColumn("ring", G.repaired_ring(C("ring")))
    return r.select("id", G.shoelace(C("ring")).alias("twice_area"), G.is_clockwise(C("ring")).alias("clockwise"), F.round(G.area_km2(F.array(F.array("ring"))), 4).alias("area_km2"))


@query(f"WITH {_ring_sql} SELECT id, x AS min_lon, x + w AS max_lon, y AS min_lat, y + h AS max_lat FROM r")
def ring_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return _rings(spark, sf).select("id", *spatial.bounds_columns(F.array(F.array("ring"))))


@query(f"WITH {_ring_sql} SELECT id, 5::BIGINT AS points, 'x' || id || ': polygon 0 ring 0: ring was not closed; closed automatically' AS warnings FROM r")
def ring_repair(spark: SparkSession, sf: str) -> DataFrame:
    g = F.array(F.array("ring"))
    fixed = F.get(F.get(G.repaired(g), F.lit(0)), F.lit(0))
    return _rings(spark, sf).select("id", F.size(fixed).cast("long").alias("points"), F.array_join(G.repair_warnings(g, F.concat(F.lit("x"), C("id").cast("string"))), "|").alias("warnings"))


@query(f"WITH {_ring_sql}, p AS (SELECT id, unnest([[x, y], [x + w, y], [x + w, y], [x + w, y + h], [x, y + h]]) AS p FROM r) SELECT id, string_agg(CAST(round(p[1] * 1e7) AS BIGINT) || ',' || CAST(round(p[2] * 1e7) AS BIGINT), ';' ORDER BY round(p[1] * 1e7), round(p[2] * 1e7)) AS signature FROM p GROUP BY id")
def ring_signature(spark: SparkSession, sf: str) -> DataFrame:
    return _rings(spark, sf).select("id", G.ring_signature(C("ring")).alias("signature"))


_nest_sql = """ext AS (SELECT c_custkey AS exterior_id, CAST((c_custkey * 7) % 60 AS DOUBLE) AS x, CAST((c_custkey // 3) % 60 AS DOUBLE) AS y, CAST(2 + c_custkey % 9 AS DOUBLE) AS w FROM customer WHERE c_custkey % 5 <> 0),
hol AS (SELECT c_custkey AS hole_id, (c_custkey * 11) % 60 + 0.25::DOUBLE AS x, (c_custkey // 7) % 60 + 0.25::DOUBLE AS y FROM customer WHERE c_custkey % 5 = 0)"""


@query(f"WITH {_nest_sql} SELECT hole_id, arg_min(exterior_id, {{'s': w, 'i': exterior_id}}) AS exterior_id FROM hol h JOIN ext e ON h.x >= e.x AND h.x < e.x + w AND h.y >= e.y AND h.y < e.y + w GROUP BY 1")
def hole_nesting(spark: SparkSession, sf: str) -> DataFrame:
    k = C("c_custkey")
    c = I.table(spark, sf, "customer")

    def ring(x, y, w):
        at = lambda dx, dy: F.struct((x + dx).cast("double").alias("lon"), (y + dy).cast("double").alias("lat"))
        return F.array(at(0, 0), at(w, 0), at(w, w), at(0, w), at(0, 0))

    ext = c.filter("c_custkey % 5 <> 0").select(k.alias("exterior_id"), ring(k * 7 % 60, F.expr("(c_custkey div 3) % 60"), 2 + k % 9).alias("ring"))
    hol = c.filter("c_custkey % 5 = 0").select(k.alias("hole_id"), ring(k * 11 % 60 + 0.25, F.expr("(c_custkey div 7) % 60") + 0.25, F.lit(0.5)).alias("ring"))
    return spatial.nest_holes(ext, hol, cell=4.0)


@query(f"WITH {_ring_sql}, p AS (SELECT id, unnest([[0, 0, 1, 0], [1, 0, 1, 1], [1, 1, 0, 1], [0, 1, 0, 0]]) AS d, x, y, w, h, cw FROM r) SELECT id, x + d[1] * w AS ax, y + d[2] * h AS ay, x + d[3] * w AS bx, y + d[4] * h AS b_y FROM p")
def ring_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the repaired rings, wound counter-clockwise."""
    r = _rings(spark, sf).withColumn("ring", G.oriented(G.repaired_ring(C("ring")), False))
    return r.select("id", F.explode(G.edges(C("ring"))).alias("e")).select("id", C("e.a.lon").alias("ax"), C("e.a.lat").alias("ay"), C("e.b.lon").alias("bx"), C("e.b.lat").alias("b_y"))


@query()
def simplify_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Dissolved outlines before and after simplification by 50 m: points left."""
    m = _grouped_squares(spark, sf)
    n = lambda g: F.aggregate(F.flatten(g), F.lit(0), lambda s, r: s + F.size(r))
    a = R.dissolved(m).select("group", n("geometry").alias("points"))
    b = R.dissolved(m, 50.0).select("group", n("geometry").alias("points_left"))
    return a.join(b, "group")


_pip_sql = f"""{I.POINTS}, q AS (SELECT id, (lon + 180) / 360 * 40 AS px, (lat + 85) / 170 * 40 AS py FROM pts)"""


@query(f"WITH {I.SQUARES}, {_pip_sql} SELECT id AS point_id, code AS polygon_id FROM q JOIN squares ON px >= gx AND px < gx + 1 AND py >= gy AND py < gy + 1")
def pip_reverse_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = I.points(spark, sf).select(C("id").alias("point_id"), ((C("lon") + 180) / 360 * 40).alias("lon"), ((C("lat") + 85) / 170 * 40).alias("lat"))
    pt = lambda dx, dy: F.struct((C("gx") + dx).cast("double").alias("lon"), (C("gy") + dy).cast("double").alias("lat"))
    ring = F.array(pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 1), pt(0, 0))
    s = I.squares(spark, sf).select(C("code").alias("polygon_id"), F.array(F.array(ring)).alias("geometry"))
    return spatial.point_in_polygon(p, s, cell=1.0)


_codes_sql = "codes AS (SELECT s_suppkey AS ord, lpad(CAST(s_suppkey % 80 AS VARCHAR), 4, '0') || 'A' AS code, s_name AS name FROM supplier)"


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    k = C("s_suppkey")
    return I.table(spark, sf, "supplier").select(k.alias("ord"), F.concat(F.lpad((k % 80).cast("string"), 4, "0"), F.lit("A")).alias("code"), C("s_name").alias("name"))


@query(f"WITH {_codes_sql} SELECT code, name FROM codes WHERE contains(lower(code), '00') OR contains(lower(name), '00') ORDER BY code, ord LIMIT 50")
def postcode_search_top50(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.operators import places

    return places.search(_codes(spark, sf), " 00 ").select("code", "name")


@query(f"WITH {_codes_sql}, a AS (SELECT r_regionkey, ' 00' || lpad(CAST(r_regionkey * 13 AS VARCHAR), 2, '0') || 'a ' AS asked FROM region) SELECT asked, arg_max(code, ord) AS code, arg_max(name, ord) AS name FROM a JOIN codes ON lower(code) = trim(asked) GROUP BY asked")
def postcode_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.operators import places

    asked = F.concat(F.lit(" 00"), F.lpad((C("r_regionkey") * 13).cast("string"), 2, "0"), F.lit("a "))
    return places.lookup(_codes(spark, sf), I.table(spark, sf, "region").select(asked.alias("asked")))


@query(f"WITH {_ring_sql} SELECT id, x + w / 2 AS center_lon, y + h / 2 AS center_lat, x || ',' || y || ',' || (x + w) || ',' || (y + h) AS bbox FROM r")
def postcode_summary(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.operators import places

    s = places.summary(F.array(F.array("ring")))
    return _rings(spark, sf).select("id", s.alias("s")).select("id", "s.center_lon", "s.center_lat", F.array_join("s.bbox", ",").alias("bbox"))
