"""Queries on map entities, routes, synchronisation, statistics and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import documents as D
from tilewright.functions import text as X
from tilewright.functions import tiles as T
from tilewright.operators import osm, routes, spatial, stats, sync
from tilewright.plans import inputs as I
from tilewright.plans.registry import query

C = F.col

_road = """CASE WHEN highway IN ('motorway', 'motorway_link') THEN 'motorway' WHEN highway IN ('trunk', 'trunk_link') THEN 'trunk' WHEN highway IN ('primary', 'primary_link') THEN 'primary'
 WHEN highway IN ('secondary', 'secondary_link') THEN 'secondary' WHEN highway IN ('tertiary', 'tertiary_link') THEN 'tertiary' WHEN highway IN ('unclassified', 'residential', 'living_street') THEN 'residential'
 WHEN highway IN ('service', 'track') THEN 'service' WHEN highway IN ('path', 'footway', 'pedestrian', 'cycleway', 'bridleway', 'steps') THEN 'path' END"""
_road_zoom = "CASE rc WHEN 'motorway' THEN 5 WHEN 'trunk' THEN 6 WHEN 'primary' THEN 7 WHEN 'secondary' THEN 8 WHEN 'tertiary' THEN 9 WHEN 'residential' THEN 11 WHEN 'service' THEN 13 WHEN 'path' THEN 14 END"
_area = """CASE WHEN trim(building) <> '' AND trim(building) <> 'no' THEN 'building/building/14' WHEN "natural" IN ('water', 'bay', 'wetland') THEN 'water/water/8' WHEN "natural" = 'wood' THEN 'landcover/forest/9'
 WHEN "natural" IN ('grassland', 'scrub', 'heath') THEN 'landcover/grass/10' WHEN waterway = 'riverbank' THEN 'water/water/8' WHEN landuse IN ('reservoir', 'basin') THEN 'water/water/8' WHEN landuse = 'forest' THEN 'landcover/forest/9'
 WHEN landuse IN ('farmland', 'farm', 'orchard', 'vineyard') THEN 'landcover/farmland/10' WHEN landuse = 'meadow' THEN 'landcover/meadow/10' WHEN landuse = 'grass' THEN 'landcover/grass/10'
 WHEN landuse IN ('residential', 'commercial', 'industrial', 'retail') THEN 'landcover/urban/10' END"""


@query(f'WITH {I.TAGGED}, c AS (SELECT id, {_road} AS rc FROM tagged) SELECT id, rc AS "class", CAST({_road_zoom} AS INTEGER) AS min_zoom FROM c WHERE rc IS NOT NULL')
def osm_road_class(spark: SparkSession, sf: str) -> DataFrame:
    t = I.tagged(spark, sf).select("id", osm.road_class(C("tags")).alias("c")).filter("c is not null")
    return t.select("id", "c.class", "c.min_zoom")


@query(f"""WITH {I.TAGGED}, c AS (SELECT id, string_split({_area}, '/') AS a FROM tagged) SELECT id, a[1] AS layer, a[2] AS "class", CAST(a[3] AS INTEGER) AS min_zoom FROM c WHERE a IS NOT NULL""")
def osm_area_class(spark: SparkSession, sf: str) -> DataFrame:
    t = I.tagged(spark, sf).select("id", osm.area_class(C("tags")).alias("c")).filter("c is not null")
    return t.select("id", "c.layer", "c.class", "c.min_zoom")


@query(f"""WITH {I.TAGGED}, c AS (SELECT id, {_road} AS rc, string_split({_area}, '/') AS a, name, ref FROM tagged)
SELECT id, coalesce(rc, a[2]) AS "class", coalesce(nullif(trim(name), ''), CASE WHEN rc IS NOT NULL THEN nullif(trim(ref), '') END) AS name FROM c WHERE rc IS NOT NULL OR a IS NOT NULL""")
def osm_feature_properties(spark: SparkSession, sf: str) -> DataFrame:
    t = osm.renderable(I.tagged(spark, sf)).withColumn("p", osm.feature_properties(C("c"), C("tags")))
    return t.select("id", C("p")["class"].alias("class"), C("p")["name"].alias("name"))


_used = f"{I.NODES}, {I.WAYS}, used AS (SELECT DISTINCT node AS id FROM refs)"


@query(f"WITH {_used} SELECT id, arg_max(lon, input_idx) AS lon, arg_max(lat, input_idx) AS lat FROM nodes SEMI JOIN used USING (id) GROUP BY id")
def osm_node_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    return osm.needed_nodes(I.nodes(spark, sf), I.ways(spark, sf))


@query(f"WITH {_used} SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM nodes SEMI JOIN used USING (id)")
def osm_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return osm.bounds(I.nodes(spark, sf), I.ways(spark, sf))


@query(f"""WITH {_used}, last AS (SELECT id AS node, arg_max(lon, input_idx) AS lon, arg_max(lat, input_idx) AS lat FROM nodes GROUP BY id)
SELECT r.id, count(*) AS points, string_agg(CAST(CAST(round(lon * 10000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(lat * 10000) AS BIGINT) AS VARCHAR), ';' ORDER BY pos) AS line FROM refs r JOIN last USING (node) GROUP BY r.id""")
def osm_way_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = osm.way_lines(I.ways(spark, sf), osm.last_wins(I.nodes(spark, sf)))
    shown = F.transform("points", lambda p: F.concat_ws(",", F.round(p["lon"] * 10000).cast("long"), F.round(p["lat"] * 10000).cast("long")))
    return lines.select("id", F.size("points").cast("long").alias("points"), F.array_join(shown, ";").alias("line"))


def _boxed(spark: SparkSession, sf: str) -> DataFrame:
    """Features as boxes around points: id, layer, z, box."""
    p = I.points(spark, sf)
    layer = F.element_at(F.array(F.lit("water"), F.lit("building"), F.lit("transportation")), (C("id") % 3 + 1).cast("int"))
    w = (C("id") % 50) / 100.0
    return p.select("id", layer.alias("layer"), (3 + C("id") % 8).cast("int").alias("z"), (C("lon") - w).alias("min_lon"), (C("lon") + w).alias("max_lon"), (C("lat") - w / 2).alias("min_lat"), (C("lat") + w / 2).alias("max_lat"))


_boxed_sql = f"""{I.POINTS}, boxed AS (SELECT id, (['water', 'building', 'transportation'])[id % 3 + 1] AS layer, CAST(3 + id % 8 AS INTEGER) AS z, lon - w AS min_lon, lon + w AS max_lon, lat - w / 2 AS min_lat, lat + w / 2 AS max_lat
 FROM (SELECT *, CAST(id % 50 AS DOUBLE) / 100 AS w FROM pts)),
sp AS (SELECT id, layer, z, {I.sql_x('min_lon', 'z')} AS x0, {I.sql_x('max_lon', 'z')} AS x1, {I.sql_y('max_lat', 'z')} AS y0, {I.sql_y('min_lat', 'z')} AS y1 FROM boxed),
fan AS (SELECT id, layer, z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM sp WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= 4096))"""


@query(f"WITH {_boxed_sql} SELECT id, z, x, y FROM fan")
def osm_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.tiles_of(_boxed(spark, sf)).select("id", "z", "x", "y")


@query(f"WITH {_boxed_sql} SELECT z, x, y, layer, count(*) AS features FROM fan GROUP BY ALL")
def osm_tile_layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.tiles_of(_boxed(spark, sf)).groupBy("z", "x", "y", "layer").agg(F.count("*").alias("features"))


_wide = "(SELECT id AS wid, list({'lon': lon, 'lat': lat} ORDER BY pos) AS pts FROM refs JOIN last USING (node) GROUP BY id)"


def _small_map(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a tenth of a degree around one place and ways over them with tags."""
    n = I.nodes(spark, sf).withColumn("lon", C("lon") / 3600 + 10).withColumn("lat", C("lat") / 3600 + 48)
    t = I.tagged(spark, sf).hint("merge")  # maps are far larger than the columns they come from, whose size decides on a broadcast
    w = I.ways(spark, sf).join(t, "id").select(F.lit(0).alias("input_idx"), "id", "node_ids", "tags")
    return n, w


@query(f"""WITH {I.TAGGED}, {I.NODES}, {I.WAYS}, last AS (SELECT DISTINCT id AS node FROM nodes), c AS (SELECT id, {_road} AS rc FROM tagged),
f AS (SELECT r.id, CAST({_road_zoom} AS INTEGER) AS mz FROM refs r JOIN last USING (node) JOIN c ON c.id = r.id WHERE rc IS NOT NULL GROUP BY r.id, rc HAVING count(*) >= 2),
z AS (SELECT unnest(range(greatest(5, mz), 15)) AS z FROM f) SELECT CAST(z AS INTEGER) AS z, count(*) AS roads FROM z GROUP BY 1""")
def osm_road_counts(spark: SparkSession, sf: str) -> DataFrame:
    n, w = _small_map(spark, sf)
    return osm.road_counts(osm.features(w, osm.needed_nodes(n, osm.renderable(w))), 5, 14)


@query()
def mvt_encode(spark: SparkSession, sf: str) -> DataFrame:
    """A whole build from the derived map: tiles with size and digest, before compression."""
    n, w = _small_map(spark, sf)
    feats = osm.features(w, osm.needed_nodes(n, osm.renderable(w)))
    tiles = osm.encode(osm.fan_out(feats, 5, 14), gzip=False)
    return tiles.select("z", "x", "y", F.octet_length("data").alias("size"), F.sha2("data", 256).alias("sha"))


_seg_in = "CAST((o_orderkey * 7919) % 6000 - 1000 AS BIGINT) AS ax, CAST((o_orderkey * 104729) % 6000 - 1000 AS BIGINT) AS ay, CAST((o_orderkey * 31) % 6000 - 1000 AS BIGINT) AS bx, CAST((o_orderkey * 57) % 6000 - 1000 AS BIGINT) AS \"by\""


@query(f"""WITH s AS (SELECT o_orderkey AS id, {_seg_in} FROM orders), d AS (SELECT *, CAST(bx - ax AS DOUBLE) AS dx, CAST("by" - ay AS DOUBLE) AS dy FROM s),
t AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN -ax / dx WHEN dx < 0 THEN (4096 - ax) / dx ELSE 0.0 END, CASE WHEN dy > 0 THEN -ay / dy WHEN dy < 0 THEN (4096 - ay) / dy ELSE 0.0 END) AS t0,
 least(1.0, CASE WHEN dx > 0 THEN (4096 - ax) / dx WHEN dx < 0 THEN -ax / dx ELSE 1.0 END, CASE WHEN dy > 0 THEN (4096 - ay) / dy WHEN dy < 0 THEN -ay / dy ELSE 1.0 END) AS t1,
 (dx = 0 AND (ax < 0 OR ax > 4096)) OR (dy = 0 AND (ay < 0 OR ay > 4096)) AS outside FROM d)
SELECT id, CAST(round(ax + t0 * dx) AS BIGINT) AS x0, CAST(round(ay + t0 * dy) AS BIGINT) AS y0, CAST(round(ax + t1 * dx) AS BIGINT) AS x1, CAST(round(ay + t1 * dy) AS BIGINT) AS y1 FROM t WHERE NOT outside AND t0 <= t1""")
def clip_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments clipped to the tile's square, by Column expressions."""
    k = C("o_orderkey")
    coordinate = lambda f: ((k * f) % 6000 - 1000).cast("long")
    s = I.table(spark, sf, "orders").select(k.alias("id"), coordinate(7919).alias("ax"), coordinate(104729).alias("ay"), coordinate(31).alias("bx"), coordinate(57).alias("by"))
    s = s.withColumn("dx", (C("bx") - C("ax")).cast("double")).withColumn("dy", (C("by") - C("ay")).cast("double"))
    reach = lambda a, d, enter: F.when(C(d) > 0, (-C(a) if enter else T.EXTENT - C(a)) / C(d)).when(C(d) < 0, (T.EXTENT - C(a) if enter else -C(a)) / C(d)).otherwise(0.0 if enter else 1.0)
    t0, t1 = F.greatest(F.lit(0.0), reach("ax", "dx", True), reach("ay", "dy", True)), F.least(F.lit(1.0), reach("ax", "dx", False), reach("ay", "dy", False))
    out = lambda a, d: (C(d) == 0) & ((C(a) < 0) | (C(a) > T.EXTENT))
    s = s.withColumn("t0", t0).withColumn("t1", t1).filter(~(out("ax", "dx") | out("ay", "dy")) & (C("t0") <= C("t1")))
    at = lambda a, d, t: F.round(C(a) + C(t) * C(d)).cast("long")
    return s.select("id", at("ax", "dx", "t0").alias("x0"), at("ay", "dy", "t0").alias("y0"), at("ax", "dx", "t1").alias("x1"), at("ay", "dy", "t1").alias("y1"))


def _route_points(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as points of a route."""
    from pyspark.sql import Window

    e = I.table(spark, sf, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(C("user_id").alias("route_id"), pos.alias("pos"), ((C("event_id") * 7919) % 3600000 / 10000 - 180).alias("longitude"), ((C("event_id") * 104729) % 1700000 / 10000 - 85).alias("latitude"))


def _corridor_sql(zoom: int, radius: int, most: int) -> str:
    """Steps along each segment the short way around, squares around each step,
    every tile of a route once in order of travel."""
    n = 1 << zoom
    widen = ", ".join(str(d) for d in range(-radius, radius + 1))
    return f"""WITH RECURSIVE p AS (SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CAST((event_id * 7919) % 3600000 AS DOUBLE) / 10000 - 180 AS lon, CAST((event_id * 104729) % 1700000 AS DOUBLE) / 10000 - 85 AS lat FROM events),
c AS (SELECT route_id, pos, {I.sql_x('lon', str(zoom))} AS x, {I.sql_y('lat', str(zoom), 85.0511287798066)} AS y FROM p),
l AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY route_id) AS points FROM c WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
s AS (SELECT route_id, pos, x, y, CASE WHEN abs(nx - x) > {n // 2} THEN nx + CASE WHEN nx > x THEN -{n} ELSE {n} END ELSE nx END AS tx, ny AS ty FROM l WHERE nx IS NOT NULL),
walk AS (SELECT route_id, pos, 0 AS i, x, y, abs(tx - x) - abs(ty - y) AS lag, tx, ty, abs(tx - x) AS dx, abs(ty - y) AS dy, CASE WHEN tx > x THEN 1 ELSE -1 END AS sx, CASE WHEN ty > y THEN 1 ELSE -1 END AS sy FROM s
 UNION ALL SELECT route_id, pos, i + 1, x + CASE WHEN 2 * lag >= -dy THEN sx ELSE 0 END, y + CASE WHEN 2 * lag <= dx THEN sy ELSE 0 END, lag - CASE WHEN 2 * lag >= -dy THEN dy ELSE 0 END + CASE WHEN 2 * lag <= dx THEN dx ELSE 0 END, tx, ty, dx, dy, sx, sy FROM walk WHERE x <> tx OR y <> ty),
a AS (SELECT route_id, pos, i, (x % {n} + {n}) % {n} AS x, y FROM walk UNION ALL SELECT route_id, pos, 0, x, y FROM l WHERE points = 1),
o AS (SELECT unnest([{widen}]) AS d), v AS (SELECT route_id, pos, i, o1.d AS dy, o2.d AS dx, x + o2.d AS x, y + o1.d AS y FROM a, o o1, o o2),
f AS (SELECT route_id, x, {n - 1} - y AS y, min({{'p': pos, 'i': i, 'dy': dy, 'dx': dx}}) AS place FROM v WHERE x BETWEEN 0 AND {n - 1} AND y BETWEEN 0 AND {n - 1} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY place) AS rank, count(*) OVER (PARTITION BY route_id) AS total FROM f),
k AS (SELECT route_id, CAST(rank - 1 AS INTEGER) AS pos, {zoom} AS z, x, y, total > {most} AS truncated FROM r WHERE rank <= {most})"""


@query(_corridor_sql(7, 1, 2000) + " SELECT * FROM k")
def route_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Corridors of radius 1 at zoom 7 along routes."""
    return routes.route_tiles(_route_points(spark, sf), 7, radius=1, most=2000)


@query(_corridor_sql(6, 0, 300) + " SELECT * FROM k")
def route_line(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of routes at zoom 6 without a corridor, the first 300 of each."""
    return routes.route_tiles(_route_points(spark, sf), 6, radius=0, most=300)


_route_sql = f"""p AS (SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CAST((event_id * 7919) % 3600000 AS DOUBLE) / 10000 - 180 AS lon, CAST((event_id * 104729) % 1700000 AS DOUBLE) / 10000 - 85 AS lat
 FROM events), cells AS (SELECT route_id, pos, {I.sql_x('lon', '5')} AS x, {I.sql_y('lat', '5', 85.0511287798066)} AS y FROM p)"""


@query(f"""WITH {_route_sql}, o AS (SELECT unnest([-1, 0, 1]) AS d), w AS (SELECT route_id, pos, a.d AS dy, b.d AS dx, x + b.d AS x, 31 - (y + a.d) AS y FROM cells, o a, o b WHERE x + b.d BETWEEN 0 AND 31 AND y + a.d BETWEEN 0 AND 31),
f AS (SELECT route_id, x, y, min({{'pos': pos, 'dy': dy, 'dx': dx}}) AS place FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY place) AS rank, count(*) OVER (PARTITION BY route_id) AS total FROM f)
SELECT route_id, CAST(rank - 1 AS INTEGER) AS pos, x, y, total > 40 AS truncated FROM r WHERE rank <= 40""")
def route_radius_dedupe_budget(spark: SparkSession, sf: str) -> DataFrame:
    cells = routes.cells(_route_points(spark, sf), 5)
    return routes.widened(cells, 5, 1, 40)


_sync_in = f"""{I.POINTS}, keyed AS (SELECT DISTINCT 7 AS z, {I.sql_x('lon', '7')} AS x, 127 - {I.sql_y('lat', '7')} AS y FROM pts),
cache AS (SELECT 'berlin' AS dataset, CASE WHEN x % 5 = 0 THEN 'r1' ELSE 'r2' END AS revision, z, x, y, encode('t' || x || '/' || y) AS data, x % 11 = 0 AS bad FROM keyed WHERE (x + y) % 2 = 0)"""


def _sync_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    z = F.lit(7)
    keys = I.points(spark, sf).select(z.alias("z"), T.tile_x(C("lon"), z).alias("x"), T.flip_row(T.tile_y(C("lat"), z), z).alias("y")).distinct()
    data = F.concat(F.lit("t"), C("x").cast("string"), F.lit("/"), C("y").cast("string")).cast("binary")
    held = keys.filter("(x + y) % 2 = 0").withColumn("data", data)
    revision = F.when(C("x") % 5 == 0, "r1").otherwise("r2")
    checksum = F.when(C("x") % 11 == 0, F.lit("00")).otherwise(F.sha2("data", 256))
    return keys, held.select(F.lit("berlin").alias("dataset"), revision.alias("revision"), "z", "x", "y", "data", checksum.alias("checksum"))


_plan_sql = f"{_sync_in}, planned AS (SELECT k.z, k.x, k.y, CASE WHEN c.x IS NULL THEN 'download' WHEN bad THEN 'corrupt' ELSE 'reuse' END AS action FROM keyed k LEFT JOIN (SELECT * FROM cache WHERE revision = 'r2') c USING (z, x, y))"


@query(f"WITH {_plan_sql} SELECT * FROM planned")
def sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    return sync.plan(*_sync_tables(spark, sf), "berlin", "r2")


@query(f"WITH {_plan_sql} SELECT count(*) AS total, count(*) FILTER (action = 'reuse') AS reused, count(*) FILTER (action = 'download') AS downloaded, count(*) FILTER (action = 'corrupt') AS corrupt, count(*) FILTER (action = 'corrupt') = 0 AS published FROM planned")
def sync_result(spark: SparkSession, sf: str) -> DataFrame:
    return sync.result(sync.plan(*_sync_tables(spark, sf), "berlin", "r2"))


@query(f"WITH {_sync_in} SELECT revision, x, y FROM cache WHERE revision = 'r2'")
def sync_prune(spark: SparkSession, sf: str) -> DataFrame:
    return sync.prune(_sync_tables(spark, sf)[1], "berlin", "r2").select("revision", "x", "y")


_conf = """k AS (SELECT 6 AS z, c_custkey % 60 AS x, c_custkey % 7 AS y FROM customer), r AS (SELECT 6 AS z, CAST(n_nationkey * 3 AS BIGINT) AS x_min, CAST(n_nationkey * 3 + n_nationkey % 4 AS BIGINT) AS x_max, 2::BIGINT AS y_min, CAST(2 + n_nationkey % 3 AS BIGINT) AS y_max FROM nation)"""


@query(f"""WITH {_conf} SELECT 'duplicate key' AS kind, z, x, y FROM k GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'key in range', k.z, x, y FROM k JOIN r ON x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max
UNION ALL SELECT 'ranges overlap', a.z, greatest(a.x_min, b.x_min), greatest(a.y_min, b.y_min) FROM r a JOIN r b ON (a.x_min, a.x_max, a.y_max) < (b.x_min, b.x_max, b.y_max) AND a.x_min <= b.x_max AND b.x_min <= a.x_max AND a.y_min <= b.y_max AND b.y_min <= a.y_max""")
def sync_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    k = C("c_custkey")
    keys = I.table(spark, sf, "customer").select(F.lit(6).alias("z"), (k % 60).alias("x"), (k % 7).alias("y"))
    n = C("n_nationkey").cast("long")
    ranges = I.table(spark, sf, "nation").select(F.lit(6).alias("z"), (n * 3).alias("x_min"), (n * 3 + n % 4).alias("x_max"), F.expr("2L").alias("y_min"), (2 + n % 3).alias("y_max"))
    return sync.request_conflicts(keys, ranges)


@query(f"WITH {_conf} SELECT z, x, y FROM k UNION ALL SELECT z, x, unnest(range(y_min, y_max + 1)) FROM (SELECT *, unnest(range(x_min, x_max + 1)) AS x FROM r)")
def sync_requested(spark: SparkSession, sf: str) -> DataFrame:
    k, n = C("c_custkey"), C("n_nationkey").cast("long")
    keys = I.table(spark, sf, "customer").select(F.lit(6).alias("z"), (k % 60).alias("x"), (k % 7).alias("y"))
    ranges = I.table(spark, sf, "nation").select(F.lit(6).alias("z"), (n * 3).alias("x_min"), (n * 3 + n % 4).alias("x_max"), F.expr("2L").alias("y_min"), (2 + n % 3).alias("y_max"))
    return sync.requested(keys, ranges)


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN o_orderkey % 5 = 0 THEN ' berlin' WHEN o_orderkey % 11 = 0 THEN repeat('d', 257) ELSE 'berlin' END AS d, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'r' || o_orderkey END AS r,
 CASE WHEN o_orderkey % 17 = 0 THEN 'XYZ' ELSE 'TMS' END AS c, CASE WHEN o_orderkey % 3 = 0 THEN '/{z}/{x}.mvt' ELSE '/{z}/{x}/{y}.mvt' END AS t FROM orders)
SELECT id, CASE WHEN v <> 1 THEN 'format version' WHEN d <> trim(d) OR length(d) > 256 THEN 'dataset' WHEN r = '' THEN 'revision' WHEN c <> 'TMS' THEN 'coordinate system' WHEN NOT contains(t, '{y}') THEN 'template' END AS problem,
CASE WHEN r = 'r' || (id - id % 2) THEN 'unchanged' ELSE 'fetch' END AS step FROM m""")
def manifest_validate(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey")
    m = I.table(spark, sf, "orders").select(
        k.alias("id"),
        F.when(k % 7 == 0, 2).otherwise(1).alias("format_version"),
        F.when(k % 5 == 0, " berlin").when(k % 11 == 0, F.repeat(F.lit("d"), 257)).otherwise("berlin").alias("dataset"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("r"), k.cast("string"))).alias("revision"),
        F.when(k % 17 == 0, "XYZ").otherwise("TMS").alias("coordinate_system"),
        F.when(k % 3 == 0, "/{z}/{x}.mvt").otherwise("/{z}/{x}/{y}.mvt").alias("tile_url_template"),
    )
    known = F.concat(F.lit("r"), (C("id") - C("id") % 2).cast("string"))
    return m.select("id", sync.manifest_problem().alias("problem"), sync.manifest_step(known, C("revision")).alias("step"))


@query("""WITH a AS (SELECT user_id AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, event_id % 13 AS x, user_id % 4 AS y FROM events),
b AS (SELECT *, max(rank) OVER (PARTITION BY call_id) > 12 AS truncated FROM a QUALIFY rank <= 12), c AS (SELECT *, row_number() OVER (PARTITION BY call_id, x, y ORDER BY rank) > 1 AS again, x % 3 = 0 AS cached FROM b),
d AS (SELECT *, CASE WHEN NOT again AND NOT cached THEN sum(CASE WHEN NOT again AND NOT cached THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY rank) END AS nr FROM c)
SELECT call_id, count(*) AS considered, count(*) FILTER (nr <= 4) AS queued, count(*) FILTER (NOT again AND cached) AS already_cached, count(*) FILTER (again) AS already_queued, count(*) FILTER (nr > 4) AS dropped, bool_or(truncated) AS truncated FROM d GROUP BY 1""")
def prefetch_plan(spark: SparkSession, sf: str) -> DataFrame:
    asked = I.table(spark, sf, "events").select(C("user_id").alias("call_id"), C("event_id").alias("pos"), F.lit(5).alias("z"), (C("event_id") % 13).alias("x"), (C("user_id") % 4).alias("y"))
    cached = asked.filter("x % 3 = 0").select("z", "x", "y").distinct()
    return sync.prefetch_plan(asked, cached, capacity=4, budget=12)


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "events").select("event_type", F.floor(C("value") * 1000).cast("long").alias("ns"), (C("event_id") % 4).alias("run"))


_samples_sql = "s AS (SELECT event_type, CAST(floor(value * 1000) AS BIGINT) AS ns, event_id % 4 AS run FROM events)"
_pct = "max(CASE WHEN i = (n - 1) * {0} // 100 THEN ns END) AS p{0}"


def _pct_sql(by: str) -> str:
    return f"SELECT {by}, CAST(max(n) AS BIGINT) AS n, {_pct.format(50)}, {_pct.format(95)}, {_pct.format(99)} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ns) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM s) GROUP BY {by}"


@query(f"WITH {_samples_sql} {_pct_sql('event_type')}")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.picked_percentiles(_samples(spark, sf), ["event_type"], "ns")


@query(f"""WITH {_samples_sql}, p AS ({_pct_sql('event_type, run')}), r AS (SELECT event_type, p95, row_number() OVER (PARTITION BY event_type ORDER BY p95) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM p)
SELECT event_type, max(CASE WHEN i = (n - 1) // 2 THEN p95 END) + (max(CASE WHEN i = n // 2 THEN p95 END) - max(CASE WHEN i = (n - 1) // 2 THEN p95 END)) // 2 AS median FROM r GROUP BY 1""")
def latency_median_runs(spark: SparkSession, sf: str) -> DataFrame:
    p = stats.picked_percentiles(_samples(spark, sf), ["event_type", "run"], "ns")
    return stats.median_of_runs(p, ["event_type"], "p95")


@query(f"""WITH {_samples_sql}, p AS ({_pct_sql('event_type')}) SELECT event_type, p95, p50, p95 <= p50 * 2.0 AS passed FROM p""")
def p95_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = stats.picked_percentiles(_samples(spark, sf), ["event_type"], "ns")
    return stats.gate(p, "event_type", "p95", "p50", 2.0)


_zooms = "a AS (SELECT CAST(c_nationkey AS INTEGER) AS z, count(*) AS n FROM customer GROUP BY 1)"


@query(f"""WITH {_zooms}, r AS (SELECT z, unnest(range(1, least(n, 300) + 1)) AS round FROM a), f AS (SELECT z FROM r ORDER BY round, z LIMIT 300) SELECT a.z, count(f.z) AS quota FROM a LEFT JOIN f USING (z) GROUP BY a.z""")
def zoom_quotas(spark: SparkSession, sf: str) -> DataFrame:
    a = I.table(spark, sf, "customer").groupBy(C("c_nationkey").cast("int").alias("z")).agg(F.count("*").alias("n"))
    return stats.zoom_quotas(a, 300)


@query("""WITH t AS (SELECT CAST(c_nationkey AS INTEGER) AS z, c_custkey AS x, c_custkey % 17 AS y FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY md5('29093:' || z || ':' || x || ':' || y), x, y) AS r FROM t) SELECT z, x, y FROM r WHERE r <= 5""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    t = I.table(spark, sf, "customer").select(C("c_nationkey").cast("int").alias("z"), C("c_custkey").alias("x"), (C("c_custkey") % 17).alias("y"))
    quotas = t.select("z").distinct().withColumn("quota", F.lit(5))
    return stats.stratified_sample(t, quotas, F.lit("29093"))


@query("SELECT CAST(c_nationkey AS INTEGER) AS z, c_custkey AS x, c_custkey % 17 AS y, row_number() OVER (ORDER BY md5('7:' || c_nationkey || ':' || c_custkey || ':' || c_custkey % 17)) - 1 AS rank FROM customer")
def corpus_order(spark: SparkSession, sf: str) -> DataFrame:
    t = I.table(spark, sf, "customer").select(C("c_nationkey").cast("int").alias("z"), C("c_custkey").alias("x"), (C("c_custkey") % 17).alias("y"))
    return stats.corpus_order(t, F.lit("7"))


@query(_corridor_sql(6, 1, routes.DEFAULT_BUDGET) + " SELECT DISTINCT z, x, y FROM k")
def route_sync_request(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of all corridors at zoom 6, each once."""
    return routes.sync_request(_route_points(spark, sf), 6, radius=1)


@query("SELECT event_type, count(*) FILTER (event_id % 3 <> 0) AS hits, count(*) FILTER (event_id % 3 = 0) AS misses, count(*) FILTER (event_id % 3 <> 0) / count(*) AS ratio FROM events GROUP BY 1")
def cache_hit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return stats.hit_ratio(I.table(spark, sf, "events"), ["event_type"], C("event_id") % 3 != 0)


_names = ["pbf", " PNG ", "image/jpg", "terrarium", "terrain-rgb", "webp-terrarium", "unknown", "", "geojson", "image/tiff"]
_encs = ["", "terrain-rgb", "custom", "other"]


@query(f"""WITH i AS (SELECT p_partkey AS id, ({I._list(_names)})[p_partkey % {len(_names)} + 1] AS name, ({I._list(_encs)})[(p_partkey // {len(_names)}) % {len(_encs)} + 1] AS enc FROM part),
f AS (SELECT id, enc, lower(trim(name)) AS n, CASE enc WHEN 'terrain-rgb' THEN 'mapbox' WHEN 'custom' THEN 'custom' END AS declared FROM i),
g AS (SELECT id, declared, CASE n WHEN 'pbf' THEN '{D.VECTOR}' WHEN 'png' THEN 'image/png' WHEN 'image/jpg' THEN 'image/jpeg' WHEN 'terrarium' THEN 'image/png' WHEN 'terrain-rgb' THEN 'image/png' WHEN 'webp-terrarium' THEN 'image/webp' WHEN 'geojson' THEN 'application/geo+json' WHEN 'image/tiff' THEN 'image/tiff' ELSE 'application/octet-stream' END AS content_type,
 CASE n WHEN 'png' THEN 'png' WHEN 'image/jpg' THEN 'jpg' WHEN 'terrarium' THEN 'png' WHEN 'terrain-rgb' THEN 'png' WHEN 'webp-terrarium' THEN 'webp' WHEN 'geojson' THEN 'geojson' WHEN 'image/tiff' THEN 'tif' ELSE 'mvt' END AS extension,
 CASE n WHEN 'terrarium' THEN 'terrarium' WHEN 'terrain-rgb' THEN 'mapbox' WHEN 'webp-terrarium' THEN 'terrarium' ELSE '' END AS own FROM f)
SELECT id, content_type, extension, CASE WHEN content_type = '{D.VECTOR}' THEN '' ELSE coalesce(declared, own) END AS encoding FROM g""")
def format_infer(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda v, k: F.element_at(F.array(*map(F.lit, v)), (F.expr(k) + 1).cast("int"))
    p = I.table(spark, sf, "part").select(C("p_partkey").alias("id"), pick(_names, f"p_partkey % {len(_names)}").alias("name"), pick(_encs, f"(p_partkey div {len(_names)}) % {len(_encs)}").alias("enc"))
    return p.select("id", D.tile_format(C("name"), C("enc")).alias("f")).select("id", "f.*")


@query("""WITH i AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN ' ' || n_nationkey || ' ' WHEN n_nationkey % 3 = 1 THEN 'x' END AS minzoom, CASE WHEN n_nationkey % 4 = 0 THEN '1,2,3' WHEN n_nationkey % 4 = 1 THEN '10, 20,30.5,-40' ELSE '1,2,x,4' END AS bounds FROM nation)
SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id AS BIGINT) ELSE 0 END AS minzoom, CASE WHEN id % 4 = 1 THEN '10.0|20.0|30.5|-40.0' END AS bounds FROM i""")
def tilejson_fields(spark: SparkSession, sf: str) -> DataFrame:
    n = C("n_nationkey")
    i = I.table(spark, sf, "nation").select(
        n.alias("id"),
        F.when(n % 3 == 0, F.concat(F.lit(" "), n.cast("string"), F.lit(" "))).when(n % 3 == 1, "x").alias("minzoom"),
        F.when(n % 4 == 0, "1,2,3").when(n % 4 == 1, "10, 20,30.5,-40").otherwise("1,2,x,4").alias("bounds"),
    )
    return i.select("id", D.whole_number(C("minzoom"), 0).alias("minzoom"), F.array_join(D.number_list(C("bounds"), 4).cast("array<string>"), "|").alias("bounds"))


@query("""WITH i AS (SELECT o_orderkey AS id, CASE CAST(o_orderkey % 6 AS INTEGER) WHEN 0 THEN ' ' || o_orderkey || 'm' WHEN 1 THEN o_orderkey || ' km ' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN '-5m' WHEN 4 THEN 'far' ELSE '' END AS t FROM orders)
SELECT id, CASE CAST(id % 6 AS INTEGER) WHEN 0 THEN CAST(id AS DOUBLE) WHEN 1 THEN CAST(id AS DOUBLE) * 1000 WHEN 2 THEN CAST(id AS DOUBLE) WHEN 5 THEN 0.0::DOUBLE END AS metres FROM i""")
def parse_distance(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("CASE o_orderkey % 6 WHEN 0 THEN ' ' || o_orderkey || 'm' WHEN 1 THEN o_orderkey || ' km ' WHEN 2 THEN CAST(o_orderkey AS STRING) WHEN 3 THEN '-5m' WHEN 4 THEN 'far' ELSE '' END")
    return I.table(spark, sf, "orders").select(C("o_orderkey").alias("id"), X.distance_metres(t).alias("metres"))


@query("SELECT o_orderkey AS id, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS whole, CASE WHEN o_totalprice = floor(o_totalprice) THEN 1 ELSE 0 END AS is_whole FROM orders")
def stringify_numbers(spark: SparkSession, sf: str) -> DataFrame:
    o = I.table(spark, sf, "orders")
    return o.select(C("o_orderkey").alias("id"), X.as_text(F.round("o_totalprice")).alias("whole"), F.when(~X.as_text(C("o_totalprice")).contains("."), 1).otherwise(0).alias("is_whole"))


@query("SELECT c_nationkey AS nation, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def sorted_unique_values(spark: SparkSession, sf: str) -> DataFrame:
    v = F.collect_list(F.when(C("c_mktsegment") == "BUILDING", "").otherwise(C("c_mktsegment")))
    return I.table(spark, sf, "customer").groupBy(C("c_nationkey").alias("nation")).agg(v.alias("v")).select("nation", X.list_cell(X.sorted_unique(C("v"))).alias("segments"))


@query("SELECT n_nationkey AS id, CAST(n_nationkey AS DOUBLE) AS lon, printf('%.6f,%.6f', CAST(n_nationkey AS DOUBLE), n_nationkey / 3) AS bounds FROM nation")
def metadata_bounds_text(spark: SparkSession, sf: str) -> DataFrame:
    n = C("n_nationkey")
    return I.table(spark, sf, "nation").select(n.alias("id"), n.cast("double").alias("lon"), F.format_string("%.6f,%.6f", n.cast("double"), n / 3).alias("bounds"))
