"""Queries on tile arithmetic and tile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import tiles as T
from tilewright.operators import tileset
from tilewright.plans import inputs as I
from tilewright.plans.registry import query

C = F.col


@query(f"WITH {I.POINTS} SELECT id, {I.sql_x('lon', '14')} AS x, {I.sql_y('lat', '14')} AS y FROM pts")
def tile_assign_z14(spark: SparkSession, sf: str) -> DataFrame:
    z = F.lit(14)
    return I.points(spark, sf).select("id", T.tile_x(C("lon"), z).alias("x"), T.tile_y(C("lat"), z).alias("y"))


@query(f"WITH {I.POINTS} SELECT 8 AS z, {I.sql_x('lon', '8')} AS x, 255 - {I.sql_y('lat', '8')} AS y, count(*) AS n FROM pts GROUP BY ALL")
def tile_counts_z8_tms(spark: SparkSession, sf: str) -> DataFrame:
    z = F.lit(8)
    keyed = I.points(spark, sf).select(z.alias("z"), T.tile_x(C("lon"), z).alias("x"), T.flip_row(T.tile_y(C("lat"), z), z).alias("y"))
    return keyed.groupBy("z", "x", "y").agg(F.count("*").alias("n")).orderBy("z", "x", "y")


@query(f"""WITH {I.POINTS}, k AS (SELECT id, id % 15 AS z, lon, lat FROM pts), t AS (SELECT id, z, {I.sql_y('lat', 'z')} AS y FROM k)
SELECT id, CAST(z AS INTEGER) AS z, y, (1::BIGINT << z) - 1 - y AS tms_y, (1::BIGINT << z) - 1 - ((1::BIGINT << z) - 1 - y) AS back FROM t""")
def xyz_tms_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    z = C("z")
    k = I.points(spark, sf).withColumn("z", (C("id") % 15).cast("int")).withColumn("y", T.tile_y(C("lat"), z))
    return k.withColumn("tms_y", T.flip_row(C("y"), z)).select("id", "z", "y", "tms_y", T.flip_row(C("tms_y"), z).alias("back"))


@query(f"""WITH {I.POINTS}, t AS (SELECT *, {I.sql_x('lon', '10')} AS x, {I.sql_y('lat', '10')} AS y FROM pts)
SELECT id, x, y, CAST(round(((lon + 180) / 360 * pow(2.0, 10) - x) * 4096) AS BIGINT) AS px, CAST(round(({I.sql_merc('lat', '10')} - y) * 4096) AS BIGINT) AS py FROM t""")
def tile_pixel_project(spark: SparkSession, sf: str) -> DataFrame:
    z = F.lit(10)
    t = I.points(spark, sf).withColumn("x", T.tile_x(C("lon"), z)).withColumn("y", T.tile_y(C("lat"), z))
    return t.select("id", "x", "y", T.pixel_x(C("lon"), z, C("x")).alias("px"), T.pixel_y(C("lat"), z, C("y")).alias("py"))


_polar = "CAST((o_orderkey * 104729) % 1800000 AS DOUBLE) / 10000 - 90"


@query(f"""SELECT o_orderkey AS id, {I.sql_y(_polar, '20')} AS y_build, {I.sql_y(_polar, '20', 85.0511287798066)} AS y_route FROM orders""")
def mercator_clamp_variants(spark: SparkSession, sf: str) -> DataFrame:
    lat = F.expr("(o_orderkey * 104729) % 1800000").cast("double") / 10000 - 90
    o, z = I.table(spark, sf, "orders"), F.lit(20)
    return o.select(C("o_orderkey").alias("id"), T.tile_y(lat, z).alias("y_build"), T.tile_y(lat, z, T.ROUTE_LATITUDE_LIMIT).alias("y_route"))


_hilbert_tiles = f"{I.POINTS}, t AS (SELECT id, CAST(id % 15 AS INTEGER) AS z, {I.sql_x('lon', '(id % 15)')} AS x, {I.sql_y('lat', '(id % 15)')} AS y FROM pts)"


def _hilbert_input(spark: SparkSession, sf: str) -> DataFrame:
    z = C("z")
    return I.points(spark, sf).withColumn("z", (C("id") % 15).cast("int")).select("id", "z", T.tile_x(C("lon"), z).alias("x"), T.tile_y(C("lat"), z).alias("y"))


_hilbert_sql = f"""WITH RECURSIVE {_hilbert_tiles},
h AS (SELECT id, z, x, y, z - 1 AS a, x AS hx, y AS hy, ((1::BIGINT << (2 * z)) - 1) // 3 AS d FROM t
  UNION ALL SELECT id, z, x, y, a - 1,
    CASE WHEN hy & (1::BIGINT << a) <> 0 THEN hx & ((1::BIGINT << a) - 1) WHEN hx & (1::BIGINT << a) <> 0 THEN (1::BIGINT << a) - 1 - (hy & ((1::BIGINT << a) - 1)) ELSE hy & ((1::BIGINT << a) - 1) END,
    CASE WHEN hy & (1::BIGINT << a) <> 0 THEN hy & ((1::BIGINT << a) - 1) WHEN hx & (1::BIGINT << a) <> 0 THEN (1::BIGINT << a) - 1 - (hx & ((1::BIGINT << a) - 1)) ELSE hx & ((1::BIGINT << a) - 1) END,
    d + (1::BIGINT << (2 * a)) * CASE WHEN hx & (1::BIGINT << a) <> 0 THEN CASE WHEN hy & (1::BIGINT << a) <> 0 THEN 2 ELSE 3 END ELSE CASE WHEN hy & (1::BIGINT << a) <> 0 THEN 1 ELSE 0 END END
  FROM h WHERE a >= 0)"""


@query(_hilbert_sql + " SELECT id, z, x, y, d AS tile_id FROM h WHERE a = -1")
def hilbert_id_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _hilbert_input(spark, sf).withColumn("tile_id", T.hilbert_id(C("z"), C("x"), C("y")))


@query(f"WITH {_hilbert_tiles} SELECT id, z, x, y FROM t")
def hilbert_id_inverse(spark: SparkSession, sf: str) -> DataFrame:
    there = _hilbert_input(spark, sf).select("id", T.hilbert_id(C("z"), C("x"), C("y")).alias("tile_id"))
    return there.select("id", T.hilbert_xy(C("tile_id")).alias("k")).select("id", "k.z", "k.x", "k.y")


@query(f"WITH {I.TILES} SELECT z, x, y, octet_length(data) AS size, sha256(data) AS sha FROM tiles WHERE x BETWEEN 100 AND 299 AND y BETWEEN 0 AND 1")
def range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.in_range(I.tiles(spark, sf), 13, 100, 299, 0, 1).select("z", "x", "y", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha"))


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    n = C("n_nationkey").cast("long")
    return I.table(spark, sf, "nation").select(n.alias("range_id"), (5 + n % 3).cast("int").alias("z"), n.alias("x_min"), (n + n % 7).alias("x_max"), (n % 5).alias("y_min"), (n % 5 + n % 4).alias("y_max"))


_ranges_sql = """r AS (SELECT CAST(n_nationkey AS BIGINT) AS range_id, CAST(5 + n_nationkey % 3 AS INTEGER) AS z, CAST(n_nationkey AS BIGINT) AS x_min,
  CAST(n_nationkey + n_nationkey % 7 AS BIGINT) AS x_max, CAST(n_nationkey % 5 AS BIGINT) AS y_min, CAST(n_nationkey % 5 + n_nationkey % 4 AS BIGINT) AS y_max FROM nation)"""


@query(f"""WITH {_ranges_sql}, e AS (SELECT range_id, z, x, unnest(range(y_min, y_max + 1)) AS y FROM (SELECT *, unnest(range(x_min, x_max + 1)) AS x FROM r))
SELECT z, x, y, count(*) AS n FROM e GROUP BY ALL""")
def range_expand_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.expand_ranges(_ranges(spark, sf)).groupBy("z", "x", "y").agg(F.count("*").alias("n"))


@query(f"WITH {_ranges_sql} SELECT count(*) AS ranges, CAST(sum((x_max - x_min + 1) * (y_max - y_min + 1)) AS BIGINT) AS total FROM r")
def range_request_total(spark: SparkSession, sf: str) -> DataFrame:
    size = T.range_size(C("x_min"), C("x_max"), C("y_min"), C("y_max"))
    return _ranges(spark, sf).agg(F.count("*").alias("ranges"), F.sum(size).alias("total"))


@query(f"""WITH {I.TILES}, k AS (SELECT 13 AS z, (c_custkey * 7) % 2048 AS x, 0::BIGINT AS y, c_custkey FROM customer)
SELECT c_custkey, k.x, data IS NOT NULL AS found, octet_length(data) AS size FROM k LEFT JOIN tiles USING (z, x, y)""")
def point_lookup_batch(spark: SparkSession, sf: str) -> DataFrame:
    keys = I.table(spark, sf, "customer").select("c_custkey", F.lit(13).alias("z"), (C("c_custkey") * 7 % 2048).alias("x"), F.expr("0L").alias("y"))
    return tileset.lookup(I.tiles(spark, sf), keys).select("c_custkey", "x", C("data").isNotNull().alias("found"), F.octet_length("data").cast("long").alias("size"))


@query(f"""WITH {_ranges_sql} SELECT a.range_id AS a, b.range_id AS b FROM r a JOIN r b ON a.range_id < b.range_id AND a.z = b.z
AND a.x_min <= b.x_max AND b.x_min <= a.x_max AND a.y_min <= b.y_max AND b.y_min <= a.y_max""")
def range_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from tilewright.operators import spatial

    r = _ranges(spark, sf)
    boxes = r.select(C("range_id").alias("id"), "z", C("x_min").alias("min_x"), C("x_max").alias("max_x"), C("y_min").alias("min_y"), C("y_max").alias("max_y"))
    return spatial.overlapping_pairs(boxes, cell=8.0, touching=True, by=["z"])


_paths_sql = """p AS (SELECT o_orderkey AS id, CASE CAST(o_orderkey % 9 AS INTEGER)
 WHEN 0 THEN '/5/' || o_orderkey % 32 || '/' || o_orderkey % 31 WHEN 1 THEN '5/' || o_orderkey % 40 || '/3.mvt' WHEN 2 THEN '2/./1/1' WHEN 3 THEN o_orderkey % 35 || '/0/0.mvt'
 WHEN 4 THEN '3/' || o_orderkey % 8 || '/' || o_orderkey % 8 || '.png' WHEN 5 THEN '1/2' WHEN 6 THEN '-1/0/0' WHEN 7 THEN '30/' || o_orderkey * 65536 || '/1' ELSE '4/1/2/3' END AS path FROM orders)"""


@query(f"""WITH {_paths_sql}, m AS (SELECT id, path, regexp_extract(path, '^/?([0-9]+)/([0-9]+)/([0-9]+)(\\.mvt)?$', ['a', 'b', 'c']) AS g FROM p),
v AS (SELECT id, path, TRY_CAST(g.a AS BIGINT) AS z, TRY_CAST(g.b AS BIGINT) AS x, TRY_CAST(g.c AS BIGINT) AS y FROM m)
SELECT id, path, CASE WHEN ok THEN z END AS z, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM (SELECT *, coalesce(z <= 30 AND x < CAST(pow(2, z) AS BIGINT) AND y < CAST(pow(2, z) AS BIGINT), false) AS ok FROM v)""")
def xyz_path_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey")
    paths = F.expr(
        """CASE o_orderkey % 9 WHEN 0 THEN '/5/' || o_orderkey % 32 || '/' || o_orderkey % 31 WHEN 1 THEN '5/' || o_orderkey % 40 || '/3.mvt' WHEN 2 THEN '2/./1/1' WHEN 3 THEN o_orderkey % 35 || '/0/0.mvt'
 WHEN 4 THEN '3/' || o_orderkey % 8 || '/' || o_orderkey % 8 || '.png' WHEN 5 THEN '1/2' WHEN 6 THEN '-1/0/0' WHEN 7 THEN '30/' || o_orderkey * 65536 || '/1' ELSE '4/1/2/3' END"""
    )
    p = I.table(spark, sf, "orders").select(k.alias("id"), paths.alias("path"))
    return p.withColumn("k", T.parse_xyz_path(C("path"))).select("id", "path", "k.z", "k.x", "k.y")


@query("""SELECT o_orderkey AS id, z, x, y, z >= 0 AND z <= 30 AND x >= 0 AND y >= 0 AND x < (1::BIGINT << greatest(0, least(z, 30))) AND y < (1::BIGINT << greatest(0, least(z, 30))) AS valid
FROM (SELECT o_orderkey, CAST(o_orderkey % 34 - 2 AS BIGINT) AS z, o_orderkey % 70 - 3 AS x, o_orderkey % 50 - 1 AS y FROM orders)""")
def key_validation(spark: SparkSession, sf: str) -> DataFrame:
    o = I.table(spark, sf, "orders").select(C("o_orderkey").alias("id"), (C("o_orderkey") % 34 - 2).alias("z"), (C("o_orderkey") % 70 - 3).alias("x"), (C("o_orderkey") % 50 - 1).alias("y"))
    return o.withColumn("valid", T.valid_key(C("z"), C("x"), C("y")))


_ids_sql = f"""{I.TILES}, first AS (SELECT data, min({{'z': z, 'x': x, 'y': y}}) AS place FROM tiles GROUP BY data),
ids AS (SELECT data, lower(to_base(row_number() OVER (ORDER BY place) - 1, 36)) AS tile_id FROM first)"""


@query(f"WITH {_ids_sql} SELECT z, x, y, tile_id FROM tiles JOIN ids USING (data)")
def dedup_content_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.content_ids(I.tiles(spark, sf))[1]


@query(f"""WITH {I.TILES}, u AS (SELECT count(*) AS n, octet_length(data) AS size FROM tiles GROUP BY data)
SELECT CAST(sum(n) AS BIGINT) AS tiles, count(*) AS unique_tiles, CAST(sum(n - 1) AS BIGINT) AS reused_tiles, CAST(sum(n * size) AS BIGINT) AS payload_bytes, CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum((n - 1) * size) AS BIGINT) AS duplicate_bytes FROM u""")
def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.dedup_stats(I.tiles(spark, sf))


@query(f"WITH {I.TILES} SELECT count(*) AS n_map, count(DISTINCT data) AS n_unique, CASE WHEN count(*) = count(DISTINCT data) THEN 'flat' ELSE 'normalized' END AS layout FROM tiles")
def schema_auto_choice(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.layout_choice(tileset.content_ids(I.tiles(spark, sf))[1])


@query(f"WITH {I.TILES} SELECT z, x, y, sha256(data) AS sha FROM tiles")
def flat_from_normalized(spark: SparkSession, sf: str) -> DataFrame:
    images, keyed = tileset.content_ids(I.tiles(spark, sf))
    return tileset.flat(keyed, images).select("z", "x", "y", F.sha2("data", 256).alias("sha"))


@query(f"WITH {_ids_sql} SELECT z, x, y, tile_id FROM tiles JOIN ids USING (data) WHERE tile_id LIKE '%z'")
def dangling_images(spark: SparkSession, sf: str) -> DataFrame:
    images, keyed = tileset.content_ids(I.tiles(spark, sf))
    return tileset.dangling(keyed, images.filter(~C("tile_id").endswith("z")))


_be64 = "lpad(hex(CAST({0} AS BIGINT)), 16, '0')"


@query(f"""WITH {I.TILES} SELECT count(*) AS n_tiles, sha256(unhex(string_agg({_be64.format('z')} || {_be64.format('x')} || {_be64.format('y')} || {_be64.format('octet_length(data)')} || hex(data), '' ORDER BY z, x, y))) AS sha256 FROM tiles""")
def tile_digest(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.tile_digest(I.tiles(spark, sf))


@query("""WITH m AS (SELECT n_name AS name, 'nation ' || n_nationkey AS value FROM nation)
SELECT sha256(unhex(string_agg(lpad(hex(octet_length(encode(name))), 8, '0') || hex(encode(name)) || lpad(hex(octet_length(encode(value))), 8, '0') || hex(encode(value)), '' ORDER BY name))) AS sha256 FROM m""")
def metadata_digest(spark: SparkSession, sf: str) -> DataFrame:
    m = I.table(spark, sf, "nation").select(C("n_name").alias("name"), F.concat(F.lit("nation "), "n_nationkey").alias("value"))
    return tileset.metadata_digest(m)


@query(f"""WITH {I.TILES}, b AS (SELECT z, x, y, CASE WHEN x % 31 = 0 THEN encode('changed') ELSE data END AS data FROM tiles WHERE x % 29 <> 0 UNION ALL SELECT 13, x, 5000::BIGINT, data FROM tiles WHERE x % 37 = 0)
SELECT z, x, y, CASE WHEN b.data IS NULL THEN 'missing' WHEN a.data IS NULL THEN 'extra' ELSE 'changed' END AS kind FROM tiles a FULL JOIN b USING (z, x, y) WHERE a.data IS DISTINCT FROM b.data""")
def parity_diff(spark: SparkSession, sf: str) -> DataFrame:
    t = I.tiles(spark, sf)
    changed = t.filter("x % 29 <> 0").withColumn("data", F.when(C("x") % 31 == 0, F.lit("changed").cast("binary")).otherwise(C("data")))
    return tileset.parity(t, changed.unionByName(t.filter("x % 37 = 0").withColumn("y", F.expr("5000L"))))


@query(f"WITH {I.TILES} SELECT z, x, y, sha256(data) AS checksum FROM tiles")
def tile_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return I.tiles(spark, sf).select("z", "x", "y", F.sha2("data", 256).alias("checksum"))


@query(f"WITH {I.TILES} SELECT x, y, 'tile:' || sha256('berlin') || ':' || sha256('rev ' || x % 3) || ':' || z || '/' || x || '/' || y AS cache_key FROM tiles")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    revision = F.concat(F.lit("rev "), (C("x") % 3).cast("string"))
    return I.tiles(spark, sf).select("x", "y", T.cache_key(F.lit("berlin"), revision, C("z"), C("x"), C("y")).alias("cache_key"))


@query(f"WITH {I.TILES} SELECT x, y, '\"' || sha256('r') || ':xyz:' || z || '/' || x || '/' || (8191 - y) || '\"' AS etag FROM tiles")
def etags(spark: SparkSession, sf: str) -> DataFrame:
    revision = F.sha2(F.lit("r").cast("binary"), 256)
    return I.tiles(spark, sf).select("x", "y", T.etag(revision, "xyz", C("z"), C("x"), T.flip_row(C("y"), C("z"))).alias("etag"))


@query(f"WITH {I.TILES} SELECT x, y, 'https://t.example/r%20' || x % 3 || '/' || z || '/' || x || '/' || y || '.mvt' AS url FROM tiles")
def tile_urls(spark: SparkSession, sf: str) -> DataFrame:
    revision = F.concat(F.lit("r "), (C("x") % 3).cast("string"))
    return I.tiles(spark, sf).select("x", "y", T.tile_url("https://t.example/{revision}/{z}/{x}/{y}.mvt", revision, C("z"), C("x"), C("y")).alias("url"))


@query(f"""WITH s AS (SELECT max(octet_length(encode(text))) AS largest FROM documents), m AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) * 16777216 AS memory FROM nation)
SELECT id, memory, CASE WHEN memory <= 2097152 OR (memory - 2097152) // (greatest(largest * 8, 16384) + 768) < 1 THEN 1000 ELSE least((memory - 2097152) // (greatest(largest * 8, 16384) + 768), 8192) END AS batch,
CASE WHEN memory <= 2097152 THEN 1 ELSE greatest(1, least((memory - 2097152) // (largest + 768), 8192)) END AS stream_batch,
CASE WHEN memory <= 2097152 THEN 1 ELSE least(500, greatest(1, least((memory - 2097152) // (largest + 768), 8192))) END AS lowered FROM s, m""")
def batch_size_auto(spark: SparkSession, sf: str) -> DataFrame:
    largest = tileset.stream_stats(I.tiles(spark, sf)).first().largest
    m = I.table(spark, sf, "nation").select(C("n_nationkey").cast("long").alias("id"), (C("n_nationkey").cast("long") * 16777216).alias("memory"))
    big = F.lit(largest).cast("long")
    return m.select("id", "memory", tileset.auto_batch(big, C("memory")).alias("batch"), tileset.stream_batch(F.lit(0), big, C("memory")).alias("stream_batch"), tileset.stream_batch(F.lit(500), big, C("memory")).alias("lowered"))


@query(f"WITH {I.TILES} SELECT CAST(max(octet_length(data)) AS BIGINT) AS largest FROM (SELECT * FROM tiles ORDER BY z, x, y LIMIT 300)")
def sampled_largest(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.sampled_largest(I.tiles(spark, sf), 300)


_leaf = "sha256(unhex(lpad(hex(CAST(z AS BIGINT)), 16, '0') || lpad(hex(x), 16, '0') || lpad(hex(y), 16, '0') || sha256(data)))"


@query(f"""WITH {I.TILES}, n AS (SELECT z, x // 64 AS bx, y // 64 AS by_, sha256(string_agg({_leaf}, '' ORDER BY x, y)) AS node FROM tiles GROUP BY ALL),
c AS (SELECT z, bx, sha256(string_agg(node, '' ORDER BY by_)) AS node FROM n GROUP BY ALL) SELECT z, sha256(string_agg(node, '' ORDER BY bx)) AS sha256 FROM c GROUP BY z""")
def tree_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of the tile set by blocks, the parallel form."""
    return tileset.tree_digest(I.tiles(spark, sf))


@query(f"WITH {I.TILES} SELECT count(*) AS tiles, CAST(sum(octet_length(data)) AS BIGINT) AS bytes, CAST(max(octet_length(data)) AS BIGINT) AS largest FROM tiles")
def stream_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tileset.stream_stats(I.tiles(spark, sf))
