"""Queries that go through files: written from the driver's tables in the shared
folder, then read by the formats under test; and kernels run over tables.

Executors write the files part by part and read them again; the driver puts no
rows through.  Mapping tables alone, which are small text, are written by it.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import kernels as K
from tilewright.functions import text as X
from tilewright.functions import tiles as T
from tilewright.operators import osm, sync, tileset
from tilewright.operators import territory as R
from tilewright.operators.store import Manifest, TileStore
from tilewright.plans import inputs as I
from tilewright.plans.map_queries import _seg_in, _small_map
from tilewright.plans.registry import ORACLES, query
from tilewright.plans.territory_queries import _members, _members_df, _trim
from tilewright.shared import scratch
from tilewright.shipping import ship
from tilewright.sources import geojson, mbtiles, osmpbf, pmtiles, register, tilestream

C = F.col


def _file(spark: SparkSession, name: str) -> str:
    """A fresh local path in the shared folder, for formats that are one file."""
    stem, dot, ending = name.rpartition(".")
    path = f"{scratch(spark, stem)}{dot}{ending}".removeprefix("file://")
    if ":" in path.split("/")[0]:
        raise ValueError("single files need a shared folder that is mounted")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def _rows(df: DataFrame) -> Iterator[tuple]:
    return (tuple(r) for r in df.toLocalIterator())


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("z", "x", "y", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha"))


_tiles_sql = f"WITH {I.TILES} SELECT z, x, y, octet_length(data) AS size, sha256(data) AS sha FROM tiles"


def _mbtiles(spark: SparkSession, sf: str, normalized: bool) -> str:
    path = _file(spark, "t.mbtiles")
    meta = {r.n_name: f" {r.n_nationkey} " for r in I.table(spark, sf, "nation").collect()}
    mbtiles.write_set(I.tiles(spark, sf), path, meta, normalized)
    register(spark)
    return path


@query(_tiles_sql)
def mbtiles_flat_read(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(spark.read.format("mbtiles").load(_mbtiles(spark, sf, False)))


@query(_tiles_sql)
def mbtiles_normalized_read(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(spark.read.format("mbtiles").option("layout", "normalized").load(_mbtiles(spark, sf, True)))


@query(_tiles_sql + " WHERE z = 13 AND x >= 20 AND x <= 80 AND y = 0")
def mbtiles_pushdown(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(spark.read.format("mbtiles").load(_mbtiles(spark, sf, False)).filter("z = 13 and x >= 20 and x <= 80 and y = 0"))


@query("SELECT n_name AS name, ' ' || n_nationkey || ' ' AS value FROM nation")
def mbtiles_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.format("mbtiles").option("table", "metadata").load(_mbtiles(spark, sf, False))


def _pmtiles(spark: SparkSession, sf: str) -> str:
    path = _file(spark, "t.pmtiles")
    z = C("z")
    number = T.hilbert_id(z, C("x"), T.flip_row(C("y"), z))
    pmtiles.write_tiles(I.tiles(spark, sf).select(number.alias("number"), "data"), path, {"name": "documents"}, leaf_entries=64)
    register(spark)
    return path


@query(_tiles_sql)
def pmtiles_read(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(spark.read.format("pmtiles").load(_pmtiles(spark, sf)))


@query(f"WITH {I.TILES} SELECT count(*) AS tiles, CAST(sum(octet_length(data)) AS BIGINT) AS bytes, CAST(max(octet_length(data)) AS BIGINT) AS largest FROM tiles")
def pmtiles_inspect(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([pmtiles.inspect(_pmtiles(spark, sf))], "tiles long, bytes long, largest long")


@query("SELECT unnest(['maxzoom', 'minzoom', 'name', 'format']) AS name, unnest(['13', '13', 'documents', 'pbf']) AS value")
def pmtiles_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = pmtiles.metadata_rows(_pmtiles(spark, sf))
    return spark.createDataFrame([(k, rows[k]) for k in ("maxzoom", "minzoom", "name", "format")], "name string, value string")


@query(_tiles_sql)
def tilestream_read(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, "t.stream")
    tilestream.write_tiles(path, {"name": "documents"}, I.tiles(spark, sf))
    register(spark)
    return _hashed(spark.read.format("tilestream").load(path))


@query(_tiles_sql)
def import_published(spark: SparkSession, sf: str) -> DataFrame:
    """An archive imported as a published set, validated and read again."""
    from tilewright.operators import builds

    out = f"{_file(spark, 'set.tiles')}"
    builds.import_archive(spark, _pmtiles(spark, sf), out)
    tileset.inspect(spark, out)
    return _hashed(tileset.read_tiles(spark, out))


def _scaled(c: str) -> F.Column:
    return F.round(C(c) * 10000).cast("long").alias(c)


_scaled_sql = "CAST(round(lon * 10000) AS BIGINT) AS lon, CAST(round(lat * 10000) AS BIGINT) AS lat"


@query(f"WITH {I.NODES} SELECT CAST(input_idx AS INTEGER) AS input_idx, id, {_scaled_sql} FROM (SELECT input_idx, id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM nodes)")
def osmpbf_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of two files, one with dense blocks and one without."""
    paths = [_file(spark, f"{k}.pbf") for k in range(2)]
    for k, path in enumerate(paths):
        osmpbf.write_entities(I.nodes(spark, sf).filter(C("input_idx") == k), path, "nodes", dense=not k, compress=not k)
    register(spark)
    n = spark.read.format("osmpbf").option("entity", "nodes").load(",".join(paths))
    return n.select("input_idx", "id", _scaled("lon"), _scaled("lat"))


_tag_names = ["highway", "building", "natural", "waterway", "landuse", "name", "ref"]
_tags_sql = " || '&' || ".join(f"'{k}=' || " + (f'"{k}"' if k == "natural" else k) for k in sorted(_tag_names))


@query(f"""WITH {I.WAYS}, {I.TAGGED} SELECT id, string_agg(CAST(node AS VARCHAR), ',' ORDER BY pos) AS nodes, any_value({_tags_sql}) AS tags FROM refs JOIN tagged USING (id) GROUP BY id""")
def osmpbf_ways(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, "w.pbf")
    osmpbf.write_entities(I.ways(spark, sf).join(I.tagged(spark, sf).hint("merge"), "id"), path, "ways")
    register(spark)
    w = spark.read.format("osmpbf").option("entity", "ways").load(path)
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return w.select("id", F.array_join(C("node_ids").cast("array<string>"), ",").alias("nodes"), tags.alias("tags"))


@query("""SELECT CAST(c_nationkey AS BIGINT) AS id, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS code, string_agg(c_custkey % 3 || ':' || c_custkey || ':' || CASE WHEN c_custkey % 2 = 0 THEN 'outer' ELSE '' END, ',' ORDER BY c_custkey) AS members
FROM customer GROUP BY c_nationkey""")
def osmpbf_relations(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, "r.pbf")
    k = C("c_custkey")
    member = F.struct(k.alias("ref"), (k % 3).cast("int").alias("type"), F.when(k % 2 == 0, "outer").otherwise("").alias("role"))
    by = I.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(member)).alias("members"))
    tags = F.create_map(F.lit("boundary"), F.lit("postal_code"), F.lit("postal_code"), F.lpad(C("c_nationkey").cast("string"), 5, "0"))
    osmpbf.write_entities(by.select(C("c_nationkey").alias("id"), tags.alias("tags"), "members"), path, "relations")
    register(spark)
    r = spark.read.format("osmpbf").option("entity", "relations").load(path)
    members = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["type"].cast("string"), m["ref"].cast("string"), m["role"])), ",")
    return r.select("id", C("tags")["postal_code"].alias("code"), members.alias("members"))


@query(f"""WITH {I.FEATURES} SELECT ord, postcode, segment, rank, CASE WHEN whole THEN 5 ELSE 3 END::BIGINT AS points, CAST(gx AS DOUBLE) AS min_lon, CAST(gy AS DOUBLE) AS min_lat FROM features""")
def geojson_read(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, "f.geojson")
    f = I.features(spark, sf)
    geojson.write_features(f.select("ord", *(C("props")[c].alias(c) for c in ("postcode", "segment", "rank")), "geometry"), path, "ord")
    got = geojson.read_features(spark, path)
    ring = F.get(F.get("geometry", F.lit(0)), F.lit(0))
    first = F.get(ring, F.lit(0))
    p = lambda c: C("props")[c]
    return got.select(p("ord").cast("long").alias("ord"), *(p(c).alias(c) for c in ("postcode", "segment", "rank")), F.size(ring).cast("long").alias("points"), first["lon"].alias("min_lon"), first["lat"].alias("min_lat"))


_mapping_sql = f"WITH {I.MAPPING} SELECT {', '.join(f'{_trim.format(c)} AS {c}' for c in ('postcode', 'territory', 'employee', 'amount'))} FROM mapping"


def _mapping_cells(spark: SparkSession, sf: str) -> DataFrame:
    return I.mapping(spark, sf).select("postcode", "territory", "employee", "amount")


@query(_mapping_sql)
def mapping_csv_read(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, "m.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["postcode", "territory", "employee", "amount"])
        w.writerows(_rows(_mapping_cells(spark, sf)))
    return geojson.read_mapping(spark, path).drop("ord")


@query(_mapping_sql)
def mapping_json_read(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, "m.json")
    with open(path, "w") as f:
        json.dump([r.asDict() for r in _mapping_cells(spark, sf).toLocalIterator()], f)
    return geojson.read_mapping(spark, path).select("postcode", "territory", "employee", "amount")


@query(f"WITH {I.POINTS}, k AS (SELECT DISTINCT 7 AS z, {I.sql_x('lon', '7')} AS x, 127 - {I.sql_y('lat', '7')} AS y FROM pts) SELECT z, x, y, sha256(encode(z || '/' || x || '/' || y)) AS checksum FROM k")
def store_synchronise(spark: SparkSession, sf: str) -> DataFrame:
    """A synchronisation into an empty store, twice; what the store then holds."""
    z = F.lit(7)
    keys = I.points(spark, sf).select(z.alias("z"), T.tile_x(C("lon"), z).alias("x"), T.flip_row(T.tile_y(C("lat"), z), z).alias("y")).distinct()
    store = TileStore(spark, scratch(spark, "store"))
    none = spark.createDataFrame([], "z int, x_min long, x_max long, y_min long, y_max long")
    manifest = Manifest("orders", "r1", "/{z}/{x}/{y}")
    for changed in (True, False):
        got = store.synchronise(manifest, keys, none, lambda z, x, y: f"{z}/{x}/{y}".encode())
        if got.changed != changed or (got.reused if changed else got.downloaded):
            raise ValueError("the second run must reuse what the first one stored")
    return store.tiles("orders", "r1").select("z", "x", "y", "checksum")


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 33 - 1 AS z, o_orderkey % 50 - 2 AS x_min, o_orderkey % 61 - 3 AS x_max, o_orderkey % 40 - 1 AS y_min, o_orderkey % 71 AS y_max FROM orders)
SELECT id, CASE WHEN z < 0 OR z > 30 THEN 'zoom' WHEN x_min < 0 OR x_min > x_max THEN 'columns' WHEN y_min < 0 OR y_min > y_max THEN 'rows' WHEN x_max >= pow(2, z) OR y_max >= pow(2, z) THEN 'outside the zoom' END AS problem FROM r""")
def range_validation(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey")
    r = I.table(spark, sf, "orders").select(k.alias("id"), (k % 33 - 1).alias("z"), (k % 50 - 2).alias("x_min"), (k % 61 - 3).alias("x_max"), (k % 40 - 1).alias("y_min"), (k % 71).alias("y_max"))
    return r.select("id", sync.range_problem().alias("problem"))


_amount = "CASE WHEN regexp_full_match(amount, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(amount AS DOUBLE) END"


@query(f"""WITH {_members} SELECT grp AS territory_id, count(*) AS source_feature_count, string_agg(DISTINCT employee, '|' ORDER BY employee) FILTER (employee <> '') AS employee, sum({_amount}) AS amount,
CAST(min(gx) AS DOUBLE) AS min_lon, CAST(max(gx) + 1 AS DOUBLE) AS max_lon FROM members JOIN (SELECT ord, gx FROM squares) USING (ord) GROUP BY 1""")
def territory_build_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Whole territories: fields, and the extent of the dissolved outline."""
    from tilewright.operators.spatial import bounds_columns

    t = R.build(_members_df(spark, sf), {"employee": "unique", "amount": "sum"})
    b = t.select("territory_id", "source_feature_count", X.list_cell(C("employee")).alias("employee"), "amount", *bounds_columns(C("geometry")))
    return b.drop("min_lat", "max_lat")


@query(f"WITH {_members} SELECT grp AS territory_id, count(*) AS source_feature_count, count(DISTINCT rank) AS rank FROM members GROUP BY 1")
def territory_report(spark: SparkSession, sf: str) -> DataFrame:
    """The form for reports: a discarded field and the list of keys are left out."""
    return R.for_report(R.summaries(_members_df(spark, sf), {"employee": "discard", "rank": "count"}))


@query(f"WITH {I.FEATURES}, {I.MAPPING} SELECT (SELECT count(*) FROM features WHERE postcode = '') + (SELECT count(*) FROM features f JOIN mapping m ON lower({_trim.format('f.postcode')}) = lower({_trim.format('m.postcode')}) WHERE whole AND f.postcode <> '' AND {_trim.format('territory')} = '') AS empty_group_keys")
def territory_empty_groups(spark: SparkSession, sf: str) -> DataFrame:
    return R.empty_groups(I.features(spark, sf), "postcode", I.mapping(spark, sf), "postcode", "territory")


@query(f"WITH {I.FEATURES} SELECT row_number() OVER (ORDER BY ord) - 1 AS arc, ord AS territory_id, 0 AS polygon, 0 AS ring, CASE WHEN whole THEN 5 ELSE 3 END AS points FROM features")
def topojson_arcs(spark: SparkSession, sf: str) -> DataFrame:
    t = I.features(spark, sf).select(C("ord").alias("territory_id"), "geometry")
    return R.topojson_arcs(t).select("arc", "territory_id", "polygon", "ring", F.size("points").alias("points"))


@query(f"WITH {I.NODES} SELECT input_idx, id FROM nodes WHERE lon BETWEEN -170 AND -60.5 AND lat BETWEEN -50 AND 44.25")
def nodes_in_box(spark: SparkSession, sf: str) -> DataFrame:
    return osm.in_area(I.nodes(spark, sf), bbox=(-170.0, -50.0, -60.5, 44.25)).select("input_idx", "id")


@query(f"""WITH {I.NODES}, r AS (SELECT *, radians(lon) AS a, radians(lat) AS b, radians(-111.5) AS c, radians(18.25) AS d FROM nodes)
SELECT input_idx, id FROM r WHERE asin(sqrt(pow(sin((b - d) / 2), 2) + cos(d) * cos(b) * pow(sin((a - c) / 2), 2))) * 2 * 6371.0088 <= 5500""")
def nodes_in_circle(spark: SparkSession, sf: str) -> DataFrame:
    return osm.in_area(I.nodes(spark, sf), centre=(-111.5, 18.25), radius_km=5500.0).select("input_idx", "id")


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS code, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, 1 AS rings, 5 AS points FROM customer""")
def postal_areas(spark: SparkSession, sf: str) -> DataFrame:
    """A square area for each customer, from a relation of three ways, one of
    them turned; areas without a name have none."""
    k = C("c_custkey")
    c = I.table(spark, sf, "customer").select(k.alias("id"), "c_name", F.lit(0).alias("input_idx"))
    node = lambda i: C("id") * 10 + i
    corner = F.explode(F.array(*(F.struct(node(i).alias("id"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, (x, y) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))))))
    nodes = c.select("input_idx", corner.alias("n"), C("id").alias("k")).select("input_idx", "n.id", (C("k") % 300 / 10 + C("n.dx")).alias("lon"), (F.expr("k div 300") / 10 + C("n.dy")).alias("lat"))
    parts = ([0, 1, 2], [3, 2], [3, 0])
    way = F.explode(F.array(*(F.struct(node(i).alias("id"), F.array(*map(node, p)).alias("node_ids")) for i, p in enumerate(parts))))
    ways = c.select("input_idx", way.alias("w")).select("input_idx", "w.id", "w.node_ids")
    tags = F.create_map(F.lit("boundary"), F.lit("postal_code"), F.lit("postal_code"), F.lpad(C("id").cast("string"), 5, "0"), F.lit("name"), F.when(C("id") % 3 == 0, C("c_name")).otherwise(" "))
    members = F.array(*(F.struct(F.lit(1).alias("type"), node(i).alias("ref"), F.lit("outer").alias("role")) for i in (1, 0, 2)))
    f = osm.postal_features(c.select("input_idx", "id", tags.alias("tags"), members.alias("members")), ways, nodes)
    return f.select(C("props")["postcode"].alias("code"), C("props")["name"].alias("name"), F.size("rings").alias("rings"), F.size(F.get("rings", F.lit(0))["points"]).alias("points"))


def _mapped(df: DataFrame, schema: str, row) -> DataFrame:
    """A plain-Python kernel over the rows of a table, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for x in (row(*r) for r in zip(*(c.to_pylist() for c in b.columns))) if x is not None]
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=names)

    ship(df.sparkSession)
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return df.mapInArrow(run, schema)


def _clip(i: int, ax: int, ay: int, bx: int, by: int) -> tuple | None:
    found = K.clip_segment((ax, ay), (bx, by))
    return (i, *found[0], *found[1]) if found else None


@query(ORACLES["clip_segments"])
def clip_segments_kernel(spark: SparkSession, sf: str) -> DataFrame:
    """The clipping kernel of the vector tiles over the same segments."""
    k = C("o_orderkey")
    at = lambda f: ((k * f) % 6000 - 1000).cast("long")
    return _mapped(I.table(spark, sf, "orders").select(k, at(7919), at(104729), at(31), at(57)), "id long, x0 long, y0 long, x1 long, y1 long", _clip)


@query(f"""WITH s AS (SELECT o_orderkey AS id, {_seg_in} FROM orders) SELECT id, CASE WHEN abs(CAST(ax AS DOUBLE) * "by" - CAST(bx AS DOUBLE) * ay) / 2 > 400000 THEN 3 ELSE 2 END::BIGINT AS points FROM s""")
def simplify_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of three points: the middle one goes where its triangle is small."""
    k = C("o_orderkey")
    at = lambda f: ((k * f) % 6000 - 1000).cast("long")
    rows = I.table(spark, sf, "orders").select(k, at(7919), at(104729), at(31), at(57))
    return _mapped(rows, "id long, points long", lambda i, ax, ay, bx, by: (i, len(K.visvalingam([(0, 0), (ax, ay), (bx, by)], 400000, False))))


_zz = "CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END"


@query(f"""WITH a AS (SELECT o_orderkey AS id, (o_orderkey * 7919) % 30000 - 15000 AS v FROM orders), z AS (SELECT id, {_zz} AS n FROM a)
SELECT id, lower(CASE WHEN n < 128 THEN lpad(hex(n), 2, '0') WHEN n < 16384 THEN lpad(hex(n % 128 + 128), 2, '0') || lpad(hex(n // 128), 2, '0') ELSE lpad(hex(n % 128 + 128), 2, '0') || lpad(hex(n // 128 % 128 + 128), 2, '0') || lpad(hex(n // 16384), 2, '0') END) AS coded FROM z""")
def varint_zigzag(spark: SparkSession, sf: str) -> DataFrame:
    o = I.table(spark, sf, "orders").select(C("o_orderkey").alias("id"), ((C("o_orderkey") * 7919) % 30000 - 15000).alias("v"))
    return _mapped(o, "id long, coded string", lambda i, v: (i, K.varint(K._zigzag(v)).hex()))


@query(f"WITH {I.TILES} SELECT x, y, sha256(data) AS sha, true AS same FROM tiles")
def tile_gzip(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed tiles are the same bytes at every run, and give the data back."""

    def packed(x: int, y: int, data: bytes) -> tuple:
        z = K.compressed(data)
        return x, y, hashlib.sha256(gzip.decompress(z)).hexdigest(), int(z == K.compressed(data))

    t = _mapped(I.tiles(spark, sf).select("x", "y", "data"), "x long, y long, sha string, same int", packed)
    return t.withColumn("same", C("same") == 1)


@query("SELECT c_custkey AS id, round(c_acctbal / 7, 7) AS lon, round(c_acctbal / 11, 7) AS lat FROM customer")
def rounded_points(spark: SparkSession, sf: str) -> DataFrame:
    p = F.struct((C("c_acctbal") / 7).alias("lon"), (C("c_acctbal") / 11).alias("lat"))
    r = I.table(spark, sf, "customer").select(C("c_custkey").alias("id"), G.rounded(F.array(F.array(F.array(p)))).alias("g"))
    first = F.get(F.get(F.get("g", F.lit(0)), F.lit(0)), F.lit(0))
    return r.select("id", first["lon"].alias("lon"), first["lat"].alias("lat"))


@query(f"WITH {I.TILES}, o AS (SELECT z, x, y FROM tiles WHERE x % 3 <> 0) SELECT 'both' AS side, z, x, y FROM tiles SEMI JOIN o USING (z, x, y) UNION ALL SELECT 'first', z, x, y FROM tiles ANTI JOIN o USING (z, x, y)")
def keys_intersect_except(spark: SparkSession, sf: str) -> DataFrame:
    a = I.tiles(spark, sf).select("z", "x", "y")
    b = a.filter("x % 3 <> 0")
    return a.intersect(b).select(F.lit("both").alias("side"), "z", "x", "y").unionByName(a.exceptAll(b).select(F.lit("first").alias("side"), "z", "x", "y"))


@query(f"""WITH {I.TAGGED}, {I.NODES}, {I.WAYS}, last AS (SELECT id AS node, arg_max(lon, input_idx) / 3600 + 10 AS lon, arg_max(lat, input_idx) / 3600 + 48 AS lat FROM nodes GROUP BY id),
f AS (SELECT r.id, count(*) AS n, min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM refs r JOIN last USING (node) JOIN tagged t ON t.id = r.id WHERE t.highway IN ('motorway', 'motorway_link') GROUP BY r.id HAVING count(*) >= 2),
s AS (SELECT id, 13 AS z, {I.sql_x('a', '13')} AS x0, {I.sql_x('b', '13')} AS x1, {I.sql_y('d', '13')} AS y0, {I.sql_y('c', '13')} AS y1 FROM f)
SELECT CAST(z AS INTEGER) AS z, x, unnest(range(y0, y1 + 1)) AS y, id FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM s)""")
def osm_feature_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Motorways of the derived map by tile of zoom 13: what a build groups."""
    n, w = _small_map(spark, sf)
    f = osm.features(w, osm.needed_nodes(n, osm.renderable(w))).filter(C("props")["class"] == "motorway")
    return osm.fan_out(f, 13, 13).select("z", "x", "y", C("ord.id.id").alias("id"))
