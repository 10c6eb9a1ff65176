"""Spatial inputs derived from the driver's tables, for Spark and as SQL.

Everything comes from integers, so both engines get the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat: one point for each order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.expr("(o_orderkey * 7919) % 3600000").cast("double") / 10000 - 180).alias("lon"),
        (F.expr("(o_orderkey * 104729) % 1700000").cast("double") / 10000 - 85).alias("lat"),
    )


POINTS = """pts AS (SELECT o_orderkey AS id, CAST((o_orderkey * 7919) % 3600000 AS DOUBLE) / 10000 - 180 AS lon,
  CAST((o_orderkey * 104729) % 1700000 AS DOUBLE) / 10000 - 85 AS lat FROM orders)"""


def sql_x(lon: str, z: str) -> str:
    return f"greatest(0, least(CAST(floor(({lon} + 180) / 360 * pow(2.0, {z})) AS BIGINT), CAST(pow(2.0, {z}) AS BIGINT) - 1))"


def sql_merc(lat: str, z: str, limit: float = 85.05112878) -> str:
    a = f"(greatest(least({lat}, CAST({limit} AS DOUBLE)), CAST(-{limit} AS DOUBLE)) * pi() / 180)"
    return f"((1 - ln(tan({a}) + 1 / cos({a})) / pi()) / 2 * pow(2.0, {z}))"


def sql_y(lat: str, z: str, limit: float = 85.05112878) -> str:
    return f"greatest(0, least(CAST(floor({sql_merc(lat, z, limit)}) AS BIGINT), CAST(pow(2.0, {z}) AS BIGINT) - 1))"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, x, y, data: one tile for each document, with real duplicates."""
    return table(spark, sf_dir, "documents").select(
        F.lit(13).alias("z"), F.expr("doc_id % 8192").alias("x"), F.expr("doc_id div 8192").alias("y"), F.col("text").cast("binary").alias("data")
    )


TILES = "tiles AS (SELECT 13 AS z, doc_id % 8192 AS x, doc_id // 8192 AS y, encode(text) AS data FROM documents)"


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, code, grp, gx, gy: a unit square on an integer grid for each customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"),
        F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("code"),
        F.col("c_nationkey").cast("long").alias("grp"),
        F.expr("c_custkey % 40").alias("gx"),
        F.expr("c_custkey div 40").alias("gy"),
        "c_mktsegment",
        "c_acctbal",
    )


SQUARES = """squares AS (SELECT c_custkey AS ord, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS code, CAST(c_nationkey AS BIGINT) AS grp,
  c_custkey % 40 AS gx, c_custkey // 40 AS gy, c_mktsegment, c_acctbal FROM customer)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, props, geometry: the squares as polygons with string properties.
    One in 50 has no code, one in 61 a ring too short to keep."""
    s = squares(spark, sf_dir)
    pt = lambda dx, dy: F.struct((F.col("gx") + dx).cast("double").alias("lon"), (F.col("gy") + dy).cast("double").alias("lat"))
    ring = F.array(pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 1), pt(0, 0))
    ring = F.when(F.col("ord") % 61 == 0, F.array(pt(0, 0), pt(1, 0), pt(0, 0))).otherwise(ring)
    code = F.when(F.col("ord") % 50 == 0, "").otherwise(F.col("code"))
    props = F.create_map(F.lit("postcode"), code, F.lit("segment"), F.col("c_mktsegment"), F.lit("rank"), (F.col("ord") % 7).cast("string"))
    return s.select("ord", props.alias("props"), F.array(F.array(ring)).alias("geometry"))


FEATURES = SQUARES + """,
features AS (SELECT ord, CASE WHEN ord % 50 = 0 THEN '' ELSE code END AS postcode, c_mktsegment AS segment, CAST(ord % 7 AS VARCHAR) AS rank,
  ord % 61 <> 0 AS whole, gx, gy FROM squares)"""


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text table: customers' codes (without every 9th, every 10th twice,
    some beyond the customers), their nation as territory, segment, balance."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    base = c.filter("c_custkey % 9 <> 0").select(
        (F.col("c_custkey") * 2).alias("ord"),
        F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit(" "), code, F.lit("\t"))).otherwise(code).alias("postcode"),
        F.when(F.col("c_custkey") % 37 == 0, " ").otherwise(F.col("n_name")).alias("territory"),
        F.col("c_mktsegment").alias("employee"),
        F.round("c_acctbal").cast("long").cast("string").alias("amount"),
    )
    again = base.filter("(ord div 2) % 10 = 0").withColumn("ord", F.col("ord") + 1).withColumn("employee", F.concat(F.lit("AUX "), "employee")).withColumn("amount", F.lit("n/a"))
    beyond = base.filter("(ord div 2) % 100 = 1").withColumn("ord", F.col("ord") + 1).withColumn("postcode", F.concat(F.lit("Z"), "postcode"))
    return base.unionByName(again).unionByName(beyond)


MAPPING = """base AS (SELECT c_custkey * 2 AS ord, CASE WHEN c_custkey % 11 = 0 THEN ' ' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || chr(9) ELSE lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS postcode,
  CASE WHEN c_custkey % 37 = 0 THEN ' ' ELSE n_name END AS territory, c_mktsegment AS employee, CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) AS amount
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 9 <> 0),
mapping AS (SELECT * FROM base UNION ALL SELECT ord + 1, postcode, territory, 'AUX ' || employee, 'n/a' FROM base WHERE (ord // 2) % 10 = 0
  UNION ALL SELECT ord + 1, 'Z' || postcode, territory, employee, amount FROM base WHERE (ord // 2) % 100 = 1)"""

#: Fixed values of the derived tags.
HIGHWAYS = "motorway motorway_link trunk primary secondary_link tertiary unclassified residential service track path steps construction".split()
BUILDINGS = ["", "yes", "no", " "]
NATURALS = ["", "water", "wood", "scrub", "cliff", "bay"]
LANDUSES = ["", "reservoir", "forest", "farm", "meadow", "grass", "retail", "military"]


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tags: a way's tags for each part, by modulus."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.expr(k) + 1).cast("int"))
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.create_map(
            F.lit("highway"), F.when(F.col("p_partkey") % 3 == 0, pick(HIGHWAYS, f"p_partkey % {len(HIGHWAYS)}")).otherwise(""),
            F.lit("building"), pick(BUILDINGS, f"(p_partkey div 3) % {len(BUILDINGS)}"),
            F.lit("natural"), pick(NATURALS, f"(p_partkey div 5) % {len(NATURALS)}"),
            F.lit("waterway"), F.when(F.col("p_partkey") % 17 == 0, "riverbank").otherwise(""),
            F.lit("landuse"), pick(LANDUSES, f"(p_partkey div 7) % {len(LANDUSES)}"),
            F.lit("name"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("  "), "p_name")).otherwise(" "),
            F.lit("ref"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(""),
        ).alias("tags"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TAGGED = f"""tagged AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN ({_list(HIGHWAYS)})[p_partkey % {len(HIGHWAYS)} + 1] ELSE '' END AS highway,
  ({_list(BUILDINGS)})[(p_partkey // 3) % {len(BUILDINGS)} + 1] AS building, ({_list(NATURALS)})[(p_partkey // 5) % {len(NATURALS)} + 1] AS "natural",
  CASE WHEN p_partkey % 17 = 0 THEN 'riverbank' ELSE '' END AS waterway, ({_list(LANDUSES)})[(p_partkey // 7) % {len(LANDUSES)} + 1] AS landuse,
  CASE WHEN p_partkey % 4 = 0 THEN '  ' || p_name ELSE ' ' END AS name, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS ref FROM part)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """input_idx, id, lon, lat: one for each part but every 13th; every 20th
    stands in a second input too, elsewhere."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 13 <> 0")
    lon = F.expr("(p_partkey * 7919) % 3600000").cast("double") / 10000 - 180
    lat = F.expr("(p_partkey * 104729) % 1700000").cast("double") / 10000 - 85
    first = p.select(F.lit(0).alias("input_idx"), F.col("p_partkey").alias("id"), lon.alias("lon"), lat.alias("lat"))
    return first.unionByName(first.filter("id % 20 = 0").select(F.lit(1).alias("input_idx"), "id", (F.col("lon") / 2).alias("lon"), (F.col("lat") / 2).alias("lat")))


NODES = """nodes0 AS (SELECT 0 AS input_idx, p_partkey AS id, CAST((p_partkey * 7919) % 3600000 AS DOUBLE) / 10000 - 180 AS lon,
  CAST((p_partkey * 104729) % 1700000 AS DOUBLE) / 10000 - 85 AS lat FROM part WHERE p_partkey % 13 <> 0),
nodes AS (SELECT * FROM nodes0 UNION ALL SELECT 1, id, lon / 2, lat / 2 FROM nodes0 WHERE id % 20 = 0)"""


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, node_ids: the parts of an order in line order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select("id", F.transform("lines", lambda x: x["l_partkey"]).alias("node_ids"))


WAYS = "refs AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey AS node FROM lineitem)"
