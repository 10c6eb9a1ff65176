"""What the plans of the queries must and must not hold."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilewright.functions import tiles as T
from tilewright.operators import tileset
from tilewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_columns_are_pruned(spark):
    text = plan(QUERIES["tile_assign_z14"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint>" in text and "Exchange" not in text


def test_published_tiles_are_pruned(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).cast("int").alias("z"), (F.col("id") % 1).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(b"x").alias("data")).distinct()
    tileset.publish(rows, spark.createDataFrame([("a", "b")], "name string, value string"), str(tmp_path / "t"))
    text = plan(tileset.in_range(tileset.read_tiles(spark, str(tmp_path / "t")), 2, 0, 5, 0, 5))
    assert "PartitionFilters: [isnotnull(z" in text and "PushedFilters: [IsNotNull(x)" in text


def test_routes_of_all_users(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    users = {r.user_id for r in events.select("user_id").distinct().collect()}
    assert {r.route_id for r in QUERIES["route_tiles"](spark, SF).select("route_id").distinct().collect()} == users
    first = events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    lon, lat = F.expr("(event_id * 7919) % 3600000 / 10000 - 180"), F.expr("(event_id * 104729) % 1700000 / 10000 - 85")
    start = first.select(T.tile_x(lon, F.lit(6)).alias("x"), T.flip_row(T.tile_y(lat, F.lit(6), T.ROUTE_LATITUDE_LIMIT), F.lit(6)).alias("y"))
    asked = {(r.x, r.y) for r in QUERIES["route_sync_request"](spark, SF).collect()}
    assert {(r.x, r.y) for r in start.collect()} <= asked


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
