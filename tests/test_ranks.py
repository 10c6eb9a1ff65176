"""Ranks and content ids on tables whose ranges Spark would deal out twice."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright import shared
from tilewright.operators import ranks, stats, tileset
from tilewright.operators.ranks import cumulated, ranked


def test_numbers_of_a_million(spark):
    n = 1_000_000
    tiles = spark.range(n, numPartitions=7).select(
        F.lit(13).alias("z"), F.expr("(id * 7919) % 1000003").alias("x"), F.col("id").alias("y"), F.sha2(F.col("id").cast("string").cast("binary"), 512).cast("binary").alias("data")
    )
    images, keyed = tileset.content_ids(tiles)
    own = keyed.withColumn("n", F.conv("tile_id", 36, 10).cast("long"))
    got = own.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (n, n, 0, n - 1)
    assert images.agg(F.count("*"), F.count_distinct("tile_id")).first()[:] == (n, n)
    both = own.join(images.withColumnRenamed("data", "own"), "tile_id").join(tiles, ["z", "x", "y"])
    assert both.filter("own = data").count() == n
    first = own.orderBy("n").limit(50).collect()
    assert [r.x for r in first] == sorted(r.x for r in first)


def test_signatures_that_collide(spark):
    rows = [(1, 0, i, bytes([i % 3])) for i in range(9)] + [(1, 1, 0, None), (1, 1, 1, None), (1, 1, 2, b"")]
    tiles = spark.createDataFrame(rows, "z int, x long, y long, data binary")

    def constant(t):
        return t.select("*", F.lit(b"\0").alias("sha"), F.lit(7).cast("long").alias("hash"), F.lit(1).cast("long").alias("size"))

    want = {(z, x, y): data for z, x, y, data in rows}
    for signed in (tileset._signed, constant):
        images, keyed = tileset.content_ids(tiles, signed)
        data = {r.tile_id: r.data and bytes(r.data) for r in images.collect()}
        assert len(data) == 5 and sorted(data) == ["0", "1", "2", "3", "4"]
        got = {(r.z, r.x, r.y): data[r.tile_id] for r in keyed.collect()}
        assert len(got) == 12 and all((got[k] or b"") == (v or b"") and (got[k] is None) == (v is None) for k, v in want.items())


def test_payloads_are_not_numbered(spark, monkeypatch):
    stored = []
    for module in (ranks, tileset):
        plain = shared.saved
        monkeypatch.setattr(module, "saved", lambda df, *a, **k: stored.append(df.columns) or plain(df, *a, **k), raising=False)
    rows = [(2, x, 3 - x, None if x == 2 else b"ab"[x % 2 : x % 2 + 1] * 5) for x in range(4)] + [(2, None, 1, b"c"), (2, None, 2, b""), (1, 0, 0, b"bbbbb")]
    tiles = spark.createDataFrame(rows, "z int, x long, y long, data binary")
    images, keyed = tileset.content_ids(tiles)
    data = {r.tile_id: r.data if r.data is None else bytes(r.data) for r in images.collect()}
    assert data == {"0": b"bbbbb", "1": b"c", "2": b"", "3": b"aaaaa", "4": None}
    assert sorted(((r.z, r.x, r.y, data[r.tile_id]) for r in keyed.collect()), key=str) == sorted(rows, key=str)
    assert stored and all("data" not in columns for columns in stored)


def test_repeated_places(spark):
    rows = [(1, 0, 0, b"a"), (1, 0, 0, b"a"), (1, 0, 0, b"b"), (1, 1, 0, b"b"), (1, 1, 1, b"a"), (1, 1, 1, b"a")]
    images, keyed = tileset.content_ids(spark.createDataFrame(rows, "z int, x long, y long, data binary"))
    assert sorted(bytes(r.data) for r in images.collect()) == [b"a", b"b"]
    assert sorted((r.z, r.x, r.y, bytes(r.data)) for r in tileset.flat(keyed, images).collect()) == sorted(rows)


@pytest.mark.parametrize("groups", [1, 5])
def test_ranks(spark, groups):
    r = random.Random(groups)
    rows = [(r.choice([None, *range(groups)]), r.randrange(200), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(5)
    got = ranked(df, ["g"], ["v", "i"], "rank", "size").collect()
    by = {}
    for g, v, i in rows:
        by.setdefault(g, []).append((v, i))
    assert len(got) == len(rows)
    for x in got:
        assert sorted(by[x.g])[x.rank] == (x.v, x.i) and x.size == len(by[x.g])
    sums = {(x.g, x.v): (x.before, x.total) for x in cumulated(df.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v").collect()}
    for g, own in by.items():
        for v in {v for v, _ in own}:
            assert sums[g, v] == (sum(w < v for w, _ in own), len(own))
    p = {x.g: (x.n, x.p50, x.p99) for x in stats.picked_percentiles(df, ["g"], "v", (50, 99)).collect()}
    for g, own in by.items():
        s = sorted(v for v, _ in own)
        assert p[g] == (len(s), s[(len(s) - 1) * 50 // 100], s[(len(s) - 1) * 99 // 100])
    assert ranked(df.limit(0), ["g"], ["v"]).count() == 0
