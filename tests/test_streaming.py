from tilewright.streaming import requests as S


def test_sync_stream(spark, tmp_path):
    fetch = lambda z, x, y: bytes([z, x, y])
    asked, cache, check = (str(tmp_path / n) for n in ("asked", "cache", "check"))
    schema = "z int, x long, y long"
    spark.createDataFrame([(3, x, 0) for x in range(4)] + [(3, 0, 0)], schema).write.parquet(asked)
    stream = lambda: spark.readStream.schema(schema).parquet(asked)
    S.sync_stream(stream(), cache, check, fetch, "d", "r", once=True).awaitTermination()
    assert S.cached(spark, cache).count() == 4
    spark.createDataFrame([(3, x, 0) for x in range(2, 7)], schema).write.mode("append").parquet(asked)
    S.sync_stream(stream(), cache, check, fetch, "d", "r", once=True).awaitTermination()
    rows = S.cached(spark, cache).collect()
    assert sorted(r.x for r in rows) == list(range(7)) and {r.batch for r in rows} == {0, 1}
    assert all(bytes(r.data) == fetch(r.z, r.x, r.y) for r in rows)


def test_request_rates(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", 3), ("2024-01-01 00:00:59", 3), ("2024-01-01 00:01:05", 4)]
    p = str(tmp_path / "r")
    spark.createDataFrame(rows, "t string, z int").selectExpr("cast(t as timestamp) t", "z").write.parquet(p)
    stream = spark.readStream.schema("t timestamp, z int").parquet(p)
    q = S.request_rates(stream, "t", "1 minute", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.z, r.requests) for r in spark.table("rates").collect()) == [(3, 2), (4, 1)]
