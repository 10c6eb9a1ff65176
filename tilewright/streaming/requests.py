"""Continuous synchronisation: a stream of requested tiles fills a cache table.

Each micro-batch downloads what the active revision lacks and appends it under
the batch's number, so a batch that is run again replaces its own rows and
nothing is stored twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import sync

CACHE = "dataset string, revision string, z int, x long, y long, data binary, checksum string, batch long"


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; empty before the first batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def sync_stream(requests: DataFrame, path: str, checkpoint: str, fetch: Callable[[int, int, int], bytes], dataset: str, revision: str, once: bool = False):
    """Start the query over a stream of (z, x, y); its progress is Spark's own."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = cached(spark, path).filter(F.col("batch") < number)
        planned = sync.plan(batch.select("z", "x", "y").distinct(), earlier, dataset, revision)
        new = sync.download(planned, fetch, dataset, revision).withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    w = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start() if once else w.start()


def request_rates(requests: DataFrame, time: str, every: str, late: str) -> DataFrame:
    """Requests for each zoom and window of time; rows later than ``late`` are left out."""
    timed = requests.withWatermark(time, late)
    return timed.groupBy(F.window(time, every), "z").agg(F.count("*").alias("requests")).select("window.start", "window.end", "z", "requests")
