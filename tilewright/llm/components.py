"""Connected components over a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import drop_path, saved, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the links (a, b); the component is its
    smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks
    twice, and replaces the links by links between what they lead to; links
    inside a group vanish, so the table shrinks geometrically.  Rounds are
    written to the shared folder.  No step gathers a group: hubs only meet in
    sums and joins, which Spark can split.
    """
    spark = edges.sparkSession
    links = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    path = scratch(spark, "links")
    links = saved(links, path)
    result, maps = None, []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up"))
        step_path = scratch(spark, "hooks")
        hook = saved(hook, step_path)
        over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        for _ in range(2):
            hook = hook.join(over, "up").select("node", F.col("top").alias("up"))
        map_path = scratch(spark, "roots")
        root = saved(hook, map_path)
        a = root.select(F.col("node").alias("a"), F.col("up").alias("x"))
        b = root.select(F.col("node").alias("b"), F.col("up").alias("y"))
        next_ = links.join(a, "a").join(b, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        next_path = scratch(spark, "links")
        links = saved(next_, next_path)
        drop_path(spark, path, step_path)
        path = next_path
        maps.append(map_path)
        if result is None:
            result = root.select("node", F.col("up").alias("component"))
        else:
            m = root.select(F.col("node").alias("component"), F.col("up").alias("further"))
            result = result.join(m, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    if result is None:
        drop_path(spark, path)
        return spark.createDataFrame([], "node long, component long")
    out = saved(result, scratch(spark, "components"))
    drop_path(spark, path, *maps)
    return out
