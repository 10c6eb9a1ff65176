"""Statistics of measured latencies and sampling of benchmark corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.ranks import cumulated, ranked
from tilewright.operators.tileset import numbered


def _picked(samples: DataFrame, by: list[str], value: str, at: dict[str, str]) -> DataFrame:
    """Elements of each group's sorted values at the index that SQL of ``total``
    gives, and n.  Values are counted before they are sorted, and a group's
    distinct values may lie in all ranges of the sort."""
    counts = samples.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    c = cumulated(counts, by, "value")
    here = lambda index: (F.col("before") <= F.expr(index)) & (F.expr(index) < F.col("before") + F.col("n"))
    return c.groupBy(*by).agg(F.max("total").alias("n"), *(F.max(F.when(here(index), F.col("value"))).alias(name) for name, index in at.items()))


def picked_percentiles(samples: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The sorted values' elements at index (n - 1) * p div 100 of each group."""
    return _picked(samples, by, value, {f"p{p}": f"(total - 1) * {p} div 100" for p in percents})


def median_of_runs(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median of whole numbers; of an even number the lower middle one plus
    half the gap, rounded down."""
    ends = _picked(runs, by, value, {"low": "(total - 1) div 2", "high": "total div 2"})
    return ends.select(*by, F.expr("low + (high - low) div 2").alias("median"))


def zoom_quotas(available: DataFrame, target: int) -> DataFrame:
    """(z, quota) of (z, n): one for each zoom in turn until the target or all
    are used up.  Zooms are few, so the rounds are one small window."""
    rounds = available.filter("n > 0").withColumn("round", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(target)).cast("int"))))
    first = rounds.orderBy("round", "z").limit(target).groupBy("z").agg(F.count("*").alias("quota"))
    return available.select("z").join(first, "z", "left").select("z", F.coalesce("quota", F.lit(0)).alias("quota"))


def stratified_sample(tiles: DataFrame, quotas: DataFrame, seed: Column) -> DataFrame:
    """Tiles of each zoom in a seeded pseudo-random order, as many as its quota.
    The order is a distributed sort: the deepest zoom holds most tiles."""
    h = F.md5(F.concat_ws(":", seed, F.col("z"), F.col("x"), F.col("y")).cast("binary"))
    r = ranked(tiles.select("z", "x", "y", h.alias("h")), ["z"], ["h", "x", "y"])
    return r.join(quotas, "z").filter("rank < quota").select("z", "x", "y")


def corpus_order(keys: DataFrame, seed: Column) -> DataFrame:
    """Keys (z, x, y) with their rank in a seeded pseudo-random order; a key that
    occurs twice is an error."""
    n = keys.groupBy("z", "x", "y").agg(F.count("*").alias("n"))
    one = F.when(F.col("n") == 1, F.col("z")).otherwise(F.raise_error(F.lit("a key occurs twice")).cast("int"))
    h = F.md5(F.concat_ws(":", seed, F.col("z"), F.col("x"), F.col("y")).cast("binary"))
    hashed = n.select(one.alias("z"), "x", "y", F.struct(h.alias("h"), F.col("x"), F.col("y")).alias("at"))
    return numbered(hashed, "at", "rank").select("z", "x", "y", "rank")


def gate(measured: DataFrame, key: str, ours: str, theirs: str, ratio: float) -> DataFrame:
    """passed: ours is at most ``ratio`` times theirs."""
    return measured.withColumn("passed", F.col(ours) <= F.col(theirs) * ratio).select(key, ours, theirs, "passed")


def hit_ratio(log: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """hits, misses and their ratio, 0 without requests."""
    hits, misses = F.count(F.when(hit, 1)), F.count(F.when(~hit, 1))
    out = log.groupBy(*by).agg(hits.alias("hits"), misses.alias("misses"))
    total = F.col("hits") + F.col("misses")
    return out.withColumn("ratio", F.when(total == 0, 0.0).otherwise(F.col("hits") / total))
