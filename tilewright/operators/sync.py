"""Revisioned synchronisation of tile subsets, as tables.

A cache holds (dataset, revision, z, x, y, data, checksum); requests are keys
and inclusive ranges; a manifest names the revision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.tiles import MAX_ZOOM
from tilewright.operators.spatial import overlapping_pairs
from tilewright.operators.tileset import expand_ranges
from tilewright.shipping import ship

KEY = ["z", "x", "y"]
#: Limits of a manifest's fields.
MOST_DATASET, MOST_REVISION = 256, 512


def requested(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Explicit keys and all tiles of the ranges."""
    return keys.select(*KEY).unionByName(expand_ranges(ranges.select("z", "x_min", "x_max", "y_min", "y_max")).select(*KEY))


def request_conflicts(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """(kind, z, x, y): keys given twice, keys inside a range, overlaps of two
    ranges (at their lower left corner).  A request with any is refused."""
    twice = keys.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate key").alias("kind"), *KEY)
    inside = keys.join(expand_ranges(ranges.select("z", "x_min", "x_max", "y_min", "y_max")).distinct(), KEY, "left_semi")
    inside = inside.distinct().select(F.lit("key in range").alias("kind"), *KEY)
    boxes = ranges.select(F.struct("z", "x_min", "x_max", "y_min", "y_max").alias("id"), "z", F.col("x_min").alias("min_x"), F.col("x_max").alias("max_x"), F.col("y_min").alias("min_y"), F.col("y_max").alias("max_y"))
    over = overlapping_pairs(boxes, cell=64.0, touching=True, by=["z"])
    over = over.select(F.lit("ranges overlap").alias("kind"), F.col("a.z").alias("z"), F.greatest("a.x_min", "b.x_min").alias("x"), F.greatest("a.y_min", "b.y_min").alias("y"))
    return twice.unionByName(inside).unionByName(over)


def plan(keys: DataFrame, cache: DataFrame, dataset: str, revision: str) -> DataFrame:
    """Each requested key with ``reuse`` (present and sound), ``corrupt``
    (present with a wrong checksum) or ``download``.  A tile that the cache holds
    twice is one; it is corrupt if one copy is."""
    here = cache.filter((F.col("dataset") == dataset) & (F.col("revision") == revision))
    state = F.when(F.lower("checksum") == F.sha2("data", 256), "reuse").otherwise("corrupt")
    here = here.select(*KEY, state.alias("state")).groupBy(*KEY).agg(F.min("state").alias("state"))
    return keys.join(here, KEY, "left").select(*KEY, F.coalesce("state", F.lit("download")).alias("action"))


def result(planned: DataFrame, total: Column | None = None) -> DataFrame:
    """One row: total, reused, downloaded, and whether it can be published."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    out = planned.agg(F.count("*").alias("total"), n("reuse").alias("reused"), n("download").alias("downloaded"), n("corrupt").alias("corrupt"))
    return out.withColumn("published", F.col("corrupt") == 0)


def download(planned: DataFrame, fetch: Callable[[int, int, int], bytes], dataset: str, revision: str, done: Accumulator | None = None) -> DataFrame:
    """Cache rows of the keys to download.  ``fetch`` runs on the workers, one
    call a tile, and raises on failure; ``done`` counts the tiles fetched, while
    the job runs (a repeated task counts again)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["data"] = [fetch(int(z), int(x), int(y)) for z, x, y in zip(p["z"], p["x"], p["y"])]
            if done is not None:
                done.add(len(p))
            yield p

    ship(planned.sparkSession)
    got = planned.filter("action = 'download'").select(*KEY).mapInPandas(run, "z int, x long, y long, data binary")
    return got.select(F.lit(dataset).alias("dataset"), F.lit(revision).alias("revision"), *KEY, "data", F.sha2("data", 256).alias("checksum"))


def prune(cache: DataFrame, dataset: str, active: str) -> DataFrame:
    """The cache without other revisions of a dataset."""
    return cache.filter((F.col("dataset") != dataset) | (F.col("revision") == active))


def range_problem() -> Column:
    """Why a range row (z, x_min, x_max, y_min, y_max) is refused; null if it is sound."""
    c = F.col
    n = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.least(c("z"), F.lit(MAX_ZOOM))).cast("int"))
    return (
        F.when(c("z").isNull() | ~c("z").between(0, MAX_ZOOM), "zoom")
        .when(F.coalesce((c("x_min") < 0) | (c("x_min") > c("x_max")), F.lit(True)), "columns")
        .when(F.coalesce((c("y_min") < 0) | (c("y_min") > c("y_max")), F.lit(True)), "rows")
        .when((c("x_max") >= n) | (c("y_max") >= n), "outside the zoom")
    )


def manifest_problem(m: dict[str, str] | None = None) -> Column:
    """Why a manifest row is refused; null if it is sound."""
    c = F.col
    clean = lambda name: (F.length(F.trim(name)) > 0) & (F.trim(name) == c(name)) & ~F.regexp_like(name, F.lit(r"[\x00-\x1f\x7f]"))
    return (
        F.when(c("format_version") != 1, "format version")
        .when(~clean("dataset") | (F.octet_length("dataset") > MOST_DATASET), "dataset")
        .when(~clean("revision") | (F.octet_length("revision") > MOST_REVISION), "revision")
        .when(c("coordinate_system") != "TMS", "coordinate system")
        .when(~(F.contains("tile_url_template", F.lit("{z}")) & F.contains("tile_url_template", F.lit("{x}")) & F.contains("tile_url_template", F.lit("{y}"))), "template")
    )


def manifest_step(known_revision: Column, remote_revision: Column) -> Column:
    """``unchanged`` where the remote revision is known already, else ``fetch``."""
    return F.when(known_revision == remote_revision, "unchanged").otherwise("fetch")


def prefetch_plan(asked: DataFrame, cached: DataFrame, capacity: int, budget: int) -> DataFrame:
    """Accounting of each call (call_id, pos, z, x, y): considered, queued,
    already_cached, already_queued, dropped, truncated.

    Of a call's keys the first ``budget`` are considered; a repeated key counts
    as queued already; the first ``capacity`` new ones are queued.
    """
    place = Window.partitionBy("call_id").orderBy("pos")
    ranked = asked.withColumn("rank", F.row_number().over(place))
    per_call = Window.partitionBy("call_id")
    ranked = ranked.withColumn("truncated", F.max("rank").over(per_call) > budget).filter(F.col("rank") <= budget)
    first = Window.partitionBy("call_id", *KEY).orderBy("rank")
    ranked = ranked.withColumn("again", F.row_number().over(first) > 1)
    known = ranked.join(cached.select(*KEY, F.lit(True).alias("cached")).distinct(), KEY, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    new = ~F.col("again") & ~F.col("cached")
    known = known.withColumn("new_rank", F.when(new, F.sum(new.cast("int")).over(place)))
    n = lambda cond: F.count(F.when(cond, 1))
    return known.groupBy("call_id").agg(
        F.count("*").alias("considered"),
        n(F.col("new_rank") <= capacity).alias("queued"),
        n(~F.col("again") & F.col("cached")).alias("already_cached"),
        n(F.col("again")).alias("already_queued"),
        n(F.col("new_rank") > capacity).alias("dropped"),
        F.max("truncated").alias("truncated"),
    )


