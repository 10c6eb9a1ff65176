"""Search in an index of codes (ord, code, name, geometry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import key_of
from tilewright.operators.spatial import bounds_columns, point_in_polygon

MOST_HITS = 50


def load(features: DataFrame, code: str = "postcode", name: str = "name") -> DataFrame:
    """The index of features (ord, props, geometry); those without a code are left out."""
    own = features.select("ord", F.col("props")[code].alias("code"), F.coalesce(F.col("props")[name], F.lit("")).alias("name"), "geometry")
    return own.filter(F.coalesce(F.trim("code"), F.lit("")) != "")


def search(index: DataFrame, text: str, most: int = MOST_HITS) -> DataFrame:
    """The first ``most`` by code whose code or name holds the text."""
    q = key_of(F.lit(text))
    return index.filter(F.contains(F.lower("code"), q) | F.contains(F.lower("name"), q)).orderBy("code", "ord").limit(most)


def lookup(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked code's entry; of entries with the same code the last."""
    rest = [c for c in index.columns if c != "ord"]
    last = index.groupBy(key_of(F.col("code")).alias("k")).agg(F.max_by(F.struct(*rest), "ord").alias("e"))
    return asked.withColumn("k", key_of(F.col("asked"))).join(last, "k").select("asked", "e.*")


def at_points(index: DataFrame, points: DataFrame, cell: float = 0.25) -> DataFrame:
    """(point_id, code) of the areas that hold each point."""
    hits = point_in_polygon(points, index.select(F.col("code").alias("polygon_id"), "geometry"), cell)
    return hits.withColumnRenamed("polygon_id", "code").orderBy("point_id", "code")


def summary(geometry: Column) -> Column:
    """struct(center_lon, center_lat, bbox)."""
    w, e, s, n = (F.element_at(F.array(*bounds_columns(geometry)), i) for i in (1, 2, 3, 4))
    return F.struct(((w + e) / 2).alias("center_lon"), ((s + n) / 2).alias("center_lat"), F.array(w, s, e, n).alias("bbox"))


