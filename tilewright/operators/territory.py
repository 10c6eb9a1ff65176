"""Territories: polygons grouped by prefix or mapping, with aggregated fields,
dissolved geometry and join diagnostics.

Features are (ord, props, geometry), ``ord`` their place in the source; a
mapping is a table of text columns with its own ``ord``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import kernels as K
from tilewright.functions.text import key_of, list_cell, number, prefix, trimmed
from tilewright.shipping import ship

POINT = "struct<lon:double,lat:double>"
MULTIPOLYGON = f"array<array<array<{POINT}>>>"


def usable(features: DataFrame, key: str) -> DataFrame:
    """Features with a key and a geometry left after repair: ord, key, props
    (without the key), geometry."""
    raw = F.coalesce(F.col("props")[key], F.lit(""))
    own = F.map_filter("props", lambda k, _: k != key)
    return features.select("ord", raw.alias("key"), own.alias("props"), G.repaired(F.col("geometry")).alias("geometry")).filter((F.col("key") != "") & (F.size("geometry") > 0))


def by_prefix(features: DataFrame, key: str, n: int) -> DataFrame:
    """Members (group, ord, key, props, geometry) by the key's first ``n`` letters."""
    return usable(features, key).withColumn("group", prefix(F.col("key"), n))


def by_mapping(features: DataFrame, key: str, mapping: DataFrame, mapping_key: str, group: str) -> DataFrame:
    """Members by a mapping: each matching row yields one, its columns over the
    feature's properties; rows with a blank group yield none."""
    rest = [c for c in mapping.columns if c not in ("ord", mapping_key, group)]
    cells = F.map_from_arrays(F.array(*(F.lit(c) for c in rest)), F.array(*(F.coalesce(trimmed(F.col(c)), F.lit("")) for c in rest)))
    rows = mapping.select(key_of(F.col(mapping_key)).alias("k"), trimmed(F.col(group)).alias("group"), F.col("ord").alias("row"), cells.alias("cells"))
    joined = usable(features, key).withColumn("k", key_of(F.col("key"))).join(rows.filter(F.col("group") != ""), "k")
    kept = F.map_filter("props", lambda k, _: ~F.map_contains_key(F.col("cells"), k))
    return joined.select("group", "ord", "row", "key", F.map_concat(kept, "cells").alias("props"), "geometry")


def unmatched_geometry(features: DataFrame, key: str, mapping: DataFrame, mapping_key: str) -> DataFrame:
    """Keys of features that no mapping row has."""
    known = mapping.select(key_of(F.col(mapping_key)).alias("k"))
    return usable(features, key).withColumn("k", key_of(F.col("key"))).join(known, "k", "left_anti").select("key").distinct()


def unmatched_mapping(features: DataFrame, key: str, mapping: DataFrame, mapping_key: str) -> DataFrame:
    """Normalised mapping keys that no usable feature has."""
    known = usable(features, key).select(key_of(F.col("key")).alias("k"))
    asked = mapping.select(key_of(F.col(mapping_key)).alias("key")).filter(F.col("key") != "")
    return asked.join(known, F.col("key") == F.col("k"), "left_anti").select("key").distinct()


def duplicate_keys(mapping: DataFrame, mapping_key: str) -> DataFrame:
    """Normalised keys on more than one row; blank ones do not count."""
    k = mapping.select(key_of(F.col(mapping_key)).alias("key")).filter(F.col("key") != "")
    return k.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def empty_groups(features: DataFrame, key: str, mapping: DataFrame | None = None, mapping_key: str = "", group: str = "") -> DataFrame:
    """Number of features without a key and of matched rows without a group."""
    n = features.filter(F.coalesce(F.col("props")[key], F.lit("")) == "").agg(F.count("*").alias("n"))
    if mapping is not None:
        blank = mapping.filter(trimmed(F.col(group)) == "").select(key_of(F.col(mapping_key)).alias("k"))
        rows = usable(features, key).withColumn("k", key_of(F.col("key"))).join(blank, "k")
        n = n.unionByName(rows.agg(F.count("*").alias("n")))
    return n.agg(F.sum("n").alias("empty_group_keys"))


def _filled(v: Column) -> Column:
    return F.nullif(v, F.lit(""))


#: Name -> aggregate of a text column in an order; null means the field is left out.
STRATEGIES = {
    "first": lambda v, o: F.min_by(v, F.when(_filled(v).isNotNull(), o)),
    "unique": lambda v, o: F.array_sort(F.collect_set(_filled(v))),
    "list": lambda v, o: F.transform(F.array_sort(F.collect_list(F.when(_filled(v).isNotNull(), F.struct(o.alias("o"), v.alias("v"))))), lambda x: x["v"]),
    "count": lambda v, o: F.count_distinct(_filled(v)),
    "sum": lambda v, o: F.when(F.count(number(v)) > 0, F.aggregate(F.array_sort(F.collect_list(number(v))), F.lit(0.0), lambda s, x: s + x)),
    "min": lambda v, o: F.min(number(v)),
    "max": lambda v, o: F.max(number(v)),
    "discard": lambda v, o: F.lit(None).cast("string"),
}


def aggregate(strategy: str, values: Column, order: Column) -> Column:
    """An aggregate by name; an empty or unknown name is ``unique``."""
    return STRATEGIES.get(strategy, STRATEGIES["unique"])(values, order)


def scalarised(values: Column) -> Column:
    """Cell of a list field: nothing, the one value, or the list joined."""
    return F.when(F.size(values) == 0, F.lit(None)).otherwise(list_cell(values))


def summaries(members: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """territory_id, source_feature_count, source_values and the aggregated
    fields (name -> strategy).  A field named as a built-in replaces it."""
    fields = fields or {}
    order = F.struct(*(F.col(c) for c in ("ord", "row") if c in members.columns))
    built_in = {"source_feature_count": F.count("*"), "source_values": F.array_sort(F.collect_set("key"))}
    built_in |= {name: aggregate(how, F.col("props")[name], order) for name, how in fields.items() if how != "discard"}
    return members.groupBy(F.col("group").alias("territory_id")).agg(*(v.alias(k) for k, v in built_in.items()))


def dissolve_edges(members: DataFrame) -> DataFrame:
    """Directed boundary edges (group, ax, ay, bx, by, place): those of all
    polygons of a group whose reverse does not occur in it.  Polygons over the
    same exterior points count once, the first of them."""
    polygons = members.select("group", "ord", F.posexplode(G.normalized(F.col("geometry"))).alias("part", "polygon"))
    polygons = polygons.withColumn("signature", G.ring_signature(F.get("polygon", F.lit(0))))
    first = Window.partitionBy("group", "signature").orderBy("ord", "part")
    polygons = polygons.withColumn("r", F.row_number().over(first)).filter("r = 1")
    rings = polygons.select("group", "ord", "part", F.posexplode("polygon").alias("ring", "points"))
    each = rings.select("group", "ord", "part", "ring", F.posexplode(G.edges(F.col("points"))).alias("i", "e"))
    q = each.select(
        "group",
        F.struct("ord", "part", "ring", "i").alias("place"),
        *(G.quantized(F.col(f"e.{p}.{c}")).alias(p + n) for p in "ab" for c, n in (("lon", "x"), ("lat", "y"))),
    ).filter("ax <> bx or ay <> by")
    # Both directions of an edge meet in one group of a few rows, so one shuffle finds the reverses.
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    pair = q.select("group", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (a < b).alias("up"), "place")
    one_way = pair.groupBy("group", "low", "high").agg(F.min("up").alias("up"), F.max("up").alias("other"), F.collect_list("place").alias("places")).filter("up = other")
    start, end = F.when(F.col("up"), F.col("low")).otherwise(F.col("high")), F.when(F.col("up"), F.col("high")).otherwise(F.col("low"))
    out = one_way.select("group", start.alias("a"), end.alias("b"), F.explode("places").alias("place"))
    return out.select("group", "place", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def dissolved(members: DataFrame, simplify_metres: float = 0.0) -> DataFrame:
    """(group, geometry): one multipolygon for each group.

    Inner edges cancel in a join; what is left, the outline, is chained by one
    task for each group.
    """

    def chain(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("ord", "part", "ring", "i")])
        found = K.assemble(list(zip(*(rows.column(c).to_pylist() for c in ("ax", "ay", "bx", "by")))))
        if simplify_metres > 0:
            found = K.simplify_metres(found, simplify_metres)
        # Nested lists by their offsets: a dict for each point would take most of a task's memory.
        rings = [r for p in found for r in p]
        flat = np.fromiter((v for r in rings for q in r for v in q), np.float64).reshape(-1, 2)
        points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["lon", "lat"])
        ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
        shape = pa.ListArray.from_arrays(ends(map(len, found)), pa.ListArray.from_arrays(ends(map(len, rings)), points))
        return pa.table({"group": pa.array([key[0].as_py()], pa.string()), "geometry": pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), shape)})

    ship(members.sparkSession)
    e = dissolve_edges(members)
    e = e.select("group", "ax", "ay", "bx", "by", *(F.col(f"place.{c}").cast("long").alias(c) for c in ("ord", "part", "ring", "i")))
    return e.groupBy("group").applyInArrow(chain, f"group string, geometry {MULTIPOLYGON}")


def build(members: DataFrame, fields: dict[str, str] | None = None, simplify_metres: float = 0.0) -> DataFrame:
    """Territories: summaries, area_km2 and geometry."""
    shapes = dissolved(members, simplify_metres).withColumn("area_km2", F.round(G.area_km2(F.col("geometry")), 4))
    return summaries(members, fields).join(shapes.withColumnRenamed("group", "territory_id"), "territory_id")


def to_csv_columns(territories: DataFrame) -> DataFrame:
    """id and name first, other columns by name, lists joined."""
    kinds = dict(territories.dtypes)
    rest = sorted(c for c in territories.columns if c not in ("territory_id", "geometry"))
    cells = [scalarised(F.col(c)).alias(c) if kinds[c].startswith("array") else F.col(c).cast("string").alias(c) for c in rest]
    return territories.select("territory_id", F.col("territory_id").alias("territory_name"), *cells)


#: Aggregations that suit a report: no list of source keys, simplified outlines.
REPORT_SIMPLIFY_METRES = 50.0


def for_report(territories: DataFrame) -> DataFrame:
    """Without the list of source keys, which report tools cannot show."""
    return territories.drop("source_values")


def parse_aggregations(spec: str) -> dict[str, str]:
    """``field=strategy`` pairs between commas; an unknown strategy is an error."""
    out = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, _, how = (x.strip() for x in part.partition("="))
        if not name or how not in STRATEGIES:
            raise ValueError(f"{part!r} is no aggregation")
        out[name] = how
    return out


def parse_group(rule: str, has_mapping: bool) -> tuple[str, int | str]:
    """``prefix:N`` without a mapping, a column with one: (kind, value)."""
    kind, _, value = rule.strip().partition(":")
    if kind == "prefix":
        if has_mapping:
            raise ValueError("a prefix and a mapping exclude each other")
        if not value.isdigit() or int(value) < 1:
            raise ValueError("a prefix needs a positive length")
        return "prefix", int(value)
    if not has_mapping or not rule.strip():
        raise ValueError("grouping needs prefix:N, or a mapping and its column")
    return "mapping", rule.strip()


def overlap_warnings(members: DataFrame, cell: float = 1.0) -> DataFrame:
    """``a and b`` for members whose boxes overlap in more than an edge."""
    from tilewright.operators.spatial import bounds_columns, overlapping_pairs

    b = members.select(F.col("key"), F.col("ord"), *bounds_columns(F.col("geometry")))
    boxes = b.select(F.struct("ord", "key").alias("id"), F.col("min_lon").alias("min_x"), F.col("max_lon").alias("max_x"), F.col("min_lat").alias("min_y"), F.col("max_lat").alias("max_y"))
    return overlapping_pairs(boxes, cell).select(F.concat(F.col("a.key"), F.lit(" and "), F.col("b.key")).alias("warning")).distinct()


def _side_by_side(parts: list[DataFrame]) -> DataFrame:
    """Tables of one count each as the columns of one row, without a join."""
    rows = [p.select(F.lit(c).alias("name"), F.col(c).alias("n")) for p in parts for c in p.columns]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    names = [c for p in parts for c in p.columns]
    return out.agg(*(F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in names))


def validate(features: DataFrame, key: str, mapping: DataFrame, mapping_key: str, group: str) -> DataFrame:
    """One row: the number of findings of each kind, and ok."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    warned = features.filter(F.coalesce(F.col("props")[key], F.lit("")) != "").select(F.explode(G.repair_warnings(F.col("geometry"), F.col("props")[key])))
    parts = [
        count(unmatched_geometry(features, key, mapping, mapping_key), "unmatched_geometry_keys"),
        count(unmatched_mapping(features, key, mapping, mapping_key), "unmatched_mapping_keys"),
        count(duplicate_keys(mapping, mapping_key), "duplicate_mapping_keys"),
        empty_groups(features, key, mapping, mapping_key, group),
        count(warned, "repair_warnings"),
        count(overlap_warnings(usable(features, key)), "overlap_warnings"),
    ]
    out = _side_by_side(parts)
    return out.withColumn("ok", sum((F.col(c) for c in out.columns), F.lit(0)) == 0)


def mapping_report(mapping: DataFrame, mapping_key: str = "postcode") -> DataFrame:
    """rows, columns, duplicate_keys and ok of a mapping alone."""
    columns = len([c for c in mapping.columns if c != "ord"])
    twice = duplicate_keys(mapping, mapping_key).agg(F.count("*").alias("duplicate_keys"))
    out = _side_by_side([mapping.agg(F.count("*").alias("rows")), twice])
    return out.select("rows", F.lit(columns).cast("long").alias("columns"), "duplicate_keys", (F.col("duplicate_keys") == 0).alias("ok"))


def inspect(features: DataFrame) -> DataFrame:
    """A feature's id, number of polygons, area and box."""
    from tilewright.operators.spatial import bounds_columns

    first = F.get(F.array_sort(F.map_keys("props")), F.lit(0))
    own = F.coalesce(F.nullif(F.col("props")["territory_id"], F.lit("")), F.nullif(F.col("props")["id"], F.lit("")), F.nullif(F.col("props")[first], F.lit("")), F.col("ord").cast("string"))
    return features.select(own.alias("id"), F.size("geometry").cast("long").alias("components"), F.round(G.area_km2(F.col("geometry")), 4).alias("area_km2"), *bounds_columns(F.col("geometry")))


def property_keys(features: DataFrame) -> DataFrame:
    return features.select(F.explode(F.map_keys("props")).alias("key")).distinct()


def topojson_arcs(territories: DataFrame) -> DataFrame:
    """One arc for each ring, numbered in order of territory, polygon, ring."""
    from tilewright.operators.tileset import numbered

    rings = territories.select("territory_id", F.posexplode("geometry").alias("polygon", "rings")).select("territory_id", "polygon", F.posexplode("rings").alias("ring", "points"))
    rings = rings.withColumn("at", F.struct("territory_id", "polygon", "ring"))
    return numbered(rings, "at", "arc").select("arc", "territory_id", "polygon", "ring", "points")
