"""Map entities to vector tiles: classification, joins, features, tiles.

nodes (input_idx, id, lon, lat), ways (input_idx, id, node_ids, tags),
relations (input_idx, id, tags, members).  Where an id stands in several
inputs, the last one counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import kernels as K
from tilewright.functions.text import trimmed
from tilewright.operators.spatial import tiles_of
from tilewright.shipping import ship

#: Road classes with their first zoom and the tags that name them.
ROADS = {
    "motorway": (5, ["motorway", "motorway_link"]),
    "trunk": (6, ["trunk", "trunk_link"]),
    "primary": (7, ["primary", "primary_link"]),
    "secondary": (8, ["secondary", "secondary_link"]),
    "tertiary": (9, ["tertiary", "tertiary_link"]),
    "residential": (11, ["unclassified", "residential", "living_street"]),
    "service": (13, ["service", "track"]),
    "path": (14, ["path", "footway", "pedestrian", "cycleway", "bridleway", "steps"]),
}
#: Tag, its values, layer, class, first zoom; the first that fits counts.
AREAS = [
    ("natural", ["water", "bay", "wetland"], "water", "water", 8),
    ("natural", ["wood"], "landcover", "forest", 9),
    ("natural", ["grassland", "scrub", "heath"], "landcover", "grass", 10),
    ("waterway", ["riverbank"], "water", "water", 8),
    ("landuse", ["reservoir", "basin"], "water", "water", 8),
    ("landuse", ["forest"], "landcover", "forest", 9),
    ("landuse", ["farmland", "farm", "orchard", "vineyard"], "landcover", "farmland", 10),
    ("landuse", ["meadow"], "landcover", "meadow", 10),
    ("landuse", ["grass"], "landcover", "grass", 10),
    ("landuse", ["residential", "commercial", "industrial", "retail"], "landcover", "urban", 10),
]
POSTAL_ZOOM = 8
LINE, POLYGON = 2, 3
POINT = "struct<lon:double,lat:double>"


def _class(layer: str, name: str, zoom: int, kind: int) -> Column:
    return F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("class"), F.lit(zoom).alias("min_zoom"), F.lit(kind).alias("kind"))


def _looked_up(values: dict[str, Column], tag: Column) -> Column:
    """The class that a tag's value has in a constant map; null without one."""
    return F.try_element_at(F.create_map(*(x for v, c in values.items() for x in (F.lit(v), c))), tag)


def road_class(tags: Column) -> Column:
    """struct(layer, class, min_zoom, kind) of a road; null for other ways."""
    return _looked_up({v: _class("transportation", name, zoom, LINE) for name, (zoom, values) in ROADS.items() for v in values}, tags["highway"])


def area_class(tags: Column) -> Column:
    """struct(layer, class, min_zoom, kind) of an area; null for other ways."""
    building = trimmed(F.coalesce(tags["building"], F.lit("")))
    by_tag: dict[str, dict[str, Column]] = {}  # the rows of a tag stand together in AREAS
    for tag, values, layer, name, zoom in AREAS:
        by_tag.setdefault(tag, {}).update({v: _class(layer, name, zoom, POLYGON) for v in values})
    own = F.when((building != "") & (building != "no"), _class("building", "building", 14, POLYGON))
    return F.coalesce(own, *(_looked_up(values, tags[tag]) for tag, values in by_tag.items()))


def classified(tags: Column) -> Column:
    """A road's class before an area's."""
    return F.coalesce(road_class(tags), area_class(tags))


def renderable(ways: DataFrame) -> DataFrame:
    return ways.withColumn("c", classified(F.col("tags"))).filter("c is not null")


def feature_properties(c: Column, tags: Column) -> Column:
    """class, and name; roads without a name take their ref."""
    name = F.nullif(trimmed(F.coalesce(tags["name"], F.lit(""))), F.lit(""))
    ref = F.when(c["kind"] == LINE, F.nullif(trimmed(F.coalesce(tags["ref"], F.lit(""))), F.lit("")))
    both = F.coalesce(name, ref)
    return F.when(both.isNull(), F.create_map(F.lit("class"), c["class"])).otherwise(F.create_map(F.lit("class"), c["class"], F.lit("name"), both))


def last_wins(df: DataFrame, key: str = "id", order: str = "input_idx") -> DataFrame:
    """One row for each key: that of the last input."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def needed_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes that a way refers to, each once."""
    refs = ways.select(F.explode("node_ids").alias("id")).distinct()
    return last_wins(nodes.join(refs, "id", "left_semi"))


def bounds(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Box over all occurrences of the nodes that a way refers to."""
    refs = ways.select(F.explode("node_ids").alias("id")).distinct()
    ends = (("min", "lon", F.min), ("min", "lat", F.min), ("max", "lon", F.max), ("max", "lat", F.max))
    return nodes.join(refs, "id", "left_semi").agg(*(f(c).alias(f"{n}_{c}") for n, c, f in ends))


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with ``points``: their nodes' places in order, unknown nodes left out."""
    each = ways.select("id", F.posexplode("node_ids").alias("pos", "node"))
    n = nodes.select(F.col("id").alias("node"), F.struct("lon", "lat").alias("p"))
    lines = each.join(n.hint("merge"), "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("s"))
    return ways.join(lines.select("id", F.transform("s", lambda x: x["p"]).alias("points")).hint("merge"), "id")


def features(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """layer, kind, min_zoom, props, rings of the ways that can be drawn: roads
    of two points or more, areas whose way and resolved ring are closed."""
    own = renderable(ways).select("id", "input_idx", "node_ids", "c", feature_properties(F.col("c"), F.col("tags")).alias("props"))
    lines = way_lines(last_wins_rows(own), nodes)
    n, p = F.size("node_ids"), F.size("points")
    line = (F.col("c.kind") == LINE) & (p >= 2)
    same = lambda a: F.get(a, F.lit(0)) == F.element_at(a, -1)
    area = (F.col("c.kind") == POLYGON) & (n >= 4) & same(F.col("node_ids")) & (p >= 4) & same(F.col("points"))
    ring = F.array(F.struct(F.lit(False).alias("hole"), F.col("points").alias("points")))
    return lines.filter(line | area).select(F.struct("input_idx", "id").alias("ord"), "c.layer", "c.kind", "c.min_zoom", "props", ring.alias("rings"), F.lit(False).alias("multi"))


def last_wins_rows(ways: DataFrame) -> DataFrame:
    """Ways of several inputs are separate features; ids are made distinct."""
    return ways.withColumn("id", F.struct("input_idx", "id")).withColumn("input_idx", F.col("id.input_idx"))


def postal_features(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Areas of postal-code relations: member ways joined to rings, ``inner``
    ones as holes; each relation is assembled by one task."""
    ship(ways.sparkSession)
    code = trimmed(F.coalesce(F.nullif(F.col("tags")["postal_code"], F.lit("")), F.col("tags")["ref"], F.lit("")))
    own = last_wins(relations).withColumn("code", code).filter((F.col("tags")["boundary"] == "postal_code") & (F.col("code") != ""))
    member = own.select(F.col("id").alias("rel"), "code", F.col("tags")["name"].alias("name"), F.posexplode("members").alias("pos", "m")).filter("m.type = 1")
    w = last_wins(ways.select("input_idx", "id", "node_ids")).filter(F.size("node_ids") >= 2)
    # Exploded tables are far larger than what their estimates come from: they are merged, never broadcast.
    joined = member.select("rel", "code", "name", "pos", F.col("m.role").alias("role"), F.col("m.ref").alias("id")).join(w.hint("merge"), "id")
    points = way_lines(joined.select(F.struct("rel", "pos").alias("id"), "node_ids"), last_wins(nodes.drop("tags")))
    known = joined.withColumn("key", F.struct("rel", "pos")).join(points.select(F.col("id").alias("key"), "points").hint("merge"), "key")

    def assembled(members: list[dict]) -> list[dict]:
        place: dict[int, tuple] = {}
        for m in members:
            if len(m["node_ids"]) == len(m["points"]):
                place.update(zip(m["node_ids"], ((p["lon"], p["lat"]) for p in m["points"])))
        rings = []
        for hole in (False, True):
            some = [m["node_ids"] for m in members if (m["role"] == "inner") == hole]
            for ids in K.join_ways(some):
                ring = [place[i] for i in ids if i in place]
                if len(ring) >= 4 and ring[0] == ring[-1]:
                    if (K._area2(ring) > 0) == hole:
                        ring = ring[::-1]
                    rings.append({"hole": hole, "points": [{"lon": x, "lat": y} for x, y in ring]})
        return rings if any(not r["hole"] for r in rings) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hole", pa.bool_()), ("points", pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))]))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rings = pa.array([assembled(m.as_py()) for m in part.column(3)], kind)
                out = pa.RecordBatch.from_arrays([*part.columns[:3], rings], names=["rel", "code", "name", "rings"])
                yield out.filter(pc.greater(pc.list_value_length(rings), 0))

    schema = f"rel long, code string, name string, rings array<struct<hole:boolean,points:array<{POINT}>>>"
    member = F.struct("pos", "role", "node_ids", "points")
    by = known.groupBy("rel").agg(F.first("code").alias("code"), F.first("name").alias("name"), F.array_sort(F.collect_list(member)).alias("members"))
    out = by.select(F.col("rel").cast("long").alias("rel"), "code", "name", "members").mapInArrow(run, schema)
    name = trimmed(F.coalesce("name", F.lit("")))
    props = F.when(name == "", F.create_map(F.lit("postcode"), F.col("code"))).otherwise(F.create_map(F.lit("postcode"), F.col("code"), F.lit("name"), name))
    return out.select(
        F.struct(F.lit(1 << 30).alias("input_idx"), F.struct(F.lit(0).alias("input_idx"), F.col("rel").alias("id")).alias("id")).alias("ord"),
        F.lit("postal_code").alias("layer"), F.lit(POLYGON).alias("kind"), F.lit(POSTAL_ZOOM).alias("min_zoom"), props.alias("props"), "rings", F.lit(True).alias("multi"),
    )


def fan_out(feats: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Features once for each zoom they show at and tile of their box."""
    points = F.flatten(F.transform("rings", lambda r: r["points"]))
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    low = F.greatest(F.lit(min_zoom), F.col("min_zoom"))
    boxed = feats.select("*", F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"))
    zoomed = boxed.filter(low <= max_zoom).withColumn("z", F.explode(F.sequence(low, F.lit(max_zoom))))
    return tiles_of(zoomed).drop("min_lon", "max_lon", "min_lat", "max_lat")


def _changes(column: pa.Array) -> np.ndarray:
    """Where a column's value differs from the one before; true at the first."""
    parts = [column]
    while any(pa.types.is_struct(p.type) for p in parts):
        parts = [q for p in parts for q in (p.flatten() if pa.types.is_struct(p.type) else [p])]
    out = np.ones(len(column), bool)
    if len(column):
        leaves = [p.to_numpy(zero_copy_only=False) for p in parts]
        out[1:] = np.any([v[1:] != v[:-1] for v in leaves], axis=0)
    return out


def shaped(fanned: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """(z, x, y, ord, layer, kind, props, geometry): each feature's commands in
    each of its tiles, simplified and clipped, where anything is left.  It runs
    where the features were fanned out, so whole outlines are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, x, y, kind, multi = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("z", "x", "y", "kind", "multi"))
            rings, fresh = b.column(b.schema.get_field_index("rings")), _changes(b.column(b.schema.get_field_index("ord")))
            out: list[bytes] = []
            points: list[dict] = []
            for i, (zz, xx, yy, k, m) in enumerate(zip(z, x, y, kind, multi)):
                if fresh[i]:  # a feature's tiles follow each other
                    points = [{"hole": r["hole"], "points": [(p["lon"], p["lat"]) for p in r["points"]]} for r in rings[i].as_py()]
                out.append(K.tile_geometry({"kind": k, "multi": m, "rings": points}, zz, xx, yy, tolerance))
            keep = pa.array([bool(g) for g in out])
            columns = [b.column(b.schema.get_field_index(c)) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=names).filter(keep)

    ship(fanned.sparkSession)
    # A map cannot be sorted or compared, so properties travel as entries.
    src = fanned.select(F.col("z").cast("int"), "x", "y", "ord", "layer", "kind", F.array_sort(F.map_entries("props")).alias("props"), "rings", "multi")
    names = ["z", "x", "y", "ord", "layer", "kind", "props", "geometry"]
    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names[:-1]) + ", geometry binary")


def encode(fanned: DataFrame, tolerance: float = 4.0, gzip: bool = True) -> DataFrame:
    """Vector tiles (z, x, y, data), TMS rows, empty ones left out.  A task takes
    the clipped commands of its tiles from a sorted stream and holds one tile's
    bytes, no outlines and no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    yield from zip(*(c.to_pylist() for c in b.slice(i, 1024).columns))

        for (z, x, y), own in itertools.groupby(rows(), lambda r: r[:3]):
            tile = K.tile_of((r[3], r[4], [(p["key"], p["value"]) for p in r[5]], r[6]) for r in own)
            data = K.compressed(tile) if gzip else tile
            yield pa.RecordBatch.from_arrays([pa.array([z], pa.int32()), pa.array([x], pa.int64()), pa.array([(1 << z) - 1 - y], pa.int64()), pa.array([data], pa.binary())], names=["z", "x", "y", "data"])

    by = shaped(fanned, tolerance).repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "ord", "layer", "kind", "props", "geometry")
    return by.select("z", "x", "y", "layer", "kind", "props", "geometry").mapInArrow(run, "z int, x long, y long, data binary")


def build_osm(nodes: DataFrame, ways: DataFrame, relations: DataFrame | None = None, min_zoom: int = 5, max_zoom: int = 14, tolerance: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(tiles, features): a whole build; relations add the postal layer."""
    if not 0 <= min_zoom <= max_zoom <= 22:
        raise ValueError("zooms must satisfy 0 <= min <= max <= 22")
    own = renderable(ways)
    near = needed_nodes(nodes, own)
    feats = features(ways, near)
    if relations is not None and max_zoom >= POSTAL_ZOOM:
        feats = feats.unionByName(postal_features(relations, ways, nodes))
    return encode(fan_out(feats, min_zoom, max_zoom), tolerance), feats


def road_counts(feats: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """(z, roads): line features that show at each zoom."""
    low = F.greatest(F.lit(min_zoom), F.col("min_zoom"))
    lines = feats.filter((F.col("kind") == LINE) & (low <= max_zoom))
    return lines.select(F.explode(F.sequence(low, F.lit(max_zoom))).alias("z")).groupBy("z").agg(F.count("*").alias("roads"))


#: Presets of a build: zooms, tolerance, whether the postal layer is suggested.
PRESETS = {
    "balanced": (5, 14, 4.0, False),
    "fast": (5, 10, 8.0, False),
    "detailed": (5, 16, 2.0, True),
    "mobile": (5, 12, 6.0, False),
    "postcode": (5, 13, 4.0, True),
}


def preset(name: str = "") -> tuple[int, int, float, bool]:
    if (name or "balanced") not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    return PRESETS[name or "balanced"]


def in_area(nodes: DataFrame, bbox: tuple[float, float, float, float] | None = None, centre: tuple[float, float] | None = None, radius_km: float | None = None) -> DataFrame:
    """Nodes within a box (min lon, min lat, max lon, max lat) or a circle; one
    of the two at most, a circle needs both its centre and radius."""
    if bbox is not None and (centre is not None or radius_km is not None):
        raise ValueError("a box and a circle exclude each other")
    if (centre is None) != (radius_km is None):
        raise ValueError("a circle needs a centre and a radius")
    if bbox is not None:
        if not all(bbox) or bbox[0] >= bbox[2] or bbox[1] >= bbox[3]:
            raise ValueError("a box needs four bounds other than 0, in order")
        return nodes.filter(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    if centre is not None:
        if radius_km <= 0:
            raise ValueError("the radius must be positive")
        lon, lat = (F.radians(F.lit(v)) for v in centre)
        a = F.pow(F.sin((F.radians("lat") - lat) / 2), 2) + F.cos(lat) * F.cos(F.radians("lat")) * F.pow(F.sin((F.radians("lon") - lon) / 2), 2)
        return nodes.filter(F.asin(F.sqrt(a)) * 2 * 6371.0088 <= radius_km)
    return nodes


def stream_metadata(name: str, box: tuple[float, float, float, float], min_zoom: int, max_zoom: int, postal: bool = False) -> dict[str, str]:
    """Metadata rows of a built tile set."""
    import json

    w, s, e, n = box
    layers = ["water", "landcover", "building", "transportation", *(["postal_code"] if postal else [])]
    fields = {"class": "String", "name": "String"}
    return {
        "name": name, "format": "pbf", "type": "baselayer", "minzoom": str(min_zoom), "maxzoom": str(max_zoom), "kb:content_encoding": "gzip",
        "bounds": f"{w:.6f},{s:.6f},{e:.6f},{n:.6f}", "center": f"{(w + e) / 2:.6f},{(s + n) / 2:.6f},{min_zoom}",
        "json": json.dumps({"vector_layers": [{"id": x, "fields": {"postcode": "String", "name": "String"} if x == "postal_code" else fields} for x in layers]}),
    }

