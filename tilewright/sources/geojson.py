"""GeoJSON, mapping tables and the sinks of territories."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions.text import trimmed
from tilewright.sources.parts import joined


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(ord, props, geometry) of a FeatureCollection or a single Feature.  Other
    geometries than Polygon and MultiPolygon are an error that names the
    feature; ordinates beyond two are ignored."""
    doc = spark.read.text(path, wholetext=True)
    kind = F.get_json_object("value", "$.type")
    many = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    items = F.when(kind == "FeatureCollection", many).when(kind == "Feature", F.array("value"))
    each = doc.select(F.posexplode(items).alias("ord", "f"))
    props = F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>")
    shape = G.parsed_geojson(F.get_json_object("f", "$.geometry"))
    message = F.concat(F.lit("feature "), F.col("ord").cast("string"), F.lit(" is no Polygon or MultiPolygon"))
    shape = F.when(shape.isNull(), F.raise_error(message).cast("array<array<array<struct<lon:double,lat:double>>>>")).otherwise(shape)
    return each.select(F.col("ord").cast("long").alias("ord"), F.coalesce(props, F.create_map().cast("map<string,string>")).alias("props"), shape.alias("geometry"))


def feature_lines(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One GeoJSON Feature a row as text: properties by name, MultiPolygon."""
    rest = sorted(c for c in df.columns if c != geometry)
    props = F.to_json(F.struct(*rest))
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), G.geojson_geometry(F.col(geometry)), F.lit("}")).alias("value"))


def write_features(df: DataFrame, path: str, order: str, geometry: str = "geometry") -> None:
    """One document, in order, written by the executors part by part."""

    def encode(batches: Iterator) -> Iterator[bytes]:
        first = True
        for b in batches:
            for v in b.column(0).to_pylist():
                yield (b"" if first else b",\n") + v.encode()
                first = False

    head = b'{"type": "FeatureCollection", "features": [\n'
    joined(feature_lines(df.orderBy(order), geometry), path, encode, head, b",\n", b"\n]}\n")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """All-text table with ``ord``: CSV with a header, or a JSON array of
    objects, by the path's ending; cells trimmed, a ragged row is an error."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "csv":
        df = spark.read.csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    elif ending == "json":
        df = spark.read.json(path, multiLine=True, primitivesAsString=True, mode="FAILFAST")
    else:
        raise ValueError("a mapping ends in .csv or .json")
    cells = [F.coalesce(trimmed(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in df.columns]
    return df.select(F.monotonically_increasing_id().alias("ord"), *cells)


def output_format(path: str, wanted: str = "") -> str:
    """geojson, csv or topojson: as wanted, else by the path's ending."""
    kind = (wanted or path.rsplit(".", 1)[-1]).lower()
    if kind == "json":
        kind = "geojson"
    if kind not in ("geojson", "csv", "topojson"):
        raise ValueError(f"unknown format {kind!r}")
    return kind


def write_topojson(territories: DataFrame, path: str) -> None:
    """One document with an arc for each ring, none shared.  Territories and
    arcs are streamed in order, so the driver holds one of them at a time."""
    from tilewright.operators.territory import topojson_arcs

    shapes = territories.select("territory_id", G.rounded(F.col("geometry")).alias("geometry"))
    numbered = topojson_arcs(shapes).select("arc", "territory_id", "polygon", "ring", "points")
    of = numbered.groupBy("territory_id", "polygon").agg(F.array_sort(F.collect_list(F.struct("ring", "arc"))).alias("r"))
    of = of.groupBy("territory_id").agg(F.array_sort(F.collect_list(F.struct("polygon", F.transform("r", lambda x: F.array(x["arc"])).alias("arcs")))).alias("p"))
    rest = sorted(c for c in territories.columns if c != "geometry")
    props = territories.select("territory_id", F.to_json(F.struct(*rest)).alias("props"))
    rows = props.join(of, "territory_id", "left").select("territory_id", "props", F.to_json(F.coalesce(F.transform("p", lambda x: x["arcs"]), F.array().cast("array<array<array<long>>>"))).alias("arcs"))
    arcs = numbered.orderBy("arc").select(F.to_json(F.transform("points", lambda q: F.array(q["lon"], q["lat"]))).alias("points"))
    with open(path, "w") as f:
        f.write('{"type": "Topology", "objects": {"territories": {"type": "GeometryCollection", "geometries": [')
        for i, r in enumerate(rows.orderBy("territory_id").toLocalIterator()):
            f.write(("," if i else "") + f'{{"type": "MultiPolygon", "id": {json.dumps(r.territory_id)}, "properties": {r.props}, "arcs": {r.arcs}}}')
        f.write(']}}, "arcs": [')
        for i, r in enumerate(arcs.toLocalIterator()):
            f.write(("," if i else "") + r.points)
        f.write("]}\n")


def topojson(territories: DataFrame) -> str:
    """The same as text, for documents that fit the driver."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "t.topojson")
        write_topojson(territories, path)
        with open(path) as f:
            return f.read()
