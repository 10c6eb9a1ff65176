"""From files to published tile sets: imports and builds."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import osm, tileset
from tilewright.sources import geojson, mbtiles, pmtiles, register


def checked_inputs(paths: list[str], output: str) -> list[str]:
    """Input files once each; they must be there, not empty, and outside the output."""
    out = os.path.abspath(output)
    own = list(dict.fromkeys(os.path.abspath(p.strip()) for p in paths if p.strip()))
    if not own:
        raise ValueError("there is no input")
    for p in own:
        if not os.path.isfile(p) or not os.path.getsize(p):
            raise ValueError(f"{p} is no file with content")
        if p == out or p.startswith(out + os.sep):
            raise ValueError(f"{p} lies in the output")
    return own


def provenance(paths: list[str], **more: str) -> dict[str, str]:
    """Metadata rows on where a set came from: names of files, never their folders."""
    return {"source:files": ",".join(os.path.basename(p) for p in paths), **{f"source:{k}": v for k, v in more.items()}}


def _rows(spark: SparkSession, meta: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(meta.items()), "name string, value string")


def import_archive(spark: SparkSession, path: str, output: str, replace: bool = False) -> dict:
    """Publish a PMTiles or MBTiles file, told apart by content; its manifest."""
    (path,) = checked_inputs([path], output)
    register(spark)
    with open(path, "rb") as f:
        packed = pmtiles.is_archive(f.read(8))
    if packed:
        tiles, meta = spark.read.format("pmtiles").load(path), pmtiles.metadata_rows(path)
    else:
        tiles, meta = spark.read.format("mbtiles").load(path), mbtiles.metadata(path)
    tiles = tiles.select("z", "x", "y", "data")
    if tiles.isEmpty():
        raise ValueError(f"{path} holds no tile")
    kind = "pmtiles" if packed else f"mbtiles {mbtiles.layout(path)}"
    return tileset.publish(tiles, _rows(spark, meta | provenance([path], kind=kind)), output, source=os.path.basename(path), replace=replace, provenance=imported(tiles, path, kind, meta))


def imported(tiles: DataFrame, path: str, kind: str, meta: dict[str, str]) -> dict:
    """What an import took in, for the manifest: the file's name and size, tiles,
    bytes, zooms and how rows and payloads were carried over."""
    s = tiles.agg(F.count("*").alias("tiles"), F.sum(F.octet_length("data").cast("long")).alias("bytes"), F.min("z").alias("low"), F.max("z").alias("high")).first()
    out = {
        "mode": kind, "source": os.path.basename(path), "source_bytes": os.path.getsize(path), "tiles": s.tiles, "tile_bytes": s.bytes, "minzoom": s.low, "maxzoom": s.high,
        "coordinates": "xyz rows turned to tms" if kind == "pmtiles" else "tms rows kept", "payloads": "unchanged",
    }
    more = {"format": meta.get("format"), "tile_content_encoding": meta.get("kb:content_encoding")}
    return out | {k: v for k, v in more.items() if v}


def build_pbf(spark: SparkSession, paths: list[str], output: str, preset: str = "", postal_codes: bool | None = None, replace: bool = False, sidecar: str | None = None) -> dict:
    """Build vector tiles from map files and publish them; with postal codes
    also their areas as GeoJSON at ``sidecar``."""
    low, high, tolerance, suggested = osm.preset(preset)
    postal = suggested if postal_codes is None else postal_codes
    own = checked_inputs(paths, output)
    register(spark)
    read = lambda e: spark.read.format("osmpbf").option("entity", e).load(",".join(own))
    nodes, ways, relations = read("nodes"), read("ways"), read("relations") if postal else None
    box = osm.bounds(nodes, osm.renderable(ways)).first()
    if box.min_lon is None:
        raise ValueError("nothing in the input can be drawn")
    tiles, feats = osm.build_osm(nodes, ways, relations, low, high, tolerance)
    name = os.path.splitext(os.path.basename(own[0]))[0]
    meta = osm.stream_metadata(name, (box.min_lon, box.min_lat, box.max_lon, box.max_lat), low, high, postal)
    made = {"mode": "osm pbf", "sources": [os.path.basename(p) for p in own], "source_bytes": sum(map(os.path.getsize, own)), "preset": preset or "balanced", "minzoom": low, "maxzoom": high, "simplify_pixels": tolerance, "postal_codes": postal}
    manifest = tileset.publish(tiles, _rows(spark, meta | provenance(own, preset=preset or "balanced")), output, source=name, replace=replace, provenance=made)
    if postal and sidecar:
        areas = feats.filter("layer = 'postal_code'").select("ord", F.col("props")["postcode"].alias("postcode"), F.coalesce(F.col("props")["name"], F.lit("")).alias("name"), "rings")
        points = F.transform("rings", lambda r: r["points"])
        geojson.write_features(areas.select("postcode", "name", F.array(points).alias("geometry")), sidecar, "postcode")
    return manifest


def size_ratio(spark: SparkSession, source: str, published: str) -> dict[str, float]:
    """Bytes of a source and of a published set, and their ratio."""
    size = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    a, b = size(source), size(published)
    return {"source_bytes": a, "published_bytes": b, "ratio": b / a if a else 0.0}
