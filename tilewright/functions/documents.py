"""Formats, TileJSON and style documents of a tile set."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.text import number, trimmed

VECTOR = "application/vnd.mapbox-vector-tile"
#: Content type, extension and the names of each format.
FORMATS = [
    (VECTOR, "mvt", "", ["pbf", "mvt", VECTOR]),
    ("image/png", "png", "", ["png", "image/png"]),
    ("image/jpeg", "jpg", "", ["jpg", "jpeg", "image/jpg", "image/jpeg"]),
    ("image/webp", "webp", "", ["webp", "image/webp"]),
    ("image/avif", "avif", "", ["avif", "image/avif"]),
    ("image/gif", "gif", "", ["gif", "image/gif"]),
    ("image/tiff", "tif", "", ["tif", "tiff", "image/tiff"]),
    ("image/svg+xml", "svg", "", ["svg", "image/svg+xml"]),
    ("application/json", "json", "", ["json", "application/json"]),
    ("application/geo+json", "geojson", "", ["geojson", "application/geo+json"]),
    ("image/png", "png", "terrarium", ["terrarium"]),
    ("image/png", "png", "mapbox", ["terrain-rgb", "terrainrgb", "terrain-rgb-v2"]),
    ("image/webp", "webp", "terrarium", ["webp-terrarium"]),
]
#: Names of elevation encodings.
ENCODINGS = {"terrarium": "terrarium", "mapbox": "mapbox", "terrain-rgb": "mapbox", "terrainrgb": "mapbox", "custom": "custom"}


def tile_format(name: Column, encoding: Column) -> Column:
    """struct(content_type, extension, encoding) of a format's name; unknown
    names are octet streams with ``mvt``.  A declared elevation encoding counts
    before the name's own; vector tiles have none."""
    key = F.lower(trimmed(F.coalesce(name, F.lit(""))))
    declared = F.lower(trimmed(F.coalesce(encoding, F.lit(""))))
    kind, ext, own = F.lit("application/octet-stream"), F.lit("mvt"), F.lit("")
    for content_type, extension, enc, names in FORMATS:
        hit = key.isin(names)
        kind, ext, own = F.when(hit, content_type).otherwise(kind), F.when(hit, extension).otherwise(ext), F.when(hit, enc).otherwise(own)
    for alias, value in ENCODINGS.items():
        own = F.when(declared == alias, value).otherwise(own)
    return F.struct(kind.alias("content_type"), ext.alias("extension"), F.when(kind == VECTOR, "").otherwise(own).alias("encoding"))


def normal_extension(value: Column) -> Column:
    """A file extension of 1 to 16 lower-case letters or digits; null for others."""
    v = F.lower(F.regexp_replace(trimmed(value), "^\\.", ""))
    return F.when(F.regexp_like(v, F.lit("^[a-z0-9]{1,16}$")), v)


def whole_number(text: Column, otherwise: int) -> Column:
    t = trimmed(F.coalesce(text, F.lit("")))
    return F.coalesce(F.when(F.regexp_like(t, F.lit("^[+-]?[0-9]{1,18}$")), t.try_cast("long")), F.lit(otherwise).cast("long"))


def number_list(text: Column, n: int) -> Column:
    """``n`` numbers between commas; null for anything else."""
    parts = F.transform(F.split(text, ","), lambda p: number(trimmed(p)))
    return F.when((F.size(parts) == n) & ~F.exists(parts, lambda p: p.isNull()), parts)


def tilejson(metadata: dict[str, str], tile_url: str, scheme: str = "xyz") -> dict:
    """The TileJSON document of a set's metadata."""

    def whole(name: str, otherwise: int) -> int:
        try:
            return int(metadata.get(name, "").strip())
        except ValueError:
            return otherwise

    def numbers(name: str, n: int) -> list[float] | None:
        try:
            parts = [float(p) for p in metadata.get(name, "").split(",")]
        except ValueError:
            return None
        return parts if len(parts) == n else None

    out = {"tilejson": "3.0.0", "name": metadata.get("name") or "tiles", "scheme": scheme, "tiles": [tile_url], "minzoom": whole("minzoom", 0), "maxzoom": whole("maxzoom", 22)}
    for key, n in (("bounds", 4), ("center", 3)):
        if (v := numbers(key, n)) is not None:
            out[key] = v
    for key in ("attribution", "description", "version"):
        if metadata.get(key):
            out[key] = metadata[key]
    try:
        extra = json.loads(metadata.get("json") or "{}")
    except ValueError:
        extra = {}
    if isinstance(extra, dict) and metadata.get("format") in ("pbf", "mvt", VECTOR):
        out |= {k: extra[k] for k in ("vector_layers", "tilestats") if k in extra}
    return out


#: Colours of the layers this engine writes, in drawing order.
_PAINT = [
    ("water", "fill", {"fill-color": "#9cc9e0"}),
    ("landcover", "fill", {"fill-color": "#cfe3c0"}),
    ("transportation", "line", {"line-color": "#c98a5a", "line-width": 1.2}),
    ("building", "fill", {"fill-color": "#d8cfc4"}),
    ("postal_code", "line", {"line-color": "#7a5ea8", "line-dasharray": [3, 2]}),
]


def style(metadata: dict[str, str], tile_url: str, vector: bool = True) -> dict:
    """A map style: raster, or a layer for each known vector layer that the
    metadata declares."""
    doc = tilejson(metadata, tile_url)
    source = {"type": "vector" if vector else "raster", "tiles": [tile_url], "minzoom": doc["minzoom"], "maxzoom": doc["maxzoom"]}
    layers: list[dict] = [{"id": "background", "type": "background", "paint": {"background-color": "#f4f1ea"}}]
    if vector:
        there = {x.get("id") for x in doc.get("vector_layers", []) if isinstance(x, dict)}
        layers += [{"id": name, "type": kind, "source": "tiles", "source-layer": name, "paint": paint} for name, kind, paint in _PAINT if name in there]
    else:
        source["tileSize"] = 256
        layers.append({"id": "raster", "type": "raster", "source": "tiles"})
    return {"version": 8, "name": doc["name"], "sources": {"tiles": source}, "layers": layers}
