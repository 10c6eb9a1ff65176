"""Tile and coordinate arithmetic as Column expressions.

Rows count from the top in the XYZ scheme and from the bottom in the TMS
scheme; tables hold TMS rows.  All tile numbers are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two latitude limits of Web Mercator, the tile extent, zoom limits.
LATITUDE_LIMIT = 85.05112878
ROUTE_LATITUDE_LIMIT = 85.0511287798066
EXTENT = 4096
MAX_ZOOM = 30


def side(z: Column) -> Column:
    """Tiles along one side at zoom ``z``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))


def mercator_x(lon: Column, z: Column) -> Column:
    """Distance from the left edge in tiles."""
    return (lon + 180) / 360 * F.pow(F.lit(2.0), z)


def mercator_y(lat: Column, z: Column, limit: float = LATITUDE_LIMIT) -> Column:
    """Distance from the top edge in tiles."""
    a = F.greatest(F.least(lat, F.lit(limit)), F.lit(-limit))
    rad = a * F.pi() / 180
    return (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / F.pi()) / 2 * F.pow(F.lit(2.0), z)


def _cell(value: Column, z: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor(value).cast("long"), side(z) - 1))


def tile_x(lon: Column, z: Column) -> Column:
    return _cell(mercator_x(lon, z), z)


def tile_y(lat: Column, z: Column, limit: float = LATITUDE_LIMIT) -> Column:
    """XYZ row."""
    return _cell(mercator_y(lat, z, limit), z)


def flip_row(y: Column, z: Column) -> Column:
    """XYZ row to TMS row and back."""
    return side(z) - 1 - y


def valid_key(z: Column, x: Column, y: Column) -> Column:
    n = side(z)
    return (z >= 0) & (z <= MAX_ZOOM) & (x >= 0) & (x < n) & (y >= 0) & (y < n)


def pixel_x(lon: Column, z: Column, x: Column) -> Column:
    return F.round((mercator_x(lon, z) - x) * EXTENT).cast("long")


def pixel_y(lat: Column, z: Column, y: Column) -> Column:
    """``y`` is the XYZ row."""
    return F.round((mercator_y(lat, z) - y) * EXTENT).cast("long")


def _halves(z: Column, down: bool) -> Column:
    """Half the side of the square at each level of zoom ``z``, a slice of constants."""
    sides = [F.lit(1 << a).cast("long") for a in range(MAX_ZOOM)]
    return F.slice(F.array(*sides[::-1]), MAX_ZOOM + 1 - z, z) if down else F.slice(F.array(*sides), F.lit(1), z)


def _first_of_zoom(z: Column) -> Column:
    """Number of tiles at the zooms below: (4**z - 1) / 3, exact in 64 bits."""
    return F.get(F.array(*(F.lit((4**a - 1) // 3).cast("long") for a in range(MAX_ZOOM + 2))), z)


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """Number of an XYZ tile along the Hilbert curves of all zooms in turn."""
    start = F.struct(F.expr("0L").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(s: Column, half: Column) -> Column:
        lx, ly = s["x"].bitwiseAND(half - 1), s["y"].bitwiseAND(half - 1)
        right, low = s["x"].bitwiseAND(half) != 0, s["y"].bitwiseAND(half) != 0
        quadrant = F.when(right, F.when(low, F.expr("2L")).otherwise(F.expr("3L"))).otherwise(F.when(low, F.expr("1L")).otherwise(F.expr("0L")))
        mx, my = F.when(right, half - 1 - lx).otherwise(lx), F.when(right, half - 1 - ly).otherwise(ly)
        return F.struct(
            (s["d"] + quadrant * half * half).alias("d"), F.when(low, lx).otherwise(my).alias("x"), F.when(low, ly).otherwise(mx).alias("y")
        )

    return _first_of_zoom(z) + F.aggregate(_halves(z, True), start, step, lambda s: s["d"])


def hilbert_zoom(tile_id: Column) -> Column:
    """Zoom of a Hilbert number: 4**z <= 3 id + 1 < 4**(z+1)."""
    return F.floor((F.length(F.bin(tile_id * 3 + 1)) - 1) / 2).cast("int")


def hilbert_xy(tile_id: Column) -> Column:
    """struct(z, x, y) of a Hilbert number, XYZ scheme."""
    z = hilbert_zoom(tile_id)
    start = F.struct((tile_id - _first_of_zoom(z)).alias("d"), F.expr("0L").alias("x"), F.expr("0L").alias("y"))

    def step(s: Column, half: Column) -> Column:
        q = s["d"].bitwiseAND(3)
        right, low = q >= 2, (q == 1) | (q == 2)
        mx, my = F.when(right, half - 1 - s["x"]).otherwise(s["x"]), F.when(right, half - 1 - s["y"]).otherwise(s["y"])
        x, y = F.when(low, s["x"]).otherwise(my), F.when(low, s["y"]).otherwise(mx)
        return F.struct(F.shiftright(s["d"], 2).alias("d"), (x + F.when(right, half).otherwise(0)).alias("x"), (y + F.when(low, half).otherwise(0)).alias("y"))

    out = F.aggregate(_halves(z, False), start, step)
    return F.struct(z.alias("z"), out["x"].alias("x"), out["y"].alias("y"))


def range_size(x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
    """Tiles of an inclusive rectangle; overflow is an error under ANSI rules."""
    return (x_max - x_min + 1) * (y_max - y_min + 1)


def parse_xyz_path(path: Column, extension: str = "mvt") -> Column:
    """struct(z, x, y) of ``z/x/y[.ext]``; null where the path is none."""
    pattern = rf"^/?([0-9]+)/([0-9]+)/([0-9]+)(?:\.{extension})?$"
    parts = [F.try_to_number(F.nullif(F.regexp_extract(path, pattern, i), F.lit("")), F.lit("9" * 18)).cast("long") for i in (1, 2, 3)]
    z, x, y = parts
    ok = F.coalesce((F.greatest(z, x, y) <= 1 << 30) & (z <= MAX_ZOOM), F.lit(False))
    n = side(F.when(ok, z).otherwise(F.lit(0)))
    return F.when(ok & (x < n) & (y < n), F.struct(z.alias("z"), x.alias("x"), y.alias("y")))


def be64(value: Column) -> Column:
    """A non-negative number as hexadecimal digits of 8 big-endian bytes."""
    return F.lpad(F.hex(value.cast("long")), 16, "0")


def be32(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("long")), 8, "0")


def cache_key(dataset: Column, revision: Column, z: Column, x: Column, y: Column) -> Column:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return F.concat(F.lit("tile:"), digest(dataset), F.lit(":"), digest(revision), F.lit(":"), F.concat_ws("/", z, x, y))


def etag(revision: Column, scheme: str, z: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit('"'), revision, F.lit(f":{scheme}:"), F.concat_ws("/", z, x, y), F.lit('"'))


def tile_url(template: str, revision: Column, z: Column, x: Column, y: Column) -> Column:
    """The template with its four places filled in one pass: what is filled in
    is not looked at again."""
    out: list[Column] = []
    places = {"{z}": z.cast("string"), "{x}": x.cast("string"), "{y}": y.cast("string"), "{revision}": F.replace(F.url_encode(revision), F.lit("+"), F.lit("%20"))}
    rest = template
    while rest:
        at = min((rest.find(p) for p in places if p in rest), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        place = next(p for p in places if rest.startswith(p, at))
        out += [F.lit(rest[:at]), places[place]]
        rest = rest[at + len(place) :]
    return F.concat(*out)
