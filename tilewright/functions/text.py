"""String and number rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes.
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def key_of(c: Column) -> Column:
    """Keys compare trimmed and in lower case."""
    return F.lower(trimmed(c))


def prefix(c: Column, n: int) -> Column:
    """The first ``n`` code points; all of them if ``n`` is not positive."""
    return F.substring(c, 1, n) if n > 0 else c


def number(c: Column) -> Column:
    """A plain decimal number as double; null for anything else."""
    return F.when(F.regexp_like(c, F.lit(_NUMBER)), c.try_cast("double"))


def distance_metres(c: Column) -> Column:
    """``50m``, ``0.2km`` or a bare number; empty is 0, negative or other text null."""
    t = trimmed(c)
    unit = F.when(t.endswith("km"), 1000.0).otherwise(1.0)
    digits = trimmed(F.regexp_replace(t, "(km|m)$", ""))
    value = number(digits) * unit
    return F.when(t == "", 0.0).when(value >= 0, value)


def as_text(v: Column) -> Column:
    """A double as text: whole numbers without a fraction."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(v.isNull(), "").when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def sorted_unique(values: Column) -> Column:
    """Distinct values that are not empty, in order."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))


def list_cell(values: Column) -> Column:
    """A list in one CSV cell."""
    return F.array_join(values, "|")
