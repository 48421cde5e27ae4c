"""Columns from text: file names, serialized arrays and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_year(text: Column, strict: bool = False) -> Column:
    """The last four digits that can be a year (1000-2999), as an int; without any, null, or an error if strict."""
    found = F.regexp_extract(text, ".*([1-2][0-9]{3})", 1)
    missing = F.raise_error(F.concat(F.lit("no year in "), F.coalesce(text, F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(found == "", missing).otherwise(found.try_cast("int"))


def number_array(text: Column, zeros: bool = False) -> Column:
    """`[0 12 15]` as an array of ints; zeros stand for "none" and go, unless they are asked for."""
    parts = F.filter(F.split(F.trim(F.translate(text, "[],", "   ")), r"\s+"), lambda s: s != "")
    numbers = F.transform(parts, lambda s: s.cast("int"))
    return numbers if zeros else F.filter(numbers, lambda n: n != 0)


def array_text(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda n: n.cast("string")), " "), F.lit("]"))


def count_map(text: Column) -> Column:
    """`{3: 120, 15: 40}` as a map of ints to longs."""
    pairs = F.filter(F.split(F.translate(text, "{} ", ""), ","), lambda s: s != "")
    entries = F.transform(pairs, lambda s: F.struct(F.get(F.split(s, ":"), 0).cast("int").alias("key"), F.get(F.split(s, ":"), 1).cast("long").alias("value")))
    return F.map_from_entries(entries)


def map_sum(counts: Column, keys: list[int] | None = None) -> Column:
    """Sum over a map's values, of some keys or all."""
    kept = F.map_filter(counts, lambda k, _: k.isin(*keys)) if keys is not None else counts
    return F.aggregate(F.map_values(kept), F.lit(0).cast("long"), lambda a, x: a + x)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def digit_runs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda s: s.cast("long"))


def satellite_year(name: Column, satellite: tuple[int, int] = (0, 3), year: tuple[int, int] = (4, 8)) -> tuple[Column, Column]:
    """Satellite and year at fixed places of a file name."""
    (a, b), (c, d) = satellite, year
    return F.substring(name, a + 1, b - a), F.substring(name, c + 1, d - c).try_cast("int")


def map_link(lon: Column, lat: Column, base: str = "https://maps.invalid/?q=") -> Column:
    return F.concat(F.lit(base), F.format_string("%.5f,%.5f", lat, lon))
