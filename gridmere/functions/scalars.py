"""Scalar column expressions for areas, classes, bands and cleaned numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODATA = 255
#: Transition codes count in this order of classes; fixed values.
CLASS_ORDER = ("crop", "forest", "savanna", "grassland", "pasture")
#: Land-cover codes by class; fixed values.
CLASS_CODES = {"crop": (18, 19, 39, 20, 40, 62, 41, 36, 46, 47, 35, 48), "forest": (3,), "savanna": (4,), "grassland": (12,), "pasture": (15,)}
#: Pairs of bands (from 0) of the normalized differences of each sensor; fixed values.
DIFFERENCE_BANDS = {"landsat": ((4, 5), (2, 5), (2, 4), (4, 3)), "sentinel": ((3, 7), (1, 7), (1, 3), (3, 2))}


def square_metres(pixels: Column, side: float = 10.0) -> Column:
    return pixels * (side * side)


def hectares(pixels: Column, side: float = 10.0) -> Column:
    return pixels * (side * side) / 10_000


def square_km(pixels: Column, side: float = 10.0) -> Column:
    return pixels * (side * side) / 1_000_000


def capped(value: Column, most: int = 254) -> Column:
    """Whole part, at most `most`: how areas are burnt into byte rasters."""
    return F.least(F.floor(value), F.lit(most))


def size_class(value: Column, bounds: Sequence[float], closed: str = "left") -> Column:
    """Number of the interval that holds the value: [lo, hi) if closed is left, (lo, hi] if right; 0 is below the first."""
    if closed not in ("left", "right"):
        raise ValueError("closed is left or right")
    out = F.when(value.isNull(), None).otherwise(0)
    for i, bound in enumerate(bounds, 1):
        out = F.when(value >= bound if closed == "left" else value > bound, i).otherwise(out)
    return out


def clean_number(text: Column, placeholders: Sequence[str] = ("-", "...", ".."), default: float | None = None) -> Column:
    """A number; placeholders and anything else that is no number become the default."""
    number = F.when(F.trim(text).isin(*placeholders), None).otherwise(text.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(default))


def number_with_separators(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def capitalized(text: Column) -> Column:
    """First letter upper-case, the others lower-case, of the text as a whole."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 1 << 30)))


def mapped(value: Column, mapping: Mapping, default=None) -> Column:
    """Value by dictionary; what is not in it becomes the default."""
    out = F.lit(default)
    for key, new in mapping.items():
        out = F.when(value == key, F.lit(new)).otherwise(out)
    return out


def replaced(value: Column, mapping: Mapping) -> Column:
    """Value by dictionary; what is not in it stays."""
    return F.coalesce(mapped(value, mapping), value)


def class_fractions(shares: Mapping[str, Column], natural: Sequence[str], water: Sequence[str]) -> dict[str, Column]:
    """Fractions of natural land, water and the rest, and natural and the rest without the water."""
    part = {n: sum((F.coalesce(shares[c], F.lit(0.0)) for c in names), F.lit(0.0)) for n, names in (("natural", natural), ("water", water))}
    part["other"] = 1 - part["natural"] - part["water"]
    dry = 1 - part["water"]
    return part | {"natural_dry": F.try_divide(part["natural"], dry), "other_dry": F.try_divide(part["other"], dry)}


def null_if_nan(df: DataFrame) -> DataFrame:
    """NaN stands for a missing value in the inputs; NULL does here."""
    fields = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None)) for n in fields}) if fields else df


def rescaled(value: Column, low: Column, high: Column) -> Column:
    """To 0..255, clipped above, halves to even."""
    return F.bround(255 * (F.least(value, high) - low) / (high - low))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where that is undefined."""
    return F.coalesce(F.try_divide(a - b, a + b), F.lit(0.0))


def difference_byte(a: Column, b: Column) -> Column:
    """The normalized difference on 0..255."""
    return F.bround((normalized_difference(a, b) + 1) * 127.5)


def standardized(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def quantized(probability: Column, scale: int = 254, nodata: Column | None = None) -> Column:
    """A probability as a byte, halves to even; 255 where nodata holds."""
    byte = F.bround(probability * scale).cast("int")
    return byte if nodata is None else F.when(nodata, NODATA).otherwise(byte)


def byte_scaled(value: Column, low: Column, high: Column) -> Column:
    """Bytes from a band's range, with zeros kept zero."""
    return F.when(value == 0, 0).otherwise(F.bround(255 * F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))).cast("int"))


def land_class(agriculture: Column, natural: Column, least: int = 1000) -> Column:
    """natural, ag or other, from pixel counts; counts of exactly `least` decide nothing."""
    return F.when((agriculture < least) & (natural > least), "natural").when(agriculture > least, "ag").otherwise("other")


def property_class(shares: Mapping[str, Column], agriculture: Sequence[str] = ("crop", "pasture"), least: float = 0.1) -> Column:
    """The larger agricultural class where their shares exceed `least` together, else the largest class."""
    together = sum((shares[n] for n in agriculture), F.lit(0.0))
    return F.when(together > least, largest_name({n: shares[n] for n in agriculture})).otherwise(largest_name(shares))


def largest_name(values: Mapping[str, Column]) -> Column:
    """Name of the greatest value, the first of equal ones; null if all are null."""
    most = F.greatest(*values.values()) if len(values) > 1 else next(iter(values.values()))
    out = F.lit(None).cast("string")
    for name, value in reversed(list(values.items())):
        out = F.when(value == most, name).otherwise(out)
    return out


def class_of_code(code: Column, codes: Mapping[str, Sequence[int]] = CLASS_CODES) -> Column:
    out = F.lit(None).cast("string")
    for name, values in codes.items():
        out = F.when(code.isin(*values), name).otherwise(out)
    return out


def transition_code(before: Column, after: Column, order: Sequence[str] = CLASS_ORDER) -> Column:
    """1 + 5 * place of the class before + place of the class after; 0 if either is in none of the classes."""
    places = {n: i for i, n in enumerate(order)}
    return F.coalesce(len(order) * mapped(before, places) + mapped(after, places) + 1, F.lit(0))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)
