"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, value: Column, prefix: str = "") -> DataFrame:
    """One column for each listed value; the list keeps the plan free of a job that looks for them."""
    out = df.groupBy(*keys).pivot(column, list(values)).agg(value)
    return out.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values}) if prefix else out


def long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def split_prefixed(df: DataFrame, keys: Sequence[str], prefixes: Sequence[str], fields: Sequence[str], name: str = "side") -> DataFrame:
    """Columns `<prefix><field>` as one row for each prefix."""
    rows = F.array(*(F.struct(F.lit(p.rstrip("_")).alias(name), *(F.col(p + f).alias(f) for f in fields)) for p in prefixes))
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, f"_r.{name}", *(f"_r.{f}" for f in fields))


def transposed(df: DataFrame, key: str, columns: Sequence[str], values: Sequence) -> DataFrame:
    """Columns as rows and the listed keys as columns."""
    return long(df, [key], columns, "name", "value").groupBy("name").pivot(key, list(values)).agg(F.first("value"))


def renamed(df: DataFrame, names: Mapping[str, str] | None = None, prefix: str = "", suffix: str = "", keep: Sequence[str] = ()) -> DataFrame:
    out = df.withColumnsRenamed(dict(names or {}))
    return out.toDF(*(c if c in keep else f"{prefix}{c}{suffix}" for c in out.columns)) if prefix or suffix else out


def picked(df: DataFrame, containing: str | None = None, starting: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose names hold or begin with a text, and those to keep."""
    return df.select([c for c in df.columns if c in keep or (containing is not None and containing in c) or (starting is not None and c.startswith(starting))])


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi join; columns of both sides with one name get suffixes."""
    both = [c for c in left.columns if c in right.columns and c not in keys]
    return left.withColumnsRenamed({c: c + suffixes[0] for c in both}).join(right.withColumnsRenamed({c: c + suffixes[1] for c in both}), list(keys), how)


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def map_columns(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[int], prefix: str = "c") -> DataFrame:
    """A map's values for the listed keys as columns, 0 where it has none; no shuffle."""
    return df.select(*keys, *(F.coalesce(F.try_element_at(F.col(column), F.lit(v)), F.lit(0)).alias(f"{prefix}{v}") for v in values))
