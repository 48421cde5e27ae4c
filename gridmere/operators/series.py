"""Windows over ordered rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import cut


def expanding_mean(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def rolling_mean(value: str, keys: Sequence[str], order: Sequence[str], rows: int = 100) -> Column:
    """Over the row and those before it; fewer at the start."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0))


def smoothed(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Mean with the neighbours; of two values at either end."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-1, 1))


def numbered(df: DataFrame, order: Sequence[str], name: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """Numbers from 1 in an order. Without keys, rows are numbered by ranges: each range counts its own rows, and the
    ranges' offsets are added, so that no task holds all rows."""
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranged, _ = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # written: all uses see the same ranges
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_place") + F.col("_offset")).drop("_part", "_place", "_offset")


def first_last_change(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """First and last values in time, and the change in percent of the first."""
    first, last = F.min_by(value, time), F.max_by(value, time)
    return df.groupBy(*keys).agg(first.alias("first_value"), last.alias("last_value"), (100 * F.try_divide(last - first, first)).alias("change_percent"))


def scaled_to(df: DataFrame, keys: Sequence[str], time: str, value: str, base: int, name: str = "scaled") -> DataFrame:
    """Values over the group's value at a base time."""
    at = F.max(F.when(F.col(time) == base, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.try_divide(F.col(value), at))


def group_share(value: str, keys: Sequence[str]) -> Column:
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys)))


def ordered_by_reference(df: DataFrame, key: str, time: str, value: str, at: int) -> DataFrame:
    """Each key's place by its value at one time, greatest first."""
    ref = df.filter(F.col(time) == at).select(key, F.row_number().over(Window.orderBy(F.desc(value), key)).alias("place"))
    return df.join(ref, key, "left")


def first_rows(df: DataFrame, order: Sequence[str], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first n rows in an order, of all or of each group."""
    if keys:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
    return df.orderBy(*order).limit(n)


def without_multiples(df: DataFrame, column: str, of: int) -> DataFrame:
    """Rows whose value is no multiple; null values stay out."""
    return df.filter(F.col(column) % of != 0)


def drawn(df: DataFrame, order: Sequence[str], rows: int, seed: int) -> DataFrame:
    """Exactly `rows` rows drawn with replacement, the same for a seed: places in the order are drawn, and looked up."""
    count = df.count()
    if not count:
        return df
    places = df.sparkSession.range(rows).select((F.floor(F.rand(seed) * count) + 1).cast("long").alias("_drawn"))
    return numbered(df, order, "_drawn").join(places, "_drawn").drop("_drawn")


def without_last(df: DataFrame, order: Sequence[str], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Without the last n rows in an order: a batch that may not have ended is done again."""
    back = [F.desc(c) for c in order]
    if keys:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*back))).filter(F.col("_n") > n).drop("_n")
    last = df.select(*order).orderBy(*back).limit(n)
    return df.join(last, list(order), "left_anti")
