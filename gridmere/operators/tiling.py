"""Tile indexes, samples of tiles, and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import numbered


def starts(length: int, size: int, overlap: int = 0) -> Column:
    """Starts of tiles along one axis; a last tile stands flush with the end."""
    if size <= overlap:
        raise ValueError("a tile must be larger than the overlap")
    step = size - overlap
    regular = F.sequence(F.lit(0), F.lit(max(length - size, 0)), F.lit(step))
    return F.array_distinct(F.concat(regular, F.array(F.lit(max(length - size, 0)))))


def tile_index(spark: SparkSession, rows: int, cols: int, size: int, overlap: int = 0) -> DataFrame:
    """(row_start, col_start) of all tiles of a raster."""
    base = spark.range(1).select(F.explode(starts(rows, size, overlap)).alias("row_start"))
    return base.select("row_start", F.explode(starts(cols, size, overlap)).alias("col_start"))


def split(df: DataFrame, name: str, test: float, validation: float, seed: str = "", stratum: Column | None = None) -> DataFrame:
    """train, val or test for each row, in the order of a hash of its name, and the same at any cluster size: round(n *
    (1 - test - validation)) rows train, round(n * test) test, the rest validate. Strata split on their own.

    Ranks come from sorted ranges of all rows, less the first rank of the stratum, so that no task holds a stratum.
    """
    own = df.select("*", (stratum if stratum is not None else F.lit(0)).alias("_s"), F.md5(F.concat(F.lit(seed), F.col(name).cast("string"))).alias("_h"))
    ranked = numbered(own, ["_s", "_h", name], "_k")
    strata = ranked.groupBy(F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_n"), (F.min("_k") - 1).alias("_before"))
    placed = ranked.join(strata, F.col("_s").eqNullSafe(F.col("_t"))).withColumn("_k", F.col("_k") - F.col("_before"))
    train, tested = F.round(F.col("_n") * (1 - test - validation)), F.round(F.col("_n") * test)
    part = F.when(F.col("_k") <= train, "train").when(F.col("_k") <= train + tested, "test").otherwise("val")
    return placed.withColumn("part", part).drop("_s", "_h", "_n", "_k", "_t", "_before")


def full_tiles(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(tile_row, tile_col, n) of tiles in which each cell is there and none is 0."""
    tile = [F.floor(F.col("row") / height).alias("tile_row"), F.floor(F.col("col") / width).alias("tile_col")]
    counted = cells.groupBy(*tile).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("value") != 0).alias("full"))
    return counted.filter(F.col("full") & (F.col("n") == height * width)).drop("full")


def drawn_tiles(tiles: DataFrame, count: int, seed: int) -> DataFrame:
    """`count` tiles in the order of a digest of seed and tile, the same at any cluster size."""
    place = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("tile_row").cast("string"), F.col("tile_col").cast("string")))
    return tiles.orderBy(place, "tile_row", "tile_col").limit(count)
