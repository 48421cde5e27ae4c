"""Polygons on grids, row by row along their edges.

An edge is cut by the rows (and columns) that it passes. Along a row, a running sum of what the edges say gives the cells
between them, which need no test. Work grows with the length of the outlines and with the cells that result, never with
boxes times edges; a polygon's edges and rows are dealt to many tasks.

Polygons are rows (key, rings); rows of one key are parts of one polygon. Cells are unit squares, cell (row, col) from
(col, row) on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import winding


def runs(polygons: DataFrame, key: str, rings: str = "rings", x0: float = 0.0, y0: float = 0.0, step: float = 1.0) -> DataFrame:
    """(key, row, first, last): runs of cells whose centres are within a polygon, by the even-odd rule; centres on an edge
    are not within, but for those on level edges (see level_cells)."""
    edges = winding.edges_of(polygons, [key], rings)
    e = edges.select(key, *(((F.col(c) - o) / step).alias(c) for c, o in (("x1", x0), ("y1", y0), ("x2", x0), ("y2", y0))))
    low, high = F.ceil(F.least("y1", "y2") - 0.5), F.ceil(F.greatest("y1", "y2") - 0.5) - 1  # rows whose centre line it crosses
    crossed = e.select("*", low.alias("_a"), high.alias("_b")).filter("_b >= _a").select("*", F.explode(F.sequence("_a", "_b")).alias("row"))
    x = F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    along = Window.partitionBy(key, "row").orderBy("x")
    pairs = crossed.select(key, "row", x.alias("x")).withColumns({"_n": F.row_number().over(along), "_to": F.lead("x").over(along)}).filter("_n % 2 = 1")
    inside = pairs.select(key, "row", (F.floor(F.col("x") - 0.5) + 1).alias("first"), (F.ceil(F.col("_to") - 0.5) - 1).alias("last"))
    return inside.filter("last >= first")


def level_cells(polygons: DataFrame, key: str, rings: str = "rings", x0: float = 0.0, y0: float = 0.0, step: float = 1.0) -> DataFrame:
    """(key, row, col): cells whose centres lie on level edges."""
    edges = winding.edges_of(polygons, [key], rings).filter("y1 = y2")
    e = edges.select(key, *(((F.col(c) - o) / step - 0.5).alias(c) for c, o in (("x1", x0), ("y1", y0), ("x2", x0)))).filter(F.col("y1") == F.floor("y1"))
    ends = e.select(key, F.col("y1").cast("long").alias("row"), F.ceil("x1").alias("_a"), F.floor("x2").alias("_b")).filter("_b >= _a")
    return ends.select(key, "row", F.explode(F.sequence("_a", "_b")).alias("col")).distinct()


def cells_within(polygons: DataFrame, key: str, rings: str = "rings", x0: float = 0.0, y0: float = 0.0, step: float = 1.0) -> DataFrame:
    """(key, row, col): cells whose centres are within each polygon; centres on an edge are not."""
    found = runs(polygons, key, rings, x0, y0, step).select(key, "row", F.explode(F.sequence("first", "last")).alias("col"))
    return found.join(level_cells(polygons, key, rings, x0, y0, step), [key, "row", "col"], "left_anti")


def shares(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, row, col, share): the exact part of each cell that a polygon covers, for cells that it covers any of. Each piece
    of an edge in a cell takes or gives the area on its right: its part of that cell, and all of the cells behind. Parts
    of one polygon must not overlap."""
    edges = winding.edges_of(polygons, [key], rings, oriented=True).filter("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.select("*", F.explode(F.sequence(F.floor(low), F.ceil(high) - 1)).alias("row"))
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    ya, yb = F.greatest(low, F.col("row").cast("double")), F.least(high, F.col("row") + 1.0)
    xa, xb = F.col("x1") + (ya - F.col("y1")) * slope, F.col("x1") + (yb - F.col("y1")) * slope
    sign = F.when(F.col("y2") > F.col("y1"), -F.col("w")).otherwise(F.col("w"))
    cut = rows.select(key, "row", F.least(xa, xb).alias("_l"), F.greatest(xa, xb).alias("_r"), (sign * (yb - ya)).alias("_h"))
    each = cut.select("*", F.explode(F.sequence(F.floor("_l"), F.floor("_r"))).alias("col"))
    a, b = F.greatest("_l", F.col("col").cast("double")), F.least("_r", F.col("col") + 1.0)
    part = F.col("_h") * F.when(F.col("_r") > F.col("_l"), (b - a) / (F.col("_r") - F.col("_l"))).otherwise(1.0)
    told = each.select(key, "row", "col", part.alias("_p"), (part * (F.col("col") + 1 - (a + b) / 2)).alias("_own")).repartition(key, "row").groupBy(key, "row", "col").agg(F.sum("_p").alias("_p"), F.sum("_own").alias("_own"))
    along = Window.partitionBy(key, "row").orderBy("col")
    told = told.withColumns({"_base": F.coalesce(F.sum("_p").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_before": F.lag("col").over(along)})
    between = F.when((F.col("_base") > 1e-9) & (F.col("col") - F.col("_before") > 1), F.transform(F.sequence(F.col("_before") + 1, F.col("col") - 1), lambda c: F.struct(c.alias("c"), F.col("_base").alias("s"))))
    own = F.array(F.struct(F.col("col").alias("c"), (F.col("_base") + F.col("_own")).alias("s")))
    out = told.select(key, "row", F.explode(F.concat(own, F.coalesce(between, F.array().cast("array<struct<c:bigint,s:double>>")))).alias("q")).select(key, "row", F.col("q.c").alias("col"), F.least(F.col("q.s"), F.lit(1.0)).alias("share"))
    return out.filter("share > 1e-12")
