"""Points in polygons of any size: an index of edges in grid squares.

A polygon with holes and many parts is a table of edges (x1, y1, x2, y2, w), the left end first, where w is +1 for an edge
that was turned left to right (or upwards) and -1 for one that was turned round. What a point needs to know is its winding
number, the signed count of edges on a way to it from outside. The way is chosen so that a point meets few edges: along
the line under its grid square from far left, up to below the point, and then up. Edges on the line left of the square are
counted for all points at once, by a running sum along the line; only the edges of the point's own square are tested.
Squares with many edges are cut into 4 x 4 finer ones, whose own counts follow from the edges at hand. Squares that lie
inside a polygon without an edge are stored with their count alone.

So edges are sent to squares, never polygons to points: work at a point does not grow with the polygon's corners, and a
polygon with a hundred thousand corners is spread over many tasks. Ways run a hair's breadth right of their points, so that
a point straight above a corner counts it once; grid lines are placed where no corner is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..sources.storage import cut, remove

ENDS = ("x1", "y1", "x2", "y2")
#: Edges that a row of a point query's index holds at most: polygons with more in a square go by rows.
HELD = 4096


@dataclass(frozen=True)
class Grid:
    """Squares of a side, cut in 4 x 4 up to `depth` times while they hold over `most` edges. With `whole`, coordinates are
    multiples of 4 and points even numbers, all under 2**29; the side is a multiple of 4 ** (depth + 1); nothing is
    rounded then."""

    side: float
    depth: int = 3
    most: int = 32
    whole: bool = False

    @property
    def offset(self) -> float:
        return 1 if self.whole else self.side * 0.381966011

    def sides(self) -> list:
        return [int(self.side) // 4**k if self.whole else self.side / 4**k for k in range(self.depth + 1)]

    def side_at(self, level: Column) -> Column:
        return F.get(F.array(*(F.lit(s) for s in self.sides())), level)

    def number(self, c: Column, side: Column | float) -> Column:
        """Number of the column or row that holds a coordinate."""
        return F.floor((c - self.offset) / side)

    def line(self, number: Column, side: Column | float) -> Column:
        return number * side + self.offset


def turn(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Positive left of the way from a to b, negative right of it, 0 on it."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def edges_of(polygons: DataFrame, keys: Sequence[str], rings: str = "rings", oriented: bool = False) -> DataFrame:
    """(keys..., x1, y1, x2, y2, w) of polygons given as arrays of closed rings. With `oriented`, outlines (the first
    rings) run anticlockwise and holes clockwise, however they stand; without, only the parity of counts has a meaning."""
    ring = polygons.select(*keys, F.posexplode(rings).alias("_at", "_ring")).filter(F.size("_ring") >= 2)
    sign = F.lit(1)
    if oriented:
        sign = (F.signum(geometry.ring_area(F.col("_ring"))) * F.when(F.col("_at") == 0, 1).otherwise(-1)).cast("int")
    ring = ring.withColumn("_sign", sign)
    pairs = F.transform(F.sequence(F.lit(0), F.size("_ring") - 2), lambda i: F.struct(F.get("_ring", i).alias("p"), F.get("_ring", i + 1).alias("q")))
    each = ring.select(*keys, "_sign", F.explode(pairs).alias("e")).select(*keys, "_sign", *(F.col(f"e.{p}.{c}").alias(f"{c}{k}") for k, p in ((1, "p"), (2, "q")) for c in "xy"))
    return left_to_right(each.withColumnRenamed("_sign", "w"))


def left_to_right(edges: DataFrame) -> DataFrame:
    """Edges with their left (of upright ones, their lower) end first; w changes its sign with the direction."""
    back = (F.col("x1") > F.col("x2")) | (F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2"))
    ends = {a: F.when(back, F.col(b)).otherwise(F.col(a)) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    return edges.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).withColumns(ends | {"w": F.when(back, -F.col("w")).otherwise(F.col("w"))})


def _side(e: Column, x: Column, y: Column) -> Column:
    return turn(e["x1"], e["y1"], e["x2"], e["y2"], x, y)


def _column(grid: Grid, e: Column, y: Column, side: Column | float) -> Column:
    """The last column whose left line is left of the place where an edge crosses a height. The estimate is put right by
    the test that points are held against, so that both agree to the last bit."""
    near = grid.number(e["x1"] + (y - e["y1"]) * F.try_divide((e["x2"] - e["x1"]).cast("double"), (e["y2"] - e["y1"]).cast("double")), side)

    def beyond(c: Column) -> Column:
        at = _side(e, grid.line(c, side), y)
        return F.when(e["y2"] > e["y1"], at > 0).otherwise(at < 0)

    return F.when(~beyond(near), near - 1).when(beyond(near + 1), near + 1).otherwise(near)


def _counted(edges: Column, x0: Column, y0: Column, px: Column, py: Column, at: str) -> Column:
    """Signed count of the edges on the way from a square's lower left corner to a point: along the line, then up. `at` says
    what an edge through the end of the way does: `beside` goes by its slope just right of it, `under` stops below it."""

    def add(acc: Column, e: Column) -> Column:
        up = e["y2"] > e["y1"]
        foot, head, corner = _side(e, px, y0), _side(e, px, py), _side(e, x0, y0)
        crosses = ((e["y1"] > y0) != (e["y2"] > y0)) & F.when(up, (corner > 0) & (foot <= 0)).otherwise((corner < 0) & (foot >= 0))
        below = (head > 0) | ((head == 0) & (e["y2"] < e["y1"])) if at == "beside" else head > 0
        over = (e["x1"] <= px) & (e["x2"] > px) & ((foot < 0) | ((foot == 0) & up)) & below
        return acc + F.when(crosses, F.when(up, -e["w"]).otherwise(e["w"])).otherwise(0) + F.when(over, e["w"]).otherwise(0)

    return F.aggregate(edges, F.lit(0).cast("long"), add)


def _meets(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an edge may share a point with a box."""
    sides = [_side(e, x, y) for x in (x0, x1) for y in (y0, y1)]
    lowest, highest = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    return (e["x1"] <= x1) & (e["x2"] >= x0) & (lowest <= y1) & (highest >= y0) & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def met_squares(edges: DataFrame, grid: Grid, keep: Sequence[str | Column]) -> DataFrame:
    """Adds _gy and _gx: every square of the coarsest grid that an edge meets, found row by row along the edge."""
    side, off = grid.sides()[0], grid.offset
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.select("*", F.explode(F.sequence(grid.number(low, side), grid.number(high, side))).alias("_gy"))
    level = F.col("y1") == F.col("y2")

    def at(y: Column, flat: str) -> Column:
        return F.when(level, F.col(flat).cast("double")).otherwise(F.col("x1") + (y - F.col("y1")) * F.try_divide((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")))

    begin = at(F.greatest(low, grid.line(F.col("_gy"), side)), "x1")
    end = at(F.least(high, grid.line(F.col("_gy") + 1, side)), "x2")
    slack = side * 1e-6
    cols = F.sequence(F.floor((F.least(begin, end) - slack - off) / side), F.floor((F.greatest(begin, end) + slack - off) / side))
    return rows.select(*keep, "_gy", F.explode(cols).alias("_gx"))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows by columns to many tasks: work on squares is far more than their bytes tell, by which Spark would join tasks."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def index(edges: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """(keys..., level, _gx, _gy, base, edges): for each polygon and square that it covers any of, the winding number at
    the square's lower left corner and the edges that meet it. One shuffle, by polygon and grid row."""
    side, off = grid.sides()[0], grid.offset
    e = F.struct(*ENDS, "w")
    squares = met_squares(edges, grid, [*keys, e.alias("e")]).withColumn("s", F.lit(None).cast("long"))
    first, last = F.ceil((F.least("y1", "y2") - off) / side), F.ceil((F.greatest("y1", "y2") - off) / side) - 1
    lines = edges.select(*keys, e.alias("e"), first.alias("_a"), last.alias("_b")).filter("_b >= _a").select(*keys, "e", F.explode(F.sequence("_a", "_b")).alias("_gy"))
    sign = F.when(F.col("e.y2") > F.col("e.y1"), -F.col("e.w")).otherwise(F.col("e.w"))
    crossed = lines.select(*keys, F.lit(None).cast(squares.schema["e"].dataType).alias("e"), "_gy", _column(grid, F.col("e"), grid.line(F.col("_gy"), side), side).alias("_gx"), sign.cast("long").alias("s"))
    row = [*keys, "_gy"]
    told = dealt(squares.select(*crossed.columns).unionByName(crossed), *row).groupBy(*row, "_gx").agg(F.collect_list("e").alias("edges"), F.coalesce(F.sum("s"), F.lit(0)).alias("_s"))
    along = Window.partitionBy(*row).orderBy("_gx")
    base = F.coalesce(F.sum("_s").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = told.withColumns({"base": base, "_before": F.lag("_gx").over(along)})
    own = F.struct("_gx", "base", "edges")
    none = F.filter("edges", lambda _: F.lit(False))
    between = F.when((F.col("base") != 0) & (F.col("_gx") - F.col("_before") > 1), F.transform(F.sequence(F.col("_before") + 1, F.col("_gx") - 1), lambda c: F.struct(c.alias("_gx"), F.col("base"), none.alias("edges"))))
    empty = F.array().cast(f"array<struct<_gx:bigint,base:bigint,edges:{told.schema['edges'].dataType.simpleString()}>>")
    found = told.select(*row, F.explode(F.concat(F.array(own), F.coalesce(between, empty))).alias("q")).select(*keys, F.lit(0).alias("level"), "q._gx", "_gy", "q.base", "q.edges")
    return _refined(found, keys, grid)


def crowds(edges: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """(keys..., level, _gx, _gy, edges): squares with the edges that meet them, cut as finely as the index."""
    ends = F.struct(*ENDS)
    found = dealt(met_squares(edges, grid, [*keys, ends.alias("e")]), *keys, "_gy", "_gx").groupBy(*keys, "_gy", "_gx").agg(F.collect_list("e").alias("edges"))
    return _refined(found.select(*keys, F.lit(0).alias("level"), "_gx", "_gy", F.lit(0).cast("long").alias("base"), "edges"), keys, grid, counted=False).drop("base")


def _refined(found: DataFrame, keys: Sequence[str], grid: Grid, counted: bool = True) -> DataFrame:
    """Squares with many edges cut in 4 x 4, again and again; a square that nothing covers goes."""
    for level in range(grid.depth):
        found = refined_once(found, keys, grid, level, F.size("edges") > grid.most, counted)
    return found


def refined_once(found: DataFrame, keys: Sequence[str], grid: Grid, level: int, full: Column, counted: bool = True) -> DataFrame:
    """Squares of a level cut in 4 x 4 where `full` holds."""
    # other names: in lambdas, a column's name may mean a new column of that name
    now = found.select(*keys, F.col("level").alias("_l"), F.col("_gx").alias("_ox"), F.col("_gy").alias("_oy"), F.col("base").alias("_base"), F.col("edges").alias("_edges"), full.alias("_full"))
    whole = F.struct(F.col("_l").alias("level"), F.col("_ox").alias("_gx"), F.col("_oy").alias("_gy"), F.col("_base").alias("base"), F.col("_edges").alias("edges"))
    parts = F.when((F.col("_l") == level) & F.col("_full"), F.transform(F.sequence(F.lit(0), F.lit(15)), _part(grid, level, counted))).otherwise(F.array(whole))
    return now.select(*keys, F.explode(parts).alias("_q")).select(*keys, "_q.*").filter((F.col("base") != 0) | (F.size("edges") > 0))


def _part(grid: Grid, level: int, counted: bool):
    """Makes one of the 16 parts of a square of a level."""
    side, finer = grid.sides()[level], grid.sides()[level + 1]
    x0, y0 = grid.line(F.col("_ox"), F.lit(side)), grid.line(F.col("_oy"), F.lit(side))

    def part(k: Column) -> Column:
        x, y = x0 + k % 4 * finer, y0 + F.floor(k / 4) * finer
        base = F.col("_base") + _counted(F.col("_edges"), x0, y0, x, y, "beside") if counted else F.col("_base")
        inside = F.filter("_edges", lambda e: _meets(e, x, y, x + finer, y + finer))
        return F.struct(F.lit(level + 1).alias("level"), (F.col("_ox") * 4 + k % 4).alias("_gx"), (F.col("_oy") * 4 + F.floor(k / 4)).alias("_gy"), base.alias("base"), inside.alias("edges"))

    return part


def located(points: DataFrame, squares: DataFrame, grid: Grid, on: Sequence[str] = (), x: str = "x", y: str = "y", at: str = "beside", more: dict[str, Column] | None = None) -> DataFrame:
    """Points (which share the columns `on` with the index) with every polygon that they may be in, and two columns: `winding`, the
    polygon's winding number there, and `on_edge`; `more` names columns made with the square's `edges`. A point meets one
    square of each polygon."""
    places = F.array(*(F.struct(F.lit(k).alias("level"), grid.number(F.col(x), s).alias("_gx"), grid.number(F.col(y), s).alias("_gy")) for k, s in enumerate(grid.sides())))
    sent = points.select("*", F.explode(places).alias("_p")).select(*points.columns, "_p.level", "_p._gx", "_p._gy")
    pairs = sent.join(squares, [*on, "level", "_gx", "_gy"])
    side = grid.side_at(F.col("level"))
    winding = F.col("base") + _counted(F.col("edges"), grid.line(F.col("_gx"), side), grid.line(F.col("_gy"), side), F.col(x), F.col(y), at)

    def on_edge(e: Column) -> Column:
        return (_side(e, F.col(x), F.col(y)) == 0) & F.col(x).between(e["x1"], e["x2"]) & F.col(y).between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return pairs.withColumns({"winding": winding, "on_edge": F.exists("edges", on_edge)} | (more or {})).drop("level", "_gx", "_gy", "base", "edges")


def within_edges(points: DataFrame, edges: DataFrame, key: str, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the keys of the polygons, given by their edges, that they are within, by the even-odd rule. Polygons
    too large for a row are never one."""
    known = points.filter((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    many = met_squares(edges, grid, [key]).groupBy(key, "_gy", "_gx").count().filter(F.col("count") > HELD).select(key).distinct()
    many, path = cut(many)
    if many.isEmpty():
        remove(points.sparkSession, path)
        return _within_few(known, edges, key, grid, x, y)
    few = _within_few(known, edges.join(F.broadcast(many), key, "left_anti"), key, grid, x, y)
    return few.unionByName(_within_many(known, edges.join(F.broadcast(many), key, "left_semi"), key, grid, x, y))


def _within_many(points: DataFrame, edges: DataFrame, key: str, grid: Grid, x: str, y: str) -> DataFrame:
    """The same for polygons with very many edges in a square: all of them go by the finest squares at once. Counts of squares
    are sums of rows; only edges of squares with a point are gathered, HELD at most in a row, and what a point counts in
    several rows is added up. Places are tested once, however many points are there."""
    fine = Grid(grid.sides()[-1], 0, grid.most, grid.whole)
    side, places = fine.side, points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    places = places.withColumns({"_gx": fine.number(F.col("_x"), side), "_gy": fine.number(F.col("_y"), side)})
    squares = met_squares(edges, fine, [key, F.struct(*ENDS, "w").alias("e")])
    counted = squares.groupBy(key, "_gy", "_gx").agg(F.lit(0).cast("long").alias("s"))
    sign = F.when(F.col("y2") > F.col("y1"), -F.col("w")).otherwise(F.col("w")).cast("long")
    first, last = F.ceil((F.least("y1", "y2") - fine.offset) / side), F.ceil((F.greatest("y1", "y2") - fine.offset) / side) - 1
    lines = edges.select("*", first.alias("_a"), last.alias("_b")).filter("_b >= _a").select("*", F.explode(F.sequence("_a", "_b")).alias("_gy"))
    e = F.struct(*ENDS)
    crossed = lines.select(key, "_gy", _column(fine, e, fine.line(F.col("_gy"), side), side).alias("_gx"), sign.alias("s")).groupBy(key, "_gy", "_gx").agg(F.sum("s").alias("s"))
    sums = counted.unionByName(crossed).groupBy(key, "_gy", "_gx").agg(F.sum("s").alias("s"))
    along = Window.partitionBy(key, "_gy").orderBy("_gx")
    runs = sums.withColumns({"base": F.coalesce(F.sum("s").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_before": F.coalesce(F.lag("_gx").over(along), F.col("_gx") - 1)})
    filled = runs.withColumn("_gx", F.explode(F.when(F.col("base") != 0, F.sequence(F.col("_before") + 1, F.col("_gx"))).otherwise(F.array("_gx")))).filter("base <> 0")
    based = places.join(filled.select(key, "_gx", "_gy", "base"), ["_gx", "_gy"]).select("_x", "_y", key, F.col("base").alias("winding"), F.lit(False).alias("on_edge"))
    met = squares.join(places.select("_gx", "_gy").distinct(), ["_gx", "_gy"], "left_semi")
    size = met.groupBy(key, "_gx", "_gy").agg(F.ceil(F.count(F.lit(1)) / HELD).alias("_rows"))
    held = met.join(size, [key, "_gx", "_gy"]).withColumn("_row", F.pmod(F.xxhash64("e"), F.col("_rows")))
    gathered = held.groupBy(key, "_gx", "_gy", "_row").agg(F.collect_list("e").alias("edges")).select(key, F.lit(0).alias("level"), "_gx", "_gy", F.lit(0).cast("long").alias("base"), "edges")
    tested = located(places.select("_x", "_y"), gathered, fine, x="_x", y="_y").select("_x", "_y", key, "winding", "on_edge")
    inside = based.unionByName(tested).groupBy("_x", "_y", key).agg(F.sum("winding").alias("winding"), F.max("on_edge").alias("on_edge")).filter((F.col("winding") % 2 != 0) & ~F.col("on_edge"))
    return points.join(inside.select("_x", "_y", key), (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))).select(*points.columns, key)


def _within_few(known: DataFrame, edges: DataFrame, key: str, grid: Grid, x: str, y: str) -> DataFrame:
    return located(known, index(edges, [key], grid), grid, x=x, y=y).filter((F.col("winding") % 2 != 0) & ~F.col("on_edge")).drop("winding", "on_edge")


def within_join(points: DataFrame, polygons: DataFrame, key: str, grid: Grid, how: str = "inner", rings: str = "rings", point_key: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """Points with the polygons (key, rings; rows of one key are parts of one polygon) that they are within, by the
    even-odd rule: holes are left out, points on an edge are not within. `left` keeps all points, `right` all keys,
    `left_semi` points with any polygon and `left_anti` those with none. Null or infinite points are within nothing.
    Polygons' other columns join by the key."""
    pairs = within_edges(points, edges_of(polygons, [key], rings), key, grid, x, y)
    if how == "inner":
        return pairs
    if how in ("left_semi", "left_anti"):
        return points.join(pairs.select(point_key).distinct(), point_key, how)
    if how == "left":
        return points.join(pairs.select(point_key, key), point_key, "left")
    if how == "right":
        return polygons.select(key).distinct().join(pairs, key, "left")
    raise ValueError(how)
