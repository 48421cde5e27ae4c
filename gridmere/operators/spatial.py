"""Spatial joins on grid buckets: points in polygons, nearest neighbours, line crossings and lengths, zonal statistics.

Polygons (or segments) are sent to the grid squares that their boxes meet, points to their own square, and the two meet in
an equi join on the square; an exact test on the pairs follows. The square side is the caller's: about the size of a
typical polygon, so that a point meets few of them and a polygon few squares.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry
from ..sources.storage import cut
from . import scanline


def squares(side: float, x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> tuple[Column, Column]:
    """Arrays of the squares' numbers that a box meets, along x and y."""
    return F.sequence(F.floor(x_min / side), F.floor(x_max / side)), F.sequence(F.floor(y_min / side), F.floor(y_max / side))


def spread(shapes: DataFrame, side: float, box: dict[str, Column], margin: float = 0.0) -> DataFrame:
    gx, gy = squares(side, box["x_min"] - margin, box["y_min"] - margin, box["x_max"] + margin, box["y_max"] + margin)
    return shapes.select("*", F.explode(gx).alias("_gx")).select("*", F.explode(gy).alias("_gy"))


def placed(points: DataFrame, side: float, x: str = "x", y: str = "y") -> DataFrame:
    return points.select("*", F.floor(F.col(x) / side).alias("_gx"), F.floor(F.col(y) / side).alias("_gy"))


def within_join(points: DataFrame, polygons: DataFrame, side: float, how: str = "inner", ring: str = "ring", point_key: str = "point_id") -> DataFrame:
    """Points with the polygons that they are within; points on an edge are not. `left` keeps all points, `right` all
    polygons, `left_semi` points with any polygon, `left_anti` points with none.

    The columns of both sides must differ in name. A right join groups by the polygons' columns.
    """
    spread_polygons = spread(polygons, side, geometry.bounds(F.col(ring)))
    pairs = placed(points, side).join(spread_polygons, ["_gx", "_gy"]).filter(geometry.within(F.col("x"), F.col("y"), F.col(ring))).drop("_gx", "_gy")
    if how == "inner":
        return pairs
    if how in ("left_semi", "left_anti"):
        return points.join(pairs.select(point_key).distinct(), point_key, how)
    keys = [c for c in polygons.columns if c != ring]
    if how == "left":
        return points.join(pairs.select(point_key, *keys), point_key, "left")
    if how == "right":
        return polygons.select(*keys).join(pairs.select(*points.columns, *keys), keys, "left")
    raise ValueError(how)


def near_join(points: DataFrame, polygons: DataFrame, side: float, distance: float, ring: str = "ring") -> DataFrame:
    """Points within a distance of polygons, as a buffer around them would hold; `apart` is 0 inside."""
    box = geometry.bounds(F.col(ring))
    boxed = polygons.withColumns({f"_{n}": c for n, c in box.items()})
    reach = spread(boxed, side, {n: F.col(f"_{n}") for n in box}, distance)
    inside = [F.col(c).between(F.col(f"_{c}_min") - distance, F.col(f"_{c}_max") + distance) for c in "xy"]
    pairs = placed(points, side).join(reach, ["_gx", "_gy"]).filter(inside[0] & inside[1]).drop("_gx", "_gy", *(f"_{n}" for n in box))
    # through explode, so that the filter does not measure it a second time
    return pairs.select("*", F.explode(F.array(geometry.ring_distance(F.col("x"), F.col("y"), F.col(ring)))).alias("apart")).filter(F.col("apart") <= distance)


def around_join(points: DataFrame, polygons: DataFrame, side: float, distance: float, ring: str = "ring") -> DataFrame:
    """Points within a distance of polygons but outside them: in the ring that a buffer leaves without its object."""
    return near_join(points, polygons, side, distance, ring).filter(F.col("apart") > 0)


def overlapping(first: DataFrame, second: DataFrame, side: float, rings: tuple[str, str] = ("ring", "other_ring"), keep: Column | None = None) -> DataFrame:
    """Pairs of polygons whose areas share a point (or for which `keep` holds), with all columns of both, whose names must
    differ. A pair that meets in several squares counts in the first of them."""
    a, b = (spread(df, side, geometry.bounds(F.col(r))) for df, r in zip((first, second), rings))
    low, other = geometry.bounds(F.col(rings[0])), geometry.bounds(F.col(rings[1]))
    once = [F.col(f"_g{c}") == F.floor(F.greatest(low[f"{c}_min"], other[f"{c}_min"]) / side) for c in "xy"]
    met = a.join(b, ["_gx", "_gy"]).filter(once[0] & once[1])
    return met.filter(geometry.rings_meet(F.col(rings[0]), F.col(rings[1])) if keep is None else keep).drop("_gx", "_gy")


def clipped(polygons: DataFrame, boxes: DataFrame, side: float, ring: str = "ring") -> DataFrame:
    """Polygons cut by boxes (columns x_min, y_min, x_max, y_max): a row for each pair that shares some area."""
    box = [F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")]
    corners = F.array(*(F.struct(box[i].cast("double").alias("x"), box[j].cast("double").alias("y")) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3), (0, 1))))
    met = overlapping(polygons, boxes.withColumn("_box", corners), side, (ring, "_box"), F.lit(True)).drop("_box")
    inside = met.withColumn(ring, geometry.clipped(F.col(ring), *box))
    return inside.filter((F.size(ring) >= 4) & (geometry.ring_area(F.col(ring)) != 0))


def touching(points: DataFrame, polygons: DataFrame, side: float, half: float, ring: str = "ring") -> DataFrame:
    """Squares about points (half a side each way) with the polygons whose area they share a point with: the centre or a
    corner is within, or an edge of the ring meets the square."""
    reach = spread(polygons, side, geometry.bounds(F.col(ring)), half)
    pairs = placed(points, side).join(reach, ["_gx", "_gy"]).drop("_gx", "_gy")
    x, y = F.col("x"), F.col("y")

    def meets(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        start, stop, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
        for a, b, centre in ((p["x"], q["x"], x), (p["y"], q["y"], y)):
            d = b - a
            low, high = F.try_divide(centre - half - a, d), F.try_divide(centre + half - a, d)
            outside = outside | ((d == 0) & (F.abs(a - centre) > half))
            start, stop = F.greatest(start, F.least(low, high)), F.least(stop, F.greatest(low, high))
        return ~outside & (start <= stop)

    edge = F.exists(F.sequence(F.lit(0), F.size(ring) - 2), meets)
    return pairs.filter(geometry.within(x, y, F.col(ring)) | edge)


def _diagonal(points: DataFrame, targets: DataFrame) -> float:
    """Diagonal of the box around all points and targets."""
    places = points.select("x", "y").union(targets.select("tx", "ty")).filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    width, height = places.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return math.hypot(width or 0, height or 0)


#: Targets of an array that a point looks through, and how many a square holds on average before squares are made smaller.
CHUNK, CROWD = 512, 16


def nearest(points: DataFrame, targets: DataFrame, side: float, rounds: int = 4, point_key: str = "point_id", target_key: str = "target_id") -> DataFrame:
    """(point_key, target_key, apart): each point's nearest target (columns tx, ty), the least key of equally near ones.

    A ring search: a point looks into the squares around its own, first next to it, then farther, and is done when
    its best find is nearer than the border of what it has seen. The squares grow fourfold each round, for `rounds` rounds
    and on until one square is as long as the diagonal of all points and targets, so that every point has a row if there
    is a target. Each round is written, and the search ends when no point is open.
    """
    return _searched(points, targets, side, rounds, point_key, target_key).select(point_key, target_key, "apart")


def _searched(points: DataFrame, targets: DataFrame, side: float, rounds: int, point_key: str, target_key: str, bound: bool = False) -> DataFrame:
    """(point_key, x, y, target_key, apart) of nearest(), or with `bound` of a target that is near: one of each half square
    is looked at in wider rounds, so that `apart` is no less than the way to the nearest, and not much more.

    The targets around a square with open points are gathered once for all its points, as arrays of about CHUNK, so that
    no pair of a point and a target is a row. Of targets at one place the least stays, and the first squares are made
    smaller while those with any target hold over CROWD on average: a point looks at few, however many there are.
    """
    diagonal = _diagonal(points, targets)
    known = targets.filter((F.abs("tx") < float("inf")) & (F.abs("ty") < float("inf")))
    places, _ = cut(known.groupBy("tx", "ty").agg(F.min(target_key).alias(target_key)))
    count = places.count()
    for _ in range(16):
        if count <= CROWD * places.select(F.floor(F.col("tx") / side), F.floor(F.col("ty") / side)).distinct().count():
            break
        side /= 4
    while side * 4 ** (rounds - 1) <= 1.001 * diagonal:
        rounds += 1
    goals = places.select(target_key, "tx", "ty", F.floor(F.col("tx") / side).alias("_gx"), F.floor(F.col("ty") / side).alias("_gy"))
    open_, done, scale = points.select(point_key, "x", "y").filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))), None, 1
    around = F.sequence(F.lit(-1), F.lit(1))
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    for _ in range(rounds):
        at = {"cx": F.floor(F.col("x") / (side * scale)), "cy": F.floor(F.col("y") / (side * scale))}
        sent = open_.withColumns(at)
        wanted = sent.select("cx", "cy").distinct().select("*", F.explode(around).alias("dx")).select("*", F.explode(around).alias("dy"))
        wanted = wanted.select("cx", "cy", (F.col("cx") + F.col("dx")).alias("_gx"), (F.col("cy") + F.col("dy")).alias("_gy"))
        coarse = goals.withColumns({"_gx": F.floor(F.col("_gx") / scale), "_gy": F.floor(F.col("_gy") / scale)})
        if bound and scale > 1:
            half = [F.floor(F.col(c) / (side * scale / 2)).alias(f"_h{c}") for c in ("tx", "ty")]
            coarse = coarse.groupBy("_gx", "_gy", *half).agg(F.min(F.struct("tx", "ty", target_key)).alias("_t")).select("_gx", "_gy", "_t.*")
        crowd = coarse.groupBy("_gx", "_gy").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n"))
        dealt = coarse.join(crowd, ["_gx", "_gy"]).withColumn("_part", F.pmod(F.xxhash64("tx", "ty"), F.col("_n")))
        packed = dealt.groupBy("_gx", "_gy", "_part").agg(F.collect_list(F.struct("tx", "ty", target_key)).alias("_goals"))
        near = wanted.join(packed, ["_gx", "_gy"]).groupBy("cx", "cy", "_part").agg(F.flatten(F.collect_list("_goals")).alias("_goals"))

        def apart(t: Column) -> Column:
            dx, dy = F.col("x") - t["tx"], F.col("y") - t["ty"]
            return F.struct(F.sqrt(dx * dx + dy * dy).alias("apart"), t[target_key].alias(target_key))

        found = sent.join(near, ["cx", "cy"], "left").withColumn("best", F.array_min(F.transform("_goals", apart)))
        edge = F.least(F.col("x") - (F.col("cx") - 1) * side * scale, (F.col("cx") + 2) * side * scale - F.col("x"), F.col("y") - (F.col("cy") - 1) * side * scale, (F.col("cy") + 2) * side * scale - F.col("y"))
        best, _ = cut(found.groupBy(point_key, "x", "y").agg(F.min("best").alias("best"), F.min(edge).alias("edge")))  # the next round goes on from here
        sure = best.filter(F.col("best.apart") <= F.col("edge")).select(point_key, "x", "y", F.col(f"best.{target_key}").alias(target_key), F.col("best.apart").alias("apart"))
        done = sure if done is None else done.unionByName(sure)
        open_ = best.filter(F.col("best").isNull() | (F.col("best.apart") > F.col("edge"))).select(point_key, "x", "y")
        if open_.isEmpty():
            break
        open_ = open_.repartition(tasks, point_key)  # few bytes, but much work: not by the size of the files
        scale *= 4
    return done


#: Half the diagonal of a square of side 1 and a little, how far a square's border is put out, and points a cell from which on
#: cells are made smaller.
HALF, RIM, FULL = 0.70710679, 1e-9, 64


def _apart2(x: Column, y: Column, e: Column) -> Column:
    """Square of the distance to an edge (x1, y1, dx, dy, l2), in few steps."""
    u, v = x - e["x1"], y - e["y1"]
    along, over = u * e["dx"] + v * e["dy"], u * e["dy"] - v * e["dx"]
    return F.when(along <= 0, u * u + v * v).when(along < e["l2"], over * over / e["l2"]).otherwise((u - e["dx"]) * (u - e["dx"]) + (v - e["dy"]) * (v - e["dy"]))


def _turned(x: Column, y: Column, e: Column, border: Column) -> Column:
    """Summed modulo 2 over the edges that meet a square (others change nothing), the part of a ray's crossings that depends
    on the point's place in the square. Right of the border a crossed edge counts by its ends, so that ends of edges that
    are both right of it cancel out and only edges that meet the square are needed."""
    crossed = ((e["y1"] > y) != (e["y2"] > y)) & (x < e["dx"] * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return (crossed != ((e["x1"] >= border) & (e["y1"] > y))) != ((e["x2"] >= border) & (e["y2"] > y))


def _near_edges(cells: DataFrame, edges: DataFrame, side: float, width: float) -> DataFrame:
    """(cell, cx, cy, edge's columns, d) of the edges that can be nearest to a point of the cell, and some more: d is the
    distance to the cell's centre. Edges are looked up by pieces of a side at most, in squares as long as the way to look."""
    steps = F.greatest(F.ceil(F.sqrt("l2") / side), F.lit(1)).alias("n")
    pieces = edges.select("*", steps).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    pieces, _ = cut(pieces.select("*", *((F.col(f"{c}1") + F.col(f"d{c}") * (F.col("k") + i) / F.col("n")).alias(f"p{c}{i}") for c in "xy" for i in (0, 1))))
    marks = pieces.select(F.col("_poly").alias("target_id"), F.col("px0").alias("tx"), F.col("py0").alias("ty"))
    reach = _searched(cells.select("cell", F.col("cx").alias("x"), F.col("cy").alias("y")), marks, side, 4, "cell", "target_id", bound=True)
    most = F.col("apart") + 2 * HALF * width
    reach = reach.select("cell", F.col("x").alias("cx"), F.col("y").alias("cy"), most.alias("most"), F.greatest(F.ceil(F.log(4.0, most / side)), F.lit(0)).cast("int").alias("level"))
    levels = [r[0] for r in reach.select("level").distinct().collect()]
    long, around = F.lit(side) * F.pow(F.lit(4.0), F.col("level")), F.sequence(F.lit(-1), F.lit(1))
    looking = reach.select("*", F.explode(around).alias("dx")).select("*", F.explode(around).alias("dy"))
    looking = looking.select("cell", "cx", "cy", "most", "level", (F.floor(F.col("cx") / long) + F.col("dx")).alias("_gx"), (F.floor(F.col("cy") / long) + F.col("dy")).alias("_gy"))
    sent = pieces.select(*edges.columns, *(f(f"p{c}0", f"p{c}1").alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.least), ("max", F.greatest))), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    for axis in "xy":
        sent = sent.select("*", F.explode(F.sequence(F.floor(F.col(f"{axis}_min") / long), F.floor(F.col(f"{axis}_max") / long))).alias(f"_g{axis}"))
    off = [F.greatest(F.col(f"{c}_min") - F.col(f"c{c}"), F.col(f"c{c}") - F.col(f"{c}_max"), F.lit(0.0)) for c in "xy"]
    found = looking.join(sent, ["level", "_gx", "_gy"]).filter(F.hypot(*off) <= F.col("most") * (1 + 1e-9))
    edge = F.struct("x1", "y1", "x2", "y2", "dx", "dy", "l2")
    once = found.dropDuplicates(["cell", "_poly", "_edge"]).select("cell", "cx", "cy", "_poly", "_key", edge.alias("e"))
    return once.withColumn("d", F.sqrt(_apart2(F.col("cx"), F.col("cy"), F.col("e"))))


def _centres_within(cells: DataFrame, shapes: DataFrame, edges: DataFrame, side: float, width: float) -> DataFrame:
    """(cell, _poly, _key) of the polygons that the centre of a cell is in, by the edges on the line from it to the right."""
    boxes = spread(shapes.select("_poly", "_key", *(c.alias(n) for n, c in geometry.bounds(F.col("_ring")).items())), side, {n: F.col(n) for n in ("x_min", "x_max", "y_min", "y_max")})
    rows = edges.select("*", F.explode(F.sequence(F.floor(F.least("y1", "y2") / width), F.floor(F.greatest("y1", "y2") / width))).alias("_row"))
    line = (F.col("_row") + 0.5) * width
    rows = rows.filter((F.col("y1") > line) != (F.col("y2") > line)).select("_poly", "_row", (F.col("dx") * (line - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("at"))
    near = F.col("cx").between(F.col("x_min"), F.col("x_max")) & F.col("cy").between(F.col("y_min"), F.col("y_max"))
    at = placed(cells.select("cell", "cx", "cy", F.col("cell._gy").alias("_row")), side, "cx", "cy").join(boxes, ["_gx", "_gy"]).filter(near)
    met = at.select("cell", "cx", "_row", "_poly", "_key").join(rows, ["_poly", "_row"])
    return met.groupBy("cell", "_poly", "_key").agg(F.count_if(F.col("cx") < F.col("at")).alias("n")).filter("n % 2 = 1").drop("n")


def nearest_polygon(points: DataFrame, polygons: DataFrame, side: float, point_key: str = "point_id", key: str = "poly", ring: str = "ring") -> DataFrame:
    """(point_key, key, apart): each point's nearest polygon, at distance 0 inside it, the least key of equally near ones.

    The search is made once for each square (cell) with a point, for its centre (cells of a quarter of the side where points
    are FULL times as many as those): nearest() over corners, and points along the
    edges a side apart at most, tells how far a cell has to look. What can be nearest to any of its points are the edges that
    are no farther from the centre than those that surely are near and the cell's diagonal. Points are read twice, for their
    cells and to be measured against these few edges; whether a point is inside follows from the cell's centre and
    the edges that meet the cell.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    known, width = points.filter(finite).select(point_key, "x", "y"), side / 4
    cells, _ = cut(placed(known, width).groupBy("_gx", "_gy").agg(F.count(F.lit(1)).alias("n")))
    count, held = cells.agg(F.count(F.lit(1)), F.sum("n")).first()
    if count * FULL > (held or 0):
        cells, width = cells.select(F.floor(F.col("_gx") / 4).alias("_gx"), F.floor(F.col("_gy") / 4).alias("_gy")).distinct(), side
    known = placed(known, width)
    cells = cells.select(F.struct("_gx", "_gy").alias("cell"), ((F.col("_gx") + 0.5) * width).alias("cx"), ((F.col("_gy") + 0.5) * width).alias("cy"))
    shapes, _ = cut(polygons.filter(F.size(ring) >= 2).select(F.monotonically_increasing_id().alias("_poly"), F.col(key).alias("_key"), F.col(ring).alias("_ring")))
    corners = F.transform(F.sequence(F.lit(0), F.size("_ring") - 2), lambda k: F.struct(F.get("_ring", k).alias("p"), F.get("_ring", k + 1).alias("q")))
    ends = shapes.select("_poly", "_key", F.posexplode(corners).alias("_edge", "e")).select("_poly", "_key", "_edge", *(F.col(f"e.{p}.{c}").cast("double").alias(f"{c}{i}") for p, i in (("p", 1), ("q", 2)) for c in "xy"))
    ways = ends.select("*", (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    edges, _ = cut(ways.select("*", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("l2")))
    half = HALF * width
    near, _ = cut(_near_edges(cells, edges, side, width))
    inside, _ = cut(_centres_within(cells, shapes, edges, side, width).withColumn("in", F.lit(True)))
    # how near the nearest polygon is at most, for all points of the cell
    apart = near.groupBy("cell", "_poly").agg(F.min("d").alias("d")).join(inside, ["cell", "_poly"], "full")
    most = F.when(F.col("in"), F.when(F.col("d") <= half, half).otherwise(0.0)).otherwise(F.col("d") + half)
    bound = apart.groupBy("cell").agg(F.min(most).alias("most"))
    border = (F.col("cell._gx") + 1 + RIM) * width
    kept = near.join(bound, "cell").filter(F.col("d") <= (F.col("most") + half) * (1 + 1e-9)).withColumn("turned", _turned(F.col("cx"), F.col("cy"), F.col("e"), border))
    by_shape = kept.groupBy("cell", "_poly", "_key").agg(F.collect_list("e").alias("edges"), F.min("d").alias("d"), (F.count_if("turned") % 2 == 1).alias("turned"))
    by_shape = by_shape.join(inside, ["cell", "_poly", "_key"], "full").withColumns({"in": F.coalesce("in", F.lit(False)), "cut": F.coalesce(F.col("d") <= half, F.lit(False))})
    shape = F.struct("_key", "cut", F.when(F.col("cut"), F.col("in") != F.col("turned")).otherwise(F.col("in")).alias("odd"), F.coalesce("edges", F.array().cast(near.select(F.array("e")).schema[0].dataType)).alias("edges"))
    packed, _ = cut(by_shape.groupBy("cell").agg(F.collect_list(shape).alias("_shapes")).select("cell._gx", "cell._gy", "_shapes"))
    x, y, border = F.col("x"), F.col("y"), (F.col("_gx") + 1 + RIM) * width

    def measured(s: Column) -> Column:
        turned = F.size(F.filter(s["edges"], lambda e: _turned(x, y, e, border))) % 2 == 1
        within = F.when(s["cut"], s["odd"] != turned).otherwise(s["odd"])
        return F.struct(F.when(within, 0.0).otherwise(F.sqrt(F.array_min(F.transform(s["edges"], lambda e: _apart2(x, y, e))))).alias("apart"), s["_key"].alias(key))

    best = known.join(packed, ["_gx", "_gy"]).select(point_key, F.explode(F.array(F.array_min(F.transform("_shapes", measured)))).alias("b"))
    return best.select(point_key, F.col(f"b.{key}").alias(key), F.col("b.apart").alias("apart"))


def nearest_small(points: DataFrame, targets: DataFrame, point_key: str = "point_id", target_key: str = "target_id", most: int = 10_000) -> DataFrame:
    """As nearest(), for a target table of a checked size: each point looks at all targets, in one broadcast array."""
    n = targets.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} targets: use nearest()")
    packed = targets.agg(F.collect_list(F.struct(F.col(target_key), F.col("tx"), F.col("ty"))).alias("targets"))
    ranked = F.array_min(F.transform("targets", lambda t: F.struct(F.sqrt((F.col("x") - t["tx"]) * (F.col("x") - t["tx"]) + (F.col("y") - t["ty"]) * (F.col("y") - t["ty"])).alias("apart"), t[target_key].alias(target_key))))
    return points.crossJoin(F.broadcast(packed)).select(point_key, ranked.alias("best")).select(point_key, F.col(f"best.{target_key}").alias(target_key), F.col("best.apart").alias("apart"))


def grid_lookup(x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Column and row of the nearest node of a regular grid; halves go to the greater coordinate."""
    return F.floor((x - x0) / dx + 0.5), F.floor((y - y0) / dy + 0.5)


def nearest_fill(cells: DataFrame, value: str = "value", reach: int = 64) -> DataFrame:
    """Missing values of a grid from the nearest known cell, the least (row, col) of equally near ones.

    Growing squares, as in nearest(): known cells are looked up by square, first within the reach, then as far as it takes.
    """
    known, missing = cells.filter(F.col(value).isNotNull()), cells.filter(F.col(value).isNull())
    numbered = known.select((F.col("row") * (1 << 31) + F.col("col")).alias("target_id"), F.col("col").cast("double").alias("tx"), F.col("row").cast("double").alias("ty"))
    wanted = missing.select((F.col("row") * (1 << 31) + F.col("col")).alias("point_id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    found = nearest(wanted, numbered, 4.0, rounds=max(1, (reach - 1).bit_length() // 2))
    source = known.select((F.col("row") * (1 << 31) + F.col("col")).alias("target_id"), F.col(value).alias("_from"))
    filled = found.join(source, "target_id").select(F.floor(F.col("point_id") / (1 << 31)).alias("row"), (F.col("point_id") % (1 << 31)).alias("col"), "_from")
    return cells.join(filled, ["row", "col"], "left").withColumn(value, F.coalesce(F.col(value), F.col("_from"))).drop("_from")


def intersections(first: DataFrame, second: DataFrame, side: float) -> DataFrame:
    """(a_id, b_id, x, y): where segments of two tables cross; parallel ones do not. Tables have id, x1, y1, x2, y2.

    A crossing is reported by the one square that holds it, so that pairs that share several squares meet once.
    """

    def box(p: str) -> dict[str, Column]:
        return {"x_min": F.least(f"{p}x1", f"{p}x2"), "x_max": F.greatest(f"{p}x1", f"{p}x2"), "y_min": F.least(f"{p}y1", f"{p}y2"), "y_max": F.greatest(f"{p}y1", f"{p}y2")}

    a = first.select(*(F.col(c).alias(f"a_{c}") for c in ("id", "x1", "y1", "x2", "y2")))
    b = second.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "x1", "y1", "x2", "y2")))
    pairs = spread(a, side, box("a_")).join(spread(b, side, box("b_")), ["_gx", "_gy"])
    ax, ay, bx, by = F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1"), F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    det = ax * by - ay * bx
    sx, sy = F.col("b_x1") - F.col("a_x1"), F.col("b_y1") - F.col("a_y1")
    crossing = pairs.withColumns({"t": F.try_divide(sx * by - sy * bx, det), "u": F.try_divide(sx * ay - sy * ax, det)}).filter(F.col("t").between(0, 1) & F.col("u").between(0, 1))
    at = crossing.select("a_id", "b_id", "_gx", "_gy", (F.col("a_x1") + F.col("t") * ax).alias("x"), (F.col("a_y1") + F.col("t") * ay).alias("y"))
    return at.select("a_id", "b_id", "x", "y").dropDuplicates(["a_id", "b_id"])


def clipped_length(segments: DataFrame, boxes: DataFrame, side: float) -> DataFrame:
    """(segment id, box_id, inside): length of each segment inside each box that it meets (Liang and Barsky 1984)."""
    box = {c: F.col(c) for c in ("x_min", "x_max", "y_min", "y_max")}
    own = {"x_min": F.least("x1", "x2"), "x_max": F.greatest("x1", "x2"), "y_min": F.least("y1", "y2"), "y_max": F.greatest("y1", "y2")}
    pairs = spread(segments, side, own).join(spread(boxes, side, box), ["_gx", "_gy"]).drop("_gx", "_gy").dropDuplicates(["id", "box_id"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    start, stop = F.lit(0.0), F.lit(1.0)
    for d, low, high in ((dx, F.col("x_min") - F.col("x1"), F.col("x_max") - F.col("x1")), (dy, F.col("y_min") - F.col("y1"), F.col("y_max") - F.col("y1"))):
        a, b = F.try_divide(low, d), F.try_divide(high, d)
        outside = (d == 0) & ((low > 0) | (high < 0))
        start = F.greatest(start, F.least(a, b), F.when(outside, 2.0))
        stop = F.least(stop, F.greatest(a, b))
    inside = F.greatest(stop - start, F.lit(0.0)) * F.hypot(dx, dy)
    return pairs.select("id", "box_id", inside.alias("inside")).filter("inside > 0")


def zonal(cells: DataFrame, polygons: DataFrame, side: float, key: str, *aggregates: Column, touched: float | None = None) -> DataFrame:
    """Aggregates of the cells whose centres are within each polygon; polygons without a cell are kept. With `touched`
    (half a cell's side), all cells count that share a point with the polygon's area."""
    if touched is None:
        found = cells.join(scanline.cells_within(polygons.select(key, F.array("ring").alias("rings")), key), ["row", "col"])
    else:
        found = touching(cells.withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5}), polygons, side, touched)
    return polygons.select(key).join(found.groupBy(key).agg(*aggregates), key, "left")


def zonal_classes(cells: DataFrame, polygons: DataFrame, side: float, key: str) -> DataFrame:
    """(key, value, n, share): cells of each class in each polygon, and their share."""
    found = within_join(cells.withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5}), polygons, side).groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def coverage(cells: DataFrame, polygons: DataFrame, side: float, key: str, parts: int = 4) -> DataFrame:
    """(key, row, col, share): share of each cell inside each polygon, by parts x parts points a cell."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(parts * parts - 1))).alias("_k")
    sub = cells.select("row", "col", steps).withColumns({"x": F.col("col") + ((F.col("_k") % parts) + 0.5) / parts, "y": F.col("row") + (F.floor(F.col("_k") / parts) + 0.5) / parts})
    return within_join(sub, polygons, side).groupBy(key, "row", "col").agg((F.count(F.lit(1)) / (parts * parts)).alias("share"))


def fractions(cells: DataFrame, polygons: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """(key, row, col, share): exact share of each cell (a unit square from (col, row) on) inside each polygon that covers
    any of it, from the cells along the outlines (see scanline)."""
    found = scanline.shares(polygons.select(key, F.array(ring).alias("rings")), key)
    return found.join(cells.select("row", "col").distinct(), ["row", "col"]).select(key, "row", "col", "share")


def first_match(pairs: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in an order."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def rasterized(polygons: DataFrame, key: str, x0: float = 0.0, y0: float = 0.0, step: float = 1.0) -> DataFrame:
    """(row, col, key): cells of a grid whose centres are within polygons, in runs along rows (see scanline). Where polygons
    overlap, the greatest key stays."""
    cells = scanline.cells_within(polygons.select(key, F.array("ring").alias("rings")), key, "rings", x0, y0, step)
    return cells.groupBy("row", "col").agg(F.max(key).alias(key))


def warped(cells: DataFrame, target: DataFrame, to_source: tuple[Column, Column], x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """A raster on another grid: each target cell takes the value of the source cell nearest to its place there, null
    outside. to_source gives source coordinates from the columns of the target."""
    col, row = grid_lookup(*to_source, x0, y0, dx, dy)
    source = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    placed_ = target.withColumns({"_r": row, "_c": col})
    return placed_.join(source, ["_r", "_c"], "left").drop("_r", "_c")


def polygon_line_lengths(segments: DataFrame, polygons: DataFrame, key: str, side: float) -> DataFrame:
    """(id, key, inside): length of segments inside polygons. A segment is cut at its crossings of the ring, and the
    pieces whose middles are inside count."""
    box = geometry.bounds(F.col("ring"))
    own = {"x_min": F.least("x1", "x2"), "x_max": F.greatest("x1", "x2"), "y_min": F.least("y1", "y2"), "y_max": F.greatest("y1", "y2")}
    pairs = spread(segments, side, own).join(spread(polygons, side, box), ["_gx", "_gy"]).drop("_gx", "_gy").dropDuplicates(["id", key])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def cut(i: Column) -> Column:
        p, q = F.get("ring", i), F.get("ring", i + 1)
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        det = dx * ey - dy * ex
        t = F.try_divide((p["x"] - F.col("x1")) * ey - (p["y"] - F.col("y1")) * ex, det)
        u = F.try_divide((p["x"] - F.col("x1")) * dy - (p["y"] - F.col("y1")) * dx, det)
        return F.when(t.between(0, 1) & u.between(0, 1), t)

    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.transform(F.sequence(F.lit(0), F.size("ring") - 2), cut), lambda t: t.isNotNull())))
    with_cuts = pairs.withColumn("_t", cuts)

    def piece(acc: Column, i: Column) -> Column:
        a, b = F.get("_t", i), F.get("_t", i + 1)
        mid = (a + b) / 2
        return acc + F.when(geometry.crossings(F.col("x1") + mid * dx, F.col("y1") + mid * dy, F.col("ring")) % 2 == 1, b - a).otherwise(0.0)

    share = F.aggregate(F.sequence(F.lit(0), F.size("_t") - 2), F.lit(0.0), piece)
    return with_cuts.select("id", key, (share * F.hypot(dx, dy)).alias("inside")).filter("inside > 0")
