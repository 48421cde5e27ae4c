"""Shapes made of shapes: intersections, differences, unions by key, buffers, and repair of invalid polygons.

All go the same way. Corners are rounded to a lattice, so that everything after is done in whole numbers. Edges are cut
where they cross or touch (crossings are rounded to the lattice, and cut again until nothing crosses). Each piece learns
the winding numbers of the polygons on its right, from the index of `winding`, and on its left, which differ by the
piece's own weight. A piece bounds the result if the result holds one side of it and not the other; it is kept with the
result on its left. The kept pieces are chained to rings, in tasks that hold connected pieces of one result shape, and
holes are given to the smallest outline around them, again through the index.

Edges meet in grid squares that are cut finer where they are many; no polygon is paired with another, and a large
polygon's edges are dealt to many tasks. A result ring is a value of a row, and only as much as that is held by a task.

Polygons are rows (key, rings) with an outline and its holes; rows of one key are parts of one polygon. Rings that are
null or have under three corners count for nothing. Results are rows (key, part, rings): simple rings, the outline
anticlockwise and its holes clockwise, parts numbered from 1 by their leftmost corner. What touches in a corner only stays
in several parts. `precision` is the lattice's step: coordinates divided by it have to be under 2**27, and no corner moves
by more than it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import geometry
from ..sources.storage import cut, remove
from . import winding
from .components import components
from .winding import ENDS, Grid, turn

#: Lattice points are multiples of 4, so that middles of pieces are even and grid lines odd.
STEP = 4
ROUNDS = 30
#: Edges of a result shape up to which one task chains them all; those of larger ones go by connected sets.
CHAINED = 100_000
POINT = "struct<x:double,y:double>"


def grid_of(side: float, precision: float, depth: int = 3) -> Grid:
    """Squares of about a side, in lattice units."""
    block = STEP ** (depth + 1)
    return Grid(max(block, round(side / precision * STEP / block) * block), depth, 24, whole=True)


def edges_of(polygons: DataFrame, group: Column, shape: Column, precision: float, rings: str = "rings", oriented: bool = False) -> DataFrame:
    """(grp, shape, x1, y1, x2, y2, w) on the lattice. Shapes meet only within a group."""
    named = polygons.select(group.alias("grp"), shape.alias("shape"), F.col(rings).alias("rings"))
    return on_lattice(winding.edges_of(named, ["grp", "shape"], "rings", oriented), precision)


def on_lattice(edges: DataFrame, precision: float) -> DataFrame:
    limit = float(1 << 27)
    snapped = {c: F.when(F.abs(F.col(c) / precision) < limit, F.round(F.col(c) / precision).cast("long") * STEP).otherwise(F.raise_error(F.lit("coordinates over precision reach 2**27"))) for c in ENDS}
    return winding.left_to_right(edges.withColumns(snapped))


def summed(edges: DataFrame) -> DataFrame:
    """Equal pieces of a shape as one; those that cancel each other go."""
    return edges.groupBy("grp", "shape", *ENDS).agg(F.sum("w").cast("long").alias("w")).filter("w <> 0")


def open_squares(edges: DataFrame, grid: Grid) -> DataFrame:
    """(grp, shape, level, _gx, _gy, base, edges): the index of all shapes, cut as finely as the edges of a group's shapes
    together call for, without the squares that lie whole inside one shape of the group. No union has a boundary there,
    so that what is left is the squares about the union's boundary, however many shapes lie over each other."""
    found = winding.index(edges, ["grp", "shape"], replace(grid, depth=0))
    own = Window.partitionBy("grp", "level", "_gx", "_gy")
    for level in range(grid.depth + 1):
        held = F.max((F.size("edges") == 0) & odd(F.col("base"))).over(own)
        found = winding.dealt(found, "grp", "level", "_gx", "_gy").withColumns({"_n": F.sum(F.size("edges")).over(own), "_held": held}).filter("NOT _held").drop("_held")
        if level < grid.depth:
            found = winding.refined_once(found, ["grp", "shape"], grid, level, F.col("_n") > grid.most)
    return found.drop("_n")


def _open_crowds(edges: DataFrame, grid: Grid) -> DataFrame:
    """The open squares with the distinct edges that meet them, as winding.crowds()."""
    ends = F.transform("edges", lambda e: F.struct(*(e[c].alias(c) for c in ENDS)))
    return open_squares(edges, grid).groupBy("grp", "level", "_gx", "_gy").agg(F.array_distinct(F.flatten(F.collect_list(ends))).alias("edges"))


def _cuts(edges: DataFrame, grid: Grid, only_open: bool = False) -> DataFrame:
    """(grp, e, at): places inside edges, as a set each, where another edge crosses or touches them; those in open squares
    alone, if told so."""
    squares = _open_crowds(edges, grid) if only_open else winding.crowds(edges.select("grp", *ENDS).distinct(), ["grp"], grid)
    low, high = (lambda e: F.least(e["y1"], e["y2"])), (lambda e: F.greatest(e["y1"], e["y2"]))
    first = squares.select("grp", "edges", F.explode("edges").alias("a"))
    a = F.col("a")
    near = F.filter("edges", lambda b: (a < b) & (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (low(a) <= high(b)) & (low(b) <= high(a)))
    pairs = first.select("grp", "a", F.explode(near).alias("b"))
    b = F.col("b")
    sides = {f"d{i}": turn(e["x1"], e["y1"], e["x2"], e["y2"], p[f"x{k}"], p[f"y{k}"]) for i, (e, p, k) in enumerate(((a, b, 1), (a, b, 2), (b, a, 1), (b, a, 2)), 1)}
    pairs = pairs.withColumns(sides)
    d = [F.col(f"d{i}") for i in range(1, 5)]
    u = d[2].cast("double") / (d[2] - d[3])
    cross = F.struct(*((F.round((a[f"{c}1"] + u * (a[f"{c}2"] - a[f"{c}1"])) / STEP).cast("long") * STEP).alias(c) for c in "xy"))
    proper = (F.signum(d[0]) * F.signum(d[1]) < 0) & (F.signum(d[2]) * F.signum(d[3]) < 0)

    def end(e: Column, k: int) -> Column:
        return F.struct(e[f"x{k}"].alias("x"), e[f"y{k}"].alias("y"))

    def inside(e: Column, p: Column) -> Column:
        return p["x"].between(e["x1"], e["x2"]) & p["y"].between(low(e), high(e))

    found = [F.when(proper, F.struct(e.alias("e"), cross.alias("p"))) for e in (a, b)]
    found += [F.when((d[i] == 0) & inside(e, end(o, k)), F.struct(e.alias("e"), end(o, k).alias("p"))) for i, (e, o, k) in enumerate(((a, b, 1), (a, b, 2), (b, a, 1), (b, a, 2)))]
    each = pairs.select("grp", F.explode(F.array(*found)).alias("c")).filter("c is not null").select("grp", "c.e", "c.p")
    new = each.filter((F.col("p") != end(F.col("e"), 1)) & (F.col("p") != end(F.col("e"), 2)))
    return new.groupBy("grp", "e").agg(F.collect_set("p").alias("at"))


def noded(edges: DataFrame, grid: Grid, only_open: bool = False) -> DataFrame:
    """Edges cut where they cross or touch, written: no two pieces share more than an end, or are the same piece. With
    `only_open`, that holds in open squares."""
    spark = edges.sparkSession
    now, path = cut(summed(edges))
    for _ in range(ROUNDS):
        cuts, cuts_path = cut(_cuts(now, grid, only_open))
        if cuts.isEmpty():
            remove(spark, cuts_path)
            return now
        e = F.struct(*ENDS)
        open_ = now.withColumn("e", e).join(cuts, ["grp", "e"], "left")
        begin, stop = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
        along = F.array_sort(F.transform("at", lambda p: F.struct(((p["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (p["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))).alias("k"), p.alias("p"))))
        way = F.concat(F.array(begin), F.coalesce(F.transform(along, lambda k: k["p"]), F.array().cast("array<struct<x:bigint,y:bigint>>")), F.array(stop))
        steps = open_.select("grp", "shape", "w", way.alias("way")).select("grp", "shape", "w", F.explode(F.transform(F.sequence(F.lit(0), F.size("way") - 2), lambda i: F.struct(F.get("way", i).alias("p"), F.get("way", i + 1).alias("q")))).alias("s"))
        pieces = steps.select("grp", "shape", *(F.col(f"s.{p}.{c}").alias(f"{c}{k}") for k, p in ((1, "p"), (2, "q")) for c in "xy"), "w")
        after, after_path = cut(summed(winding.left_to_right(pieces)))
        for old in (path, cuts_path):
            remove(spark, old)
        now, path = after, after_path
    raise RuntimeError(f"edges still cross after {ROUNDS} rounds: take a coarser or finer precision")


def sides(pieces: DataFrame, grid: Grid, only_open: bool = False) -> DataFrame:
    """(grp, x1, y1, x2, y2, shape, right, left): winding numbers of each shape on both sides of each distinct piece, or of
    those whose middle is in an open square."""
    squares = open_squares(pieces, grid) if only_open else winding.index(pieces, ["grp", "shape"], grid)
    middles = pieces.select("grp", *ENDS).distinct().withColumns({"x": F.floor((F.col("x1") + F.col("x2")) / 2), "y": F.floor((F.col("y1") + F.col("y2")) / 2)})
    same = F.filter("edges", lambda e: (e["x1"] == F.col("x1")) & (e["y1"] == F.col("y1")) & (e["x2"] == F.col("x2")) & (e["y2"] == F.col("y2")))
    own = F.aggregate(same, F.lit(0).cast("long"), lambda acc, e: acc + e["w"])
    found = winding.located(middles, squares, grid, ["grp"], at="under", more={"_own": own})
    return found.select("grp", *ENDS, "shape", F.col("winding").alias("right"), (F.col("winding") + F.col("_own")).alias("left"))


def odd(count: Column) -> Column:
    return count % 2 != 0


def positive(count: Column) -> Column:
    return count > 0


def half_edges(bounding: DataFrame, key: str) -> DataFrame:
    """(key, ax, ay, bx, by): directed pieces with the result on their left; `bounding` has flags _right and _left."""
    ends = {a: F.when(F.col("_left"), F.col(b)).otherwise(F.col(c)) for a, b, c in (("ax", "x1", "x2"), ("ay", "y1", "y2"), ("bx", "x2", "x1"), ("by", "y2", "y1"))}
    return bounding.filter(F.col("_left") != F.col("_right")).select(key, *(c.alias(a) for a, c in ends.items()))


def _turned(back: tuple[int, int]):
    """Orders directions by their angle clockwise from `back`, exactly."""

    def half(d: tuple[int, int]) -> int:
        cross = back[0] * d[1] - back[1] * d[0]
        return 0 if cross < 0 else 1 if cross == 0 and back[0] * d[0] + back[1] * d[1] < 0 else 2 if cross > 0 else 3

    def compare(p: tuple[int, int], q: tuple[int, int]) -> int:
        return half(p) - half(q) or (1 if (c := p[0] * q[1] - p[1] * q[0]) > 0 else -1 if c < 0 else 0)

    return cmp_to_key(compare)


def chained(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Simple closed rings (the first corner again at the end) of directed edges that leave a corner as often as they enter
    it. Where several leave, the next one is the first clockwise from the way back, so that a ring stays with its area; a
    ring that comes back to one of its corners is cut off there."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, q in sorted(zip(a, b), reverse=True):
        out.setdefault(p, []).append(q)
    for start in sorted(out):
        while out[start]:
            way, place, at = [start], {start: 0}, start
            while True:
                ways = out[at]
                if len(ways) > 1 and len(way) > 1:
                    back = way[-2][0] - at[0], way[-2][1] - at[1]
                    nearest = min(ways, key=lambda q: _turned(back)((q[0] - at[0], q[1] - at[1])))
                    ways.remove(nearest)
                else:
                    nearest = ways.pop()
                at = nearest
                if at in place:
                    ring = way[place[at] :]
                    yield [*ring, at]
                    for p in ring[1:]:
                        del place[p]
                    del way[place[at] + 1 :]
                    if len(way) == 1:
                        break
                else:
                    place[at] = len(way)
                    way.append(at)


def ring_rows(out, a: list[tuple[int, int]], b: list[tuple[int, int]]) -> Iterator[tuple]:
    """Rings of one set of directed edges, with twice their areas; the middle of the first edge tells where a ring is."""
    for ring in chained(a, b):
        area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))
        (px, py), (qx, qy) = ring[:2]
        yield out, *min(ring[:-1]), float(area), (px + qx) // 2, (py + qy) // 2, [p[0] for p in ring], [p[1] for p in ring]


def _chains(schema: pa.Schema):
    """Rings of edges (out, root, ax, ay, bx, by) that are sorted by out and root: a task holds one set at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, a, b = None, [], []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            for out, root, ax, ay, bx, by in zip(*(c.to_pylist() for c in batch.columns)):
                if (out, root) != at:
                    if a:
                        rows += ring_rows(at[0], a, b)
                    at, a, b = (out, root), [], []
                a.append((ax, ay))
                b.append((bx, by))
            if rows:
                yield made(rows)
        if a:
            yield made(list(ring_rows(at[0], a, b)))

    return run


def _rooted(directed: DataFrame, key: str) -> DataFrame:
    """(key, root, ax, ay, bx, by): the edges of a shape as one set, or, where they are many, as its connected sets. Corners
    are told apart by their shape too, so that shapes that share corners are never one set."""
    many = directed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CHAINED).select(key)
    ends = [key, "ax", "ay", "bx", "by"]
    one = directed.select(key, F.lit(0).cast("long").alias("root"), *ends[1:])
    if many.isEmpty():
        return one
    many, _ = cut(many)
    large = directed.join(many, key, "left_semi").withColumns({"a": F.xxhash64(key, "ax", "ay"), "b": F.xxhash64(key, "bx", "by")})
    roots = components(large.select("a", "b"))
    return one.join(many, key, "left_anti").unionByName(large.join(roots, large["a"] == roots["node"]).select(key, "root", *ends[1:]))


def shapes(directed: DataFrame, key: str, grid: Grid, precision: float) -> DataFrame:
    """(key, part, rings) of directed edges: chained to rings, holes with the smallest outline around them."""
    kind = dict(directed.dtypes)[key]
    directed, _ = cut(directed)
    sets = _rooted(directed, key).select(F.col(key).alias("out"), "root", "ax", "ay", "bx", "by").repartition("out", "root").sortWithinPartitions("out", "root")
    ddl = f"out {kind}, left_x long, left_y long, area double, mx long, my long, xs array<long>, ys array<long>"
    rings, _ = cut(sets.mapInArrow(_chains(to_arrow_schema(StructType.fromDDL(ddl))), ddl).withColumn("id", F.xxhash64("out", "xs", "ys")))
    corners = F.arrays_zip("xs", "ys")
    points = F.transform(corners, lambda p: F.struct((p["xs"] / STEP * precision).alias("x"), (p["ys"] / STEP * precision).alias("y")))
    outlines, holes = rings.filter("area > 0"), rings.filter("area < 0")
    part = F.row_number().over(Window.partitionBy("out").orderBy("left_x", "left_y", "id"))
    if holes.isEmpty():
        return outlines.select(F.col("out").alias(key), part.alias("part"), F.array(points).alias("rings"))
    lattice = outlines.join(holes.select("out").distinct(), "out", "left_semi").select("out", "id", F.array(F.transform(corners, lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y")))).alias("rings"))
    squares = winding.index(winding.edges_of(lattice, ["out", "id"]), ["out", "id"], grid)
    held = holes.select("out", F.col("id").alias("hole"), F.col("mx").alias("x"), F.col("my").alias("y"), points.alias("ring"))
    around = winding.located(held, squares, grid, ["out"]).filter("winding % 2 <> 0").join(outlines.select("out", "id", "area"), ["out", "id"])
    owner = around.groupBy("out", "hole").agg(F.min_by("id", F.struct("area", "id")).alias("id"), F.first("ring").alias("ring"))
    inner = owner.groupBy("out", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring"))), lambda h: h["ring"]).alias("holes"))
    whole = outlines.join(inner, ["out", "id"], "left").withColumn("rings", F.concat(F.array(points), F.coalesce("holes", F.array().cast(f"array<array<{POINT}>>"))))
    return whole.select(F.col("out").alias(key), part.alias("part"), "rings")


def _bounds(found: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces by key, with whether any of the key's shapes is on their sides."""
    return found.groupBy(*keys, *ENDS).agg(F.max("_r").alias("_right"), F.max("_l").alias("_left"))


def repaired(polygons: DataFrame, key: str, side: float, precision: float = 1e-3, rings: str = "rings") -> DataFrame:
    """Valid parts with the area that the even-odd rule gives a polygon: bow ties fall into two parts, edges that are there
    twice go, rings that touch themselves are cut, and a hole's hole is a part. Polygons without area have no row."""
    grid = grid_of(side, precision)
    pieces = noded(edges_of(polygons, F.col(key), F.lit(0), precision, rings), grid)
    found = sides(pieces, grid).withColumns({"_r": odd(F.col("right")), "_l": odd(F.col("left"))})
    return shapes(half_edges(_bounds(found, ["grp"]), "grp"), "grp", grid, precision).withColumnRenamed("grp", key)


def dissolved(polygons: DataFrame, key: str, by: str, side: float, precision: float = 1e-3, rings: str = "rings") -> DataFrame:
    """(by, part, rings): the union of all polygons of each group, in parts. `key` tells polygons apart."""
    grid = grid_of(side, precision)
    return shapes(_united(edges_of(polygons, F.col(by), F.col(key), precision, rings), grid), "grp", grid, precision).withColumnRenamed("grp", by)


def _united(edges: DataFrame, grid: Grid) -> DataFrame:
    """(grp, ax, ay, bx, by): the boundary of each group's union, the union on its left. A piece of it ends where another
    edge meets it, outside the inside of all shapes; so pieces need to be cut, and their sides known, in open squares only.
    Pieces that were not cut elsewhere are no boundary: a shape holds both of their sides."""
    found = sides(noded(edges, grid, True), grid, True).withColumns({"_r": odd(F.col("right")), "_l": odd(F.col("left"))})
    return half_edges(_bounds(found, ["grp"]), "grp")


def _extents(edges: DataFrame) -> DataFrame:
    """(grp, x1, y1, x2, y2): the box around each group's edges."""
    return edges.groupBy("grp").agg(F.min("x1").alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max("x2").alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"))


def _neighbours(first: DataFrame, second: DataFrame, grid: Grid) -> DataFrame:
    """(a, b): polygons of two layers, given by their edges, that have a square in common and boxes that overlap."""
    squares, boxes = [], []
    for name, edges in (("a", first), ("b", second)):
        squares.append(winding.index(edges, ["grp"], replace(grid, depth=0)).select(F.col("grp").alias(name), "_gx", "_gy"))
        boxes.append(_extents(edges).select(F.col("grp").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ENDS)))
    met = squares[0].join(squares[1], ["_gx", "_gy"]).select("a", "b").distinct()
    over = (F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2")) & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2"))
    return met.join(boxes[0], "a").join(boxes[1], "b").filter(over).select("a", "b")


def intersected(first: DataFrame, second: DataFrame, keys: tuple[str, str], side: float, precision: float = 1e-3, rings: tuple[str, str] = ("rings", "rings")) -> DataFrame:
    """(first key, second key, part, rings): what each polygon of one layer shares with each of another. Polygons with
    squares in common are pairs, each a group of its own with all edges of both: polygons of one layer that overlap are not
    cut at each other, and the work grows with the corners of the pairs."""
    grid = grid_of(side, precision)
    layers = [cut(edges_of(df, F.struct(F.col(k)), F.lit(i), precision, r))[0] for i, (df, k, r) in enumerate(zip((first, second), keys, rings))]
    pairs, _ = cut(_neighbours(*layers, grid))
    group = F.struct(*(F.col(f"{c}.{k}").alias(k) for c, k in zip("ab", keys))).alias("grp")
    edges = [pairs.join(e.withColumnRenamed("grp", c), c).select(group, "shape", *ENDS, "w") for c, e in zip("ab", layers)]
    found = sides(noded(edges[0].unionByName(edges[1]), grid), grid)

    def both(side: str) -> Column:
        return F.count_if(odd(F.col(side))) == 2

    bounding = found.groupBy("grp", *ENDS).agg(both("right").alias("_right"), both("left").alias("_left"))
    return shapes(half_edges(bounding, "grp"), "grp", grid, precision).select("grp.*", "part", "rings")


def differenced(first: DataFrame, second: DataFrame, keys: tuple[str, str], side: float, precision: float = 1e-3, rings: tuple[str, str] = ("rings", "rings")) -> DataFrame:
    """(first key, part, rings): what the second layer's polygons together leave of each of the first. The second layer is
    united before, so that the first is cut at the union's boundary alone."""
    grid = grid_of(side, precision)
    kind = dict(first.dtypes)[keys[0]]
    union = _united(edges_of(second, F.lit(0), F.col(keys[1]), precision, rings[1]), grid)
    taken = winding.left_to_right(union.select("grp", F.struct(F.lit(None).cast(kind).alias("a"), F.lit(1).alias("layer")).alias("shape"), *(F.col(c).alias(e) for c, e in zip(("ax", "ay", "bx", "by"), ENDS)), F.lit(1).alias("w")))
    own = edges_of(first, F.lit(0), F.struct(F.col(keys[0]).alias("a"), F.lit(0).alias("layer")), precision, rings[0])
    found, _ = cut(sides(noded(own.unionByName(taken), grid), grid).withColumns({"_r": odd(F.col("right")), "_l": odd(F.col("left"))}).filter("_r OR _l"))
    a, b = (found.filter(F.col("shape.layer") == i).select(*ENDS, F.col("shape.a").alias("out"), "_r", "_l") for i in (0, 1))
    left = a.join(b.drop("out").withColumnsRenamed({"_r": "_r2", "_l": "_l2"}), list(ENDS), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_r2", "_l2")})
    left = left.withColumns({"_right": F.col("_r") & ~F.col("_r2"), "_left": F.col("_l") & ~F.col("_l2")})
    return shapes(half_edges(left, "out"), "out", grid, precision).withColumnRenamed("out", keys[0])


def offset_curves(polygons: DataFrame, key: str, distance: float, quarter: int, rings: str = "rings") -> DataFrame:
    """(key, x1, y1, x2, y2, w): for each ring the closed curve at a distance from it, outwards. Corners that turn outwards
    get an arc of `quarter` pieces a right angle; at others the curve goes back to the corner, so that its winding number
    is positive just where the buffer is: it adds the ring, a strip of each edge and a sector of each such corner."""
    # corners cost far more than their bytes tell: rows are dealt to many tasks, whatever files they come in
    dealt = winding.dealt(polygons.select(F.col(key).alias("grp"), F.col(rings).alias("rings")), "grp")
    named = dealt.select("grp", F.posexplode("rings").alias("_at", "ring"))
    corners = F.filter("ring", lambda p, i: (i == 0) | (F.get("ring", i - 1)["x"] != p["x"]) | (F.get("ring", i - 1)["y"] != p["y"]))
    # each ring goes through explode, so that what is done with its corners does not make it anew for each of them
    flat = named.select("grp", "_at", F.explode(F.array(corners)).alias("ring")).filter(F.size("ring") >= 4)
    area = geometry.ring_area(F.col("ring"))
    turned = flat.select("grp", F.explode(F.array(F.when((area > 0) == (F.col("_at") == 0), F.col("ring")).otherwise(F.reverse("ring")))).alias("ring"))
    n = F.size("ring") - 1

    def corner(i: Column) -> Column:
        p, o, q = F.get("ring", i), F.get("ring", (i + n - 1) % n), F.get("ring", i + 1)
        ux, uy, vx, vy = p["x"] - o["x"], p["y"] - o["y"], q["x"] - p["x"], q["y"] - p["y"]
        cross, dot = ux * vy - uy * vx, ux * vx + uy * vy
        begin = F.atan2(-ux, uy)  # of the normal on the right of the edge before
        angle = F.when((cross == 0) & (dot < 0), F.pi()).otherwise(F.atan2(cross, dot))
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), begin.alias("begin"), angle.alias("angle"))

    def strip(c: Column) -> Column:
        def on_arc(a: Column) -> Column:
            return F.struct((c["x"] + distance * F.cos(a)).alias("x"), (c["y"] + distance * F.sin(a)).alias("y"))

        pieces = F.greatest(F.ceil(c["angle"] / (F.pi() / 2) * quarter), F.lit(1))
        arc = F.transform(F.sequence(F.lit(0).cast("long"), pieces), lambda k: on_arc(c["begin"] + c["angle"] * k / pieces))
        inward = F.array(on_arc(c["begin"]), F.struct(c["x"].alias("x"), c["y"].alias("y")), on_arc(c["begin"] + c["angle"]))
        return F.when(c["angle"] >= 0, arc).otherwise(inward)

    known = turned.select("grp", F.explode(F.array(F.transform(F.sequence(F.lit(0), n - 1), corner))).alias("corners"))
    curve = known.select("grp", F.explode(F.array(F.flatten(F.transform("corners", strip)))).alias("ring"))
    closed = curve.select("grp", F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))
    return winding.edges_of(closed.select("grp", F.array("ring").alias("rings")), ["grp"])


def buffered(polygons: DataFrame, key: str, distance: float, side: float, quarter: int = 16, precision: float = 1e-3, rings: str = "rings") -> DataFrame:
    """(key, part, rings): all that is within a distance (over 0) of each polygon, with arcs of `quarter` pieces a right
    angle whose corners lie on the arc. Polygons have to be valid (see repaired)."""
    grid = grid_of(side, precision)
    curves = offset_curves(polygons, key, distance, quarter, rings).withColumn("shape", F.lit(0))
    found = sides(noded(on_lattice(curves, precision), grid), grid).withColumns({"_r": positive(F.col("right")), "_l": positive(F.col("left"))})
    return shapes(half_edges(_bounds(found, ["grp"]), "grp"), "grp", grid, precision).withColumnRenamed("grp", key)
