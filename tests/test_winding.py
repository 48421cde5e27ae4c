import random
from math import cos, pi, sin

import pytest
from pyspark.sql import functions as F

from gridmere.operators import winding

POINT = "struct<x: double, y: double>"


def star(cx, cy, radius, n, draw, dent=0.6):
    """A closed ring of n corners whose distance from the centre jumps about."""
    ring = [(cx + (r := radius * (1 - dent * draw.random())) * cos(2 * pi * k / n), cy + r * sin(2 * pi * k / n)) for k in range(n)]
    return [*ring, ring[0]]


def odd(x, y, rings):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for r in rings for (x1, y1), (x2, y2) in zip(r, r[1:])) % 2 == 1


def shapes(draw):
    """Polygons with holes and several parts; some overlap, one is far larger than the squares."""
    out = {0: [star(500, 500, 480, 700, draw, 0.1), star(500, 500, 200, 60, draw), star(300, 760, 60, 9, draw)]}
    for k in range(1, 25):
        x, y = draw.uniform(0, 1000), draw.uniform(0, 1000)
        out[k] = [star(x, y, 60, 40, draw), star(x, y, 10, 5, draw), star(x + 150, y, 20, 6, draw)]
    return out


@pytest.mark.parametrize("side", [37.0, 400.0, 5000.0])
def test_points_in_polygons_with_holes_and_parts(spark, side):
    draw = random.Random(2)
    polygons = shapes(draw)
    points = [(i, draw.uniform(-50, 1050), draw.uniform(-50, 1050)) for i in range(3000)] + [(9000, None, 1.0), (9001, float("nan"), 1.0), (9002, float("inf"), 1.0)]
    p = spark.createDataFrame(points, "point_id long, x double, y double")
    q = spark.createDataFrame([(k, [[{"x": a, "y": b} for a, b in r] for r in rings]) for k, rings in polygons.items()], f"poly long, rings array<array<{POINT}>>")
    expected = {(i, k) for i, x, y in points[:3000] for k, rings in polygons.items() if odd(x, y, rings)}
    grid = winding.Grid(side, depth=4, most=8)
    found = winding.within_join(p, q, "poly", grid)
    assert {(r.point_id, r.poly) for r in found.collect()} == expected and found.count() == len(expected)
    if side == 400.0:
        inside = {i for i, _ in expected}
        assert {r.point_id for r in winding.within_join(p, q, "poly", grid, "left_semi").collect()} == inside
        assert {r.point_id for r in winding.within_join(p, q, "poly", grid, "left_anti").collect()} == {i for i, *_ in points} - inside
        assert winding.within_join(p, q, "poly", grid, "left").filter("poly is null").count() == len(points) - len(inside)
        assert {r.poly for r in winding.within_join(p, q, "poly", grid, "right").collect()} == set(polygons)
        squares = winding.index(winding.edges_of(q, ["poly"]), ["poly"], grid)
        assert squares.agg(F.max(F.size("edges"))).first()[0] <= 40 < 700  # no point meets a large polygon's edges
    assert winding.within_join(p, q.limit(0), "poly", grid).count() == 0 == winding.within_join(p.limit(0), q, "poly", grid).count()


def test_whole_numbers_are_exact(spark):
    """Points on corners, edges and straight above or beside corners; polygons that touch, with edges along grid lines."""
    draw = random.Random(4)
    rings = {k: [(16 * draw.randrange(20), 16 * draw.randrange(20)) for _ in range(7)] for k in range(40)}
    q = spark.createDataFrame([(k, [[{"x": 4 * a, "y": 4 * b} for a, b in [*r, r[0]]]]) for k, r in rings.items()], "poly long, rings array<array<struct<x: long, y: long>>>")
    points = [(i, 4 * x, 4 * y) for i, (x, y) in enumerate((x, y) for x in range(0, 320, 8) for y in range(0, 320, 8))]
    p = spark.createDataFrame(points, "point_id long, x long, y long")
    for side in (256, 1024):
        grid = winding.Grid(side, depth=2, most=3, whole=True)
        found = winding.located(p, winding.index(winding.edges_of(q, ["poly"]), ["poly"], grid), grid).filter("winding % 2 <> 0 AND NOT on_edge").select("point_id", "poly")
        edge = {k: [(4 * a[0], 4 * a[1], 4 * b[0], 4 * b[1]) for a, b in zip(r, [*r[1:], r[0]])] for k, r in rings.items()}

        def on(x, y, e):
            return any((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for x1, y1, x2, y2 in e)

        expected = {(i, k) for i, x, y in points for k, e in edge.items() if not on(x, y, e) and sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in e) % 2}
        assert {tuple(r) for r in found.collect()} == expected


def test_many_edges_in_a_square_go_by_rows(spark, monkeypatch):
    """The same points are within, and no row holds more than a bound, when polygons have more edges in a square than that."""
    draw = random.Random(2)
    polygons = shapes(draw)
    points = [(i, float(draw.randrange(-50, 1050)), float(draw.randrange(-50, 1050))) for i in range(2000)]
    p = spark.createDataFrame([*points, (9000, *points[0][1:])], "point_id long, x double, y double")
    q = spark.createDataFrame([(k, [[{"x": a, "y": b} for a, b in r] for r in rings]) for k, rings in polygons.items()], f"poly long, rings array<array<{POINT}>>")
    monkeypatch.setattr(winding, "HELD", 20)
    sizes, real = [], winding.located
    monkeypatch.setattr(winding, "located", lambda points, squares, *args, **more: (sizes.append(squares.agg(F.max(F.size("edges"))).first()[0]), real(points, squares, *args, **more))[1])
    found = {(r.point_id, r.poly) for r in winding.within_join(p, q, "poly", winding.Grid(400.0, depth=2, most=8)).collect()}
    expected = {(i, k) for i, x, y in points for k, rings in polygons.items() if odd(x, y, rings)}
    assert found == expected | {(9000, k) for i, k in expected if i == 0}
    assert max(s for s in sizes if s) <= 40
