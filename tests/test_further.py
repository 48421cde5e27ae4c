import math
import random

import pytest
from pyspark.sql import functions as F

from gridmere.functions import geometry
from gridmere.functions.geometry import t_quantile
from gridmere.operators import raster, series, spatial, statistics


def test_t_interval_of_many_rows(spark):
    """Beyond the table the quantile goes on falling: it is that of the group's own degrees of freedom."""
    df = spark.range(901).select(F.lit("a").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    r = statistics.t_interval(df, ["k"], "v").first()
    values = [i % 7 for i in range(901)]
    mean = sum(values) / 901
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / 900)
    assert abs(r["high"] - (mean + t_quantile(0.975, 900) * std / math.sqrt(901))) < 1e-9


def test_touching_is_any_shared_point(spark):
    rng = random.Random(4)
    rings = [(k, [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(3)]) for k in range(25)]
    rings = [(k, [{"x": x, "y": y} for x, y in [*r, r[0]]]) for k, r in rings]
    polygons = spark.createDataFrame(rings, "poly int, ring array<struct<x: double, y: double>>")
    cells = spark.createDataFrame([(r, c, c + 0.5, r + 0.5) for r in range(20) for c in range(20)], "row int, col int, x double, y double")
    got = {(r["row"], r["col"], r["poly"]) for r in spatial.touching(cells, polygons, 5.0, 0.5).collect()}
    for poly, ring in rings:
        pts = [(p["x"], p["y"]) for p in ring]
        for r in range(20):
            for c in range(20):
                part = pts[:-1]
                for axis, low, keep in ((0, c, 1), (0, c + 1, -1), (1, r, 1), (1, r + 1, -1)):  # the triangle cut by the square's sides
                    cut = []
                    for p, q in zip(part, part[1:] + part[:1]):
                        a, b = keep * (p[axis] - low), keep * (q[axis] - low)
                        if a >= 0:
                            cut.append(p)
                        if a * b < 0:
                            t = a / (a - b)
                            cut.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
                    part = cut
                assert ((r, c, poly) in got) == bool(part), (r, c, poly)


def test_drawn_rows_are_as_many_as_asked(spark):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("v"))
    for n in (0, 7, 200):
        rows = [tuple(r) for r in series.drawn(df, ["id"], n, 3).collect()]
        assert len(rows) == n and all(v == 2 * i and 0 <= i < 50 for i, v in rows)
        assert sorted(rows) == sorted(map(tuple, series.drawn(df, ["id"], n, 3).collect()))
    assert series.drawn(df.limit(0), ["id"], 5, 3).count() == 0


def test_contacts_join_edge_cells_only(spark):
    cells = spark.createDataFrame([(r, c, r * 30 + c) for r in range(30) for c in range(30) if (r * 7 + c * 3) % 5], "row int, col int, id long")
    fragments = raster.label_tiles(raster.tiled(cells, 10, 10))
    all_cells, edges = raster.contacts(fragments), raster.contacts(fragments, tile=(10, 10))
    assert sorted(map(tuple, all_cells.collect())) == sorted(map(tuple, edges.collect()))
    assert "% 10" in edges._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_probabilities_fall_in_many_blocks(spark):
    df = spark.range(2000).select((F.col("id") / 2000).alias("s"), (F.col("id") % 3 == 0).alias("t"))
    rows = {r["s"]: r for r in statistics.precision_recall(df, "s", "t").collect()}
    r = rows[0.5]
    tp = sum(1 for i in range(1000, 2000) if i % 3 == 0)
    assert r["tp"] == tp and abs(r["precision"] - tp / 1000) < 1e-12 and abs(r["recall"] - tp / 667) < 1e-12


RINGS = "array<struct<x: double, y: double>>"


def _ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def test_clip_of_a_ring_with_a_notch(spark):
    """The box cuts a U-shaped ring into two pieces; their area is right, and what is outside goes."""
    u = _ring((0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10))
    shapes = spark.createDataFrame([(1, u)], f"poly int, ring {RINGS}")
    boxes = spark.createDataFrame([("top", 1.0, 5.0, 9.0, 9.0), ("notch", 4.0, 4.0, 6.0, 9.0), ("all", -1.0, -1.0, 11.0, 11.0), ("far", 50.0, 50.0, 60.0, 60.0)], "id string, x_min double, y_min double, x_max double, y_max double")
    area = F.abs(geometry.ring_area(F.col("ring"))).alias("area")
    for side in (3.0, 100.0):
        assert {r["id"]: r["area"] for r in spatial.clipped(shapes, boxes, side).select("id", area).collect()} == {"top": 16.0, "all": 72.0}


def test_overlapping_polygons_once_each(spark):
    a = spark.createDataFrame([(1, _ring((0, 0), (10, 0), (10, 10), (0, 10)))], f"a int, ring {RINGS}")
    b = spark.createDataFrame([(1, _ring((2, 2), (3, 2), (3, 3))), (2, _ring((-5, -5), (20, -5), (20, 20), (-5, 20))), (3, _ring((10, 10), (12, 10), (12, 12))), (4, _ring((11, 0), (12, 0), (12, 5))), (5, _ring((5, -5), (6, -5), (6, 15)))], f"b int, other_ring {RINGS}")
    assert sorted(r["b"] for r in spatial.overlapping(a, b, 2.0).collect()) == [1, 2, 3, 5]  # within, around, a shared corner, across


def test_nearest_polygon_has_a_row_for_every_point(spark):
    shapes = spark.createDataFrame([(1, _ring((0, 0), (400, 0), (400, 1), (0, 1))), (2, _ring((0, 50), (1, 50), (1, 51)))], f"poly int, ring {RINGS}")
    points = spark.createDataFrame([(1, 200.0, 0.5), (2, 200.0, 30.0), (3, 0.5, 30.0), (4, 3000.0, 0.0), (5, 0.0, 0.0)], "point_id int, x double, y double")
    got = {r["point_id"]: (r["poly"], round(r["apart"], 6)) for r in spatial.nearest_polygon(points, shapes, 5.0).collect()}
    assert got == {1: (1, 0.0), 2: (1, 29.0), 3: (2, 20.0), 4: (1, 2600.0), 5: (1, 0.0)}


@pytest.mark.parametrize("full", [64, 0])
def test_nearest_polygon_measures_few_edges(spark, monkeypatch, full):
    """Against all rings: points on corners, edges and lines through corners, shapes that lie over each other or have very many
    corners, empty rings. Points meet the edges near their cell alone, no whole ring, and none is sent to many squares."""
    monkeypatch.setattr(spatial, "FULL", full)
    draw = random.Random(8)
    star = [(300 + (60 + 30 * (i % 2)) * math.cos(i * math.pi / 200), 60 + (60 + 30 * (i % 2)) * math.sin(i * math.pi / 200)) for i in range(400)]
    rings = [star, [(0, 0), (40, 0), (40, 40), (0, 40)], [(10, 10), (90, 10), (10, 90)], [(100, 0), (150, 0), (150, 50), (140, 10), (110, 10), (100, 50)], [(-400, -30), (900, -45), (900, -40)]]
    rings += [[(x + draw.randrange(60), y + draw.randrange(60)) for _ in range(draw.randint(3, 6))] for x, y in ((draw.randrange(500), draw.randrange(100, 300)) for _ in range(25))]
    shapes = spark.createDataFrame([*((k, _ring(*r)) for k, r in enumerate(rings)), (900, [])], f"poly int, ring {RINGS}")
    places = [(draw.randrange(-100, 600), draw.randrange(-100, 400)) for _ in range(400)] + [(draw.uniform(-50, 600), draw.uniform(-50, 400)) for _ in range(400)] + [p for r in rings[1:6] for p in r] + [(20, 40), (5000, -3000), (-700, 900)]
    points = spark.createDataFrame([*((i, float(x), float(y)) for i, (x, y) in enumerate(places)), (9000, None, 0.0), (9001, float("nan"), 0.0)], "point_id int, x double, y double")

    def apart(x, y, ring):
        best, odd = float("inf"), False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            l2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / l2)) if l2 else 0.0
            best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return 0.0 if odd else best

    found = spatial.nearest_polygon(points, shapes, 20.0)
    got = {r["point_id"]: (r["poly"], r["apart"]) for r in found.collect()}
    assert sorted(got) == list(range(len(places)))
    for i, (x, y) in enumerate(places):
        ways = [apart(x, y, r) for r in rings]
        assert abs(got[i][1] - min(ways)) < 1e-9 and ways[got[i][0]] <= min(ways) + 1e-9, (i, x, y)
        assert got[i][0] == min(k for k, w in enumerate(ways) if w == min(ways)) or sorted(ways)[1] - min(ways) < 1e-9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_ring" not in plan and plan.count("Generate") <= 1 and "Aggregate" not in plan
    assert spatial.nearest_polygon(points, shapes.limit(0), 20.0).count() == 0 and spatial.nearest_polygon(points.limit(0), shapes, 20.0).count() == 0
