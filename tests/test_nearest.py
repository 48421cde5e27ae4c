import math
import random

from gridmere.operators import spatial


def test_far_targets_are_found(spark):
    points = [(0, 0.0, 0.0), (1, 5000.0, 1.0), (2, 900.0, 0.0)]
    targets = [(0, 3000.0, 0.0), (1, 0.0, 1200.0)]
    want = {p: min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, t) for t, a, b in targets)[::-1] for p, x, y in points}
    p = spark.createDataFrame(points, "point_id long, x double, y double")
    t = spark.createDataFrame(targets, "target_id long, tx double, ty double")
    assert {r["point_id"]: (r["target_id"], r["apart"]) for r in spatial.nearest(p, t, 5.0).collect()} == want
    assert spatial.nearest(p, t.limit(0), 5.0).count() == 0 and spatial.nearest(p.limit(0), t, 5.0).count() == 0


def test_far_cells_are_filled(spark):
    cells = spark.createDataFrame([(0, c, 7.0 if c == 0 else None) for c in range(0, 1000, 50)], "row long, col long, value double")
    assert {r["value"] for r in spatial.nearest_fill(cells).collect()} == {7.0}


def test_crowded_targets_and_odd_points(spark, monkeypatch):
    """Targets in one spot and far off: the first squares shrink, and arrays are cut in parts."""
    monkeypatch.setattr(spatial, "CHUNK", 50)
    draw = random.Random(3)
    targets = [(i, draw.randrange(400) / 4, draw.randrange(400) / 4) for i in range(3000)] + [(5000 + i, 900.0 + draw.random(), 50.0) for i in range(300)]
    points = [(i, draw.uniform(-50, 150), draw.uniform(-50, 150)) for i in range(300)] + [(i, draw.uniform(300, 1200), 50.0) for i in range(300, 360)] + [(900, None, 1.0), (901, float("inf"), 1.0), (902, float("nan"), 1.0)]
    want = {p: min((math.sqrt((x - a) ** 2 + (y - b) ** 2), t) for t, a, b in targets)[::-1] for p, x, y in points[:360]}
    p = spark.createDataFrame(points, "point_id long, x double, y double")
    t = spark.createDataFrame([*targets, (9000, float("nan"), 1.0), (9001, None, 1.0)], "target_id long, tx double, ty double")
    found = {r["point_id"]: (r["target_id"], r["apart"]) for r in spatial.nearest(p, t, 64.0).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()} and all(abs(found[k][1] - want[k][1]) < 1e-9 for k in want)
