import random
from itertools import pairwise
from math import cos, hypot, pi, sin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmere.functions import geometry
from gridmere.operators import overlay, winding

from .test_winding import POINT, odd, star

SCHEMA = f"poly long, rings array<array<{POINT}>>"


def frame(spark, polygons, name="poly"):
    rows = [(k, [[{"x": float(a), "y": float(b)} for a, b in [*r, r[0]]] for r in rings]) for k, rings in polygons.items()]
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("poly", name)


def plain(df, keys):
    """{key: [rings of each part]}"""
    out = {}
    for r in df.orderBy(*keys, "part").collect():
        out.setdefault(tuple(r[k] for k in keys), []).append([[(p.x, p.y) for p in ring] for ring in r.rings])
    return out


def signed(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) / 2


def area(parts):
    return sum(signed(r) for rings in parts for r in rings)


def simple(parts):
    """Each outline anticlockwise, each hole clockwise, and no ring passes a corner twice."""
    return all(signed(rings[0]) > 0 and all(signed(h) < 0 for h in rings[1:]) and all(len(set(r[:-1])) == len(r) - 1 and r[0] == r[-1] for r in rings) for rings in parts)


def holds(x, y, parts):
    return odd(x, y, [r for rings in parts for r in rings])


BOX = [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_repair_by_hand(spark):
    polygons = {
        1: [[(0, 0), (4, 4), (4, 0), (0, 4)]],  # bow tie
        2: [BOX, [(5, 0), (8, 3), (5, 6), (2, 3)]],  # a hole that touches the outline's edge
        3: [[(0, 0), (10, 0), (10, 10), (5, 10), (5, 2), (5, 10), (0, 10)]],  # an edge there and back
        4: [BOX, [(2, 2), (8, 2), (8, 8), (2, 8)], [(4, 4), (6, 4), (6, 6), (4, 6)]],  # a part in a hole
        5: [BOX, BOX],  # twice the same: no area
        6: [[(0, 0), (2, 0), (2, 2), (4, 2), (4, 4), (2, 4), (2, 2), (0, 2)]],  # two squares that touch in a corner
        7: [[(0, 0), (1, 1)]],
        8: [[(0, 0), (6, 0), (6, 6), (3, 6), (2, 3), (4, 3), (3, 6), (0, 6)]],  # a hole drawn as part of the outline
        9: [[(10, 10), (0, 10), (0, 0), (10, 0)], [(3, 3), (3, 6), (6, 6), (6, 3)]],  # turned the wrong way round
    }
    polygons[10] = []
    found = plain(overlay.repaired(frame(spark, polygons), "poly", 4.0), ["poly"])
    assert {k: (len(v), sorted(len(r) - 1 for r in v), round(area(v), 6)) for (k,), v in found.items()} == {
        1: (2, [0, 0], 8), 2: (1, [1], 82), 3: (1, [0], 100), 4: (2, [0, 1], 68), 6: (2, [0, 0], 8), 8: (1, [1], 33), 9: (1, [1], 91),
    }
    assert all(simple(v) for v in found.values())
    again = overlay.repaired(overlay.repaired(frame(spark, polygons), "poly", 4.0), "poly", 4.0)
    assert {k: area(v) for k, v in plain(again, ["poly"]).items()} == {k: area(v) for k, v in found.items()}


@pytest.mark.parametrize("seed", [1])
def test_random_shapes_against_points(spark, seed):
    """Every form against what points say, for crossing and many-cornered polygons; parts of a result share no point."""
    draw = random.Random(seed)
    mad = {k: [[(draw.randrange(100), draw.randrange(100)) for _ in range(9)]] for k in range(4)}
    a = {k: [star(draw.uniform(0, 100), draw.uniform(0, 100), 35, 30, draw)[:-1], star(50, 50, 8, 7, draw)[:-1]] for k in range(3)}
    b = {k: [star(draw.uniform(0, 100), draw.uniform(0, 100), 25, 12, draw)[:-1]] for k in range(10, 14)}
    points = [(draw.uniform(-40, 140), draw.uniform(-40, 140)) for _ in range(800)]
    closed = lambda shapes: {k: [[[*r, r[0]] for r in rings]] for k, rings in shapes.items()}
    mended = plain(overlay.repaired(frame(spark, mad), "poly", 30.0, 1e-4), ["poly"])
    for k, parts in closed(mad).items():
        assert all(holds(x, y, mended[(k,)]) == holds(x, y, parts) for x, y in points) and simple(mended[(k,)])
        assert all(sum(odd(x, y, rings) for rings in mended[(k,)]) <= 1 for x, y in points)
    fa, fb = frame(spark, a), frame(spark, b, "other")
    ca, cb = closed(a), closed(b)
    both = plain(overlay.intersected(fa, fb, ("poly", "other"), 20.0, 1e-4), ["poly", "other"])
    for i in a:
        for j in b:
            assert all(holds(x, y, both.get((i, j), [])) == (holds(x, y, ca[i]) and holds(x, y, cb[j])) for x, y in points)
    less = plain(overlay.differenced(fa, fb, ("poly", "other"), 20.0, 1e-4), ["poly"])
    for i in a:
        assert all(holds(x, y, less.get((i,), [])) == (holds(x, y, ca[i]) and not any(holds(x, y, cb[j]) for j in b)) for x, y in points)
    grouped = fb.withColumn("half", F.col("other") % 2)
    union = plain(overlay.dissolved(grouped, "other", "half", 20.0, 1e-4), ["half"])
    for h in (0, 1):
        assert all(holds(x, y, union[(h,)]) == any(holds(x, y, cb[j]) for j in b if j % 2 == h) for x, y in points)
    assert all(simple(v) for out in (both, less, union) for v in out.values())


def apart(x, y, parts):
    if holds(x, y, parts):
        return 0.0
    best = 1e9
    for r in (r for rings in parts for r in rings):
        for (x1, y1), (x2, y2) in pairwise(r):
            dx, dy = x2 - x1, y2 - y1
            t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            best = min(best, hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


@pytest.mark.parametrize("distance", [3.0, 30.0])
def test_buffers_against_distances(spark, distance):
    draw = random.Random(7)
    a = {k: [star(60 * k, 50, 40, 25, draw)[:-1], star(60 * k, 50, 12, 8, draw)[:-1]] for k in range(3)}
    a[11] = [BOX]
    a[9] = [[(0, 0), (100, 0), (100, 100), (52, 100), (52, 5), (48, 5), (48, 100), (0, 100)]]  # a slit that closes
    found = plain(overlay.buffered(frame(spark, a), "poly", distance, 20.0, 16, 1e-4), ["poly"])
    error = distance * (1 - cos(pi / 64)) + 1e-3
    for k, rings in a.items():
        parts = [[[*r, r[0]] for r in rings]]
        assert simple(found[(k,)]) and len(found[(k,)]) == 1
        for _ in range(600):
            x, y = draw.uniform(-80, 260), draw.uniform(-80, 200)
            d = apart(x, y, parts)
            if d < distance - error:
                assert holds(x, y, found[(k,)])
            elif d > distance + 1e-3:
                assert not holds(x, y, found[(k,)])
    square = {(1,): found[(11,)]}
    arcs = 4 * 16 * 0.5 * distance**2 * sin(pi / 32)
    assert abs(area(square[(1,)]) - (100 + 40 * distance + arcs)) < 0.05


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=3, max_size=6, unique=True), min_size=1, max_size=4))
def test_chains_of_closed_ways(ways):
    """Rings hold every directed edge once, and come back to no corner."""
    edges = [(p, q) for way in ways for p, q in zip(way, [*way[1:], way[0]])]
    rings = list(overlay.chained([p for p, _ in edges], [q for _, q in edges]))
    assert sorted(e for r in rings for e in zip(r, r[1:])) == sorted(edges)
    assert all(r[0] == r[-1] and len(set(r[:-1])) == len(r) - 1 for r in rings)


def test_empty_and_far(spark):
    none = frame(spark, {1: [BOX]}).limit(0)
    assert overlay.repaired(none, "poly", 4.0).count() == 0
    assert overlay.intersected(none, frame(spark, {2: [BOX]}, "other"), ("poly", "other"), 4.0).count() == 0
    assert overlay.differenced(frame(spark, {1: [BOX]}), none.withColumnRenamed("poly", "other"), ("poly", "other"), 4.0).count() == 1
    with pytest.raises(Exception, match="2\\*\\*27"):
        overlay.repaired(frame(spark, {1: [[(0, 0), (1e9, 0), (0, 1e9)]]}), "poly", 4.0).count()
    assert winding.Grid(64, 1, whole=True).sides() == [64, 16]
    assert spark.range(1).select(geometry.ring_area(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [*BOX, BOX[0]])))).first()[0] == 100

def test_shapes_that_share_corners_need_no_components(spark, monkeypatch):
    """Buffers of a lattice of boxes share corners, but are chained one by one; only shapes of many edges go by connected
    sets, which are of one shape."""
    rows = {k: [[(4 * a + 10 * (k % 4), 4 * b + 10 * (k // 4)) for a, b in [(0, 0), (5, 0), (5, 5), (0, 5)]]] for k in range(16)}
    seen = []
    real = overlay.components
    monkeypatch.setattr(overlay, "components", lambda edges: seen.append(edges.count()) or real(edges))
    one = {k: area(v) for k, v in plain(overlay.buffered(frame(spark, rows), "poly", 5.0, 40.0, 2, 0.25), ["poly"]).items()}
    assert not seen and len(one) == 16
    monkeypatch.setattr(overlay, "CHAINED", 10)
    assert {k: area(v) for k, v in plain(overlay.buffered(frame(spark, rows), "poly", 5.0, 40.0, 2, 0.25), ["poly"]).items()} == one
    assert len(seen) == 1


@pytest.mark.parametrize("form", ["dissolved", "intersected", "differenced"])
def test_shapes_over_each_other_are_not_all_cut(spark, monkeypatch, form):
    """Fifty boxes that all overlap have thousands of crossings, of which the results need few."""
    draw = random.Random(3)
    boxes = {k: [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]] for k in range(50) for x, y, w, h in [[draw.randrange(20), draw.randrange(20), draw.randrange(40, 60), draw.randrange(40, 60)]]}
    cells = {(x, y) for ((a, b), _, (c, d), _), in boxes.values() for x in range(a, c) for y in range(b, d)}
    pieces, real = [], overlay.noded
    monkeypatch.setattr(overlay, "noded", lambda *args: (found := real(*args), pieces.append(found.count()))[0])
    whole = frame(spark, {1: [[(-5, -5), (90, -5), (90, 90), (-5, 90)]]})
    if form == "dissolved":
        found = plain(overlay.dissolved(frame(spark, boxes).withColumn("all", F.lit(0)), "poly", "all", 40.0, 0.25), ["all"])
        assert area(found[(0,)]) == len(cells)
    elif form == "differenced":
        found = plain(overlay.differenced(whole, frame(spark, boxes, "other"), ("poly", "other"), 40.0, 0.25), ["poly"])
        assert area(found[(1,)]) == 95 * 95 - len(cells)
    else:
        found = plain(overlay.intersected(whole, frame(spark, boxes, "other"), ("poly", "other"), 40.0, 0.25), ["poly", "other"])
        assert {k: area(v) for (_, k), v in found.items()} == {k: abs(signed([*b[0], b[0][0]])) for k, b in boxes.items()}
    assert sum(pieces) < 1500
