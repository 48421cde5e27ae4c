import random

from gridmere.operators import scanline

from .test_overlay import BOX, frame
from .test_winding import odd, star


def on_edge(x, y, rings):
    return any((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for r in rings for (x1, y1), (x2, y2) in zip(r, r[1:]))


def clipped(ring, low, high, axis):
    """A ring's part between two levels, by both sides in turn."""
    for level, sign in ((low, 1), (high, -1)):
        if not ring:
            return []
        out = []
        for p, q in zip(ring, [*ring[1:], ring[0]]):
            a, b = sign * (p[axis] - level), sign * (q[axis] - level)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append(tuple(level if k == axis else p[k] + t * (q[k] - p[k]) for k in (0, 1)))
        ring = out
    return ring


def area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, [*ring[1:], ring[0]])) / 2


def test_cells_and_shares_against_each_cell(spark):
    draw = random.Random(6)
    shapes = {k: [star(draw.uniform(0, 40), draw.uniform(0, 40), 14, 20, draw)[:-1]] for k in range(5)}
    shapes[5] = [star(20, 20, 18, 60, draw, 0.2)[:-1], star(20, 20, 7, 9, draw)[:-1]]
    shapes[6] = [[(3.5, 3.5), (9.5, 3.5), (9.5, 7.5), (6.5, 10.5), (3.5, 7.5)]]  # centres on edges and corners
    shapes[7] = [[(x + 2, y + 3) for x, y in BOX], [(x / 2 + 4, y / 2 + 4) for x, y in BOX]]
    found = {(r.poly, r.row, r.col) for r in scanline.cells_within(frame(spark, shapes), "poly").collect()}
    share = {(r.poly, r.row, r.col): r.share for r in scanline.shares(frame(spark, shapes), "poly").collect()}
    for k, rings in shapes.items():
        closed = [[*r, r[0]] for r in rings]
        for row in range(-20, 60):
            for col in range(-20, 60):
                x, y = col + 0.5, row + 0.5
                assert ((k, row, col) in found) == (odd(x, y, closed) and not on_edge(x, y, closed))
                parts = [abs(area(p)) if (p := clipped(clipped(r, col, col + 1, 0), row, row + 1, 1)) else 0.0 for r in rings]
                assert abs(share.get((k, row, col), 0.0) - (parts[0] - sum(parts[1:]))) < 1e-9
    coarse = {(r.row, r.col) for r in scanline.cells_within(frame(spark, {1: [BOX]}), "poly", "rings", -5.0, -5.0, 2.5).collect()}
    assert coarse == {(r, c) for r in range(2, 6) for c in range(2, 6)}
    assert scanline.shares(frame(spark, shapes).limit(0), "poly").count() == 0
