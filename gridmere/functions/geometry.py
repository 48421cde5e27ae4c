"""Geometry as column expressions.

A ring is an array of structs (x, y) whose last point equals its first; a polygon is an array of rings, holes after the
outline. Points are two columns.
"""

from __future__ import annotations

from collections.abc import Callable
from math import atan, cos, log, pi, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equal-area conic parameters and ellipsoid (semi-major axis, inverse flattening); fixed values.
ALBERS = {"lat_0": -32.0, "lon_0": -60.0, "lat_1": -5.0, "lat_2": -42.0, "a": 6378160.0, "rf": 298.25}


def _conic(p: dict) -> tuple[float, float, float, float, float, float]:
    f = 1 / p["rf"]
    e2 = 2 * f - f * f
    e = sqrt(e2)

    def q(lat: float) -> float:
        s = sin(lat)
        return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m2(lat: float) -> float:
        return cos(lat) ** 2 / (1 - e2 * sin(lat) ** 2)

    lat0, lat1, lat2 = (p[k] * pi / 180 for k in ("lat_0", "lat_1", "lat_2"))
    n = (m2(lat1) - m2(lat2)) / (q(lat2) - q(lat1))
    c = m2(lat1) + n * q(lat1)
    return e2, e, n, c, p["a"] * sqrt(c - n * q(lat0)) / n, q(pi / 2)


def albers(lon: Column, lat: Column, p: dict = ALBERS) -> tuple[Column, Column]:
    """x, y in metres of degrees, on the ellipsoid (Snyder 1987, equations 14-1 to 14-4). No datum shift."""
    e2, e, n, c, rho0, _ = _conic(p)
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = p["a"] * F.sqrt(c - n * q) / n
    theta = n * F.radians(lon - p["lon_0"])
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column, p: dict = ALBERS) -> tuple[Column, Column]:
    """Degrees of metres, by the series from authalic to geodetic latitude (equation 3-18)."""
    e2, _, n, c, rho0, pole = _conic(p)
    sign = 1.0 if n > 0 else -1.0
    rho = sign * F.sqrt(x * x + (rho0 - y) * (rho0 - y))
    theta = F.atan2(sign * x, sign * (rho0 - y))
    q = (c - (rho * n / p["a"]) * (rho * n / p["a"])) / n
    beta = F.asin(F.least(F.greatest(q / pole, F.lit(-1.0)), F.lit(1.0)))
    e4, e6 = e2 * e2, e2 * e2 * e2
    lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
    return p["lon_0"] + F.degrees(theta) / n, F.degrees(lat)


def pixel_centre(row: Column, col: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """Map coordinates of a pixel's centre under an affine transform."""
    x, y = col + 0.5, row + 0.5
    return a * x + b * y + c, d * x + e * y + f


def pixel_of(x: Column, y: Column, a: float, c: float, e: float, f: float) -> tuple[Column, Column]:
    """Row and column of map coordinates under a transform without rotation."""
    return F.floor((y - f) / e), F.floor((x - c) / a)


def _segments(ring: Column):
    return F.sequence(F.lit(0), F.size(ring) - 2)


def ring_area(ring: Column) -> Column:
    """Signed area: positive for anticlockwise rings."""
    return F.aggregate(_segments(ring), F.lit(0.0), lambda acc, i: acc + (F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"]) / 2)


def polygon_area(rings: Column) -> Column:
    """Area of the outline less that of the holes."""
    areas = F.transform(rings, lambda r: F.abs(ring_area(r)))
    return F.get(areas, 0) - F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x)


def line_length(points: Column) -> Column:
    return F.aggregate(_segments(points), F.lit(0.0), lambda acc, i: acc + F.hypot(F.get(points, i + 1)["x"] - F.get(points, i)["x"], F.get(points, i + 1)["y"] - F.get(points, i)["y"]))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    def weighted(axis: str) -> Column:
        def step(acc, i):
            p, q = F.get(ring, i), F.get(ring, i + 1)
            return acc + (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])

        return F.aggregate(_segments(ring), F.lit(0.0), step)

    area = ring_area(ring)
    return F.try_divide(weighted("x"), 6 * area), F.try_divide(weighted("y"), 6 * area)


def ring_valid(ring: Column) -> Column:
    """Closed, with four points at least and some area."""
    return F.coalesce((F.size(ring) >= 4) & (F.get(ring, 0) == F.element_at(ring, -1)) & (ring_area(ring) != 0), F.lit(False))


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x_min": F.array_min(xs), "x_max": F.array_max(xs), "y_min": F.array_min(ys), "y_max": F.array_max(ys)}


def on_boundary(x: Column, y: Column, ring: Column) -> Column:
    def on(i):
        p, q = F.get(ring, i), F.get(ring, i + 1)
        flat = (q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])
        return flat & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.exists(_segments(ring), on)


def crossings(x: Column, y: Column, ring: Column) -> Column:
    """How often a ray from the point to the right crosses the ring."""

    def step(acc, i):
        p, q = F.get(ring, i), F.get(ring, i + 1)
        over = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]
        return acc + F.when(over & (x < at), 1).otherwise(0)

    return F.aggregate(_segments(ring), F.lit(0), step)


def within(x: Column, y: Column, ring: Column) -> Column:
    """Inside a ring; points on it are not within."""
    return (crossings(x, y, ring) % 2 == 1) & ~on_boundary(x, y, ring)


def within_polygon(x: Column, y: Column, rings: Column) -> Column:
    odd = F.aggregate(F.transform(rings, lambda r: crossings(x, y, r)), F.lit(0), lambda a, n: a + n) % 2 == 1
    return odd & ~F.exists(rings, lambda r: on_boundary(x, y, r))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance to a ring's area: 0 inside."""
    edges = F.transform(_segments(ring), lambda i: segment_distance(x, y, F.get(ring, i)["x"], F.get(ring, i)["y"], F.get(ring, i + 1)["x"], F.get(ring, i + 1)["y"]))
    return F.when(within(x, y, ring), 0.0).otherwise(F.array_min(edges))


def _once(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value computed once however often make() names it."""
    return F.get(F.transform(F.array(value), make), 0)


def _half(axis: str, level: Column, sign: int) -> Callable[[Column], Column]:
    """Makes the part of a ring on one side of a level; an empty array if there is none."""

    def make(ring: Column) -> Column:
        def part(i: Column) -> Column:
            p, q = F.get(ring, i), F.get(ring, i + 1)
            a, b = sign * (p[axis] - level), sign * (q[axis] - level)

            def at(name: str) -> Column:
                return (level if name == axis else p[name] + F.try_divide(a, a - b) * (q[name] - p[name])).alias(name)

            cut = F.struct(at("x"), at("y"))
            return F.when((a >= 0) & (a * b < 0), F.array(p, cut)).when(a >= 0, F.array(p)).when(a * b < 0, F.array(cut)).otherwise(F.slice(F.array(cut), 1, 0))

        return _once(F.flatten(F.transform(_segments(ring), part)), lambda points: F.concat(points, F.slice(points, 1, 1)))

    return make


def clipped(ring: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """The part of a ring inside a box, closed, cut by one side after the other. A part in several pieces comes as one ring
    with edges along the box's sides, which add no area; nothing inside gives an empty array."""
    for axis, level, sign in (("x", x_min, 1), ("x", x_max, -1), ("y", y_min, 1), ("y", y_max, -1)):
        ring = _once(ring, _half(axis, level.cast("double"), sign))
    return ring


def box_area(ring: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """Area of a ring inside a box."""
    return _once(clipped(ring, x_min, y_min, x_max, y_max), lambda r: F.when(F.size(r) < 4, 0.0).otherwise(F.abs(ring_area(r))))


def rings_meet(a: Column, b: Column) -> Column:
    """Whether the areas of two rings share a point: edges meet, or one holds a corner of the other."""

    def turn(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def meet(i: Column, j: Column) -> Column:
        p, q, r, s = F.get(a, i), F.get(a, i + 1), F.get(b, j), F.get(b, j + 1)
        boxes = F.lit(True)
        for axis in ("x", "y"):
            boxes = boxes & (F.greatest(p[axis], q[axis]) >= F.least(r[axis], s[axis])) & (F.greatest(r[axis], s[axis]) >= F.least(p[axis], q[axis]))
        return boxes & (turn(p, q, r) * turn(p, q, s) <= 0) & (turn(r, s, p) * turn(r, s, q) <= 0)

    edges = F.exists(_segments(a), lambda i: F.exists(_segments(b), lambda j: meet(i, j)))
    return edges | within(F.get(a, 0)["x"], F.get(a, 0)["y"], b) | within(F.get(b, 0)["x"], F.get(b, 0)["y"], a)


def hex_cell(x: Column, y: Column, size_x: float, size_y: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column, Column]:
    """Centre of the hexagonal bin and its lattice (0 or 1): the nearer of two rectangular lattices' points; of equally
    near ones, the first lattice's."""
    u, v = (x - x0) / size_x, (y - y0) / size_y
    i1, j1 = F.floor(u + 0.5), F.floor(v + 0.5)
    i2, j2 = F.floor(u), F.floor(v)
    d1 = (u - i1) * (u - i1) + 3 * (v - j1) * (v - j1)
    d2 = (u - i2 - 0.5) * (u - i2 - 0.5) + 3 * (v - j2 - 0.5) * (v - j2 - 0.5)
    first = d1 <= d2
    return F.when(first, i1 * size_x + x0).otherwise((i2 + 0.5) * size_x + x0), F.when(first, j1 * size_y + y0).otherwise((j2 + 0.5) * size_y + y0), F.when(first, 0).otherwise(1)


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile, by bisection on the regularized incomplete beta function."""
    if df < 1 or not 0 < p < 1:
        raise ValueError("df is 1 or more, and p between 0 and 1")
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    if df == 1:
        return sin(pi * (p - 0.5)) / cos(pi * (p - 0.5))
    low, high = 0.0, 1.0
    while _t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _t_cdf(t: float, df: int) -> float:
    """By the finite series for whole degrees of freedom (Abramowitz and Stegun 26.7.3 and 26.7.4)."""
    theta = atan(t / sqrt(df))
    c = cos(theta)
    if df % 2:
        total, term = 0.0, c
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * 2 * k / (2 * k + 1)
        return 0.5 + (theta + sin(theta) * total) / pi
    total, term = 0.0, 1.0
    for k in range(1, df // 2 + 1):
        total += term
        term *= c * c * (2 * k - 1) / (2 * k)
    return 0.5 + sin(theta) * total / 2
