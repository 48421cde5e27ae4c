"""Polygons with holes and parts, and shapes made of shapes. Corners are placed so that crossings fall on halves, and areas
are exact."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import overlay, winding
from ..sources.storage import parquet_table
from . import views
from .further import _shared_area
from .registry import query

#: Corners of an octagon with sides along the axes and diagonals, of the diamond in it, and of a square beside it.
OUTLINE = ((-90, -30), (-30, -90), (30, -90), (90, -30), (90, 30), (30, 90), (-30, 90), (-90, 30))
DIAMOND = ((0, -40), (-40, 0), (0, 40), (40, 0))  # clockwise
BESIDE = ((90, 85), (100, 85), (100, 95), (90, 95))
SIDE = 200.0
#: Corners for each order of the great polygon.
CORNERS = 8


def _ring(corners, x, y):
    return F.array(*(F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in (*corners, corners[0])))


def octagons(spark: SparkSession, d: str) -> DataFrame:
    """(poly, rings): for each nation an octagon with a diamond as its hole, and a square as its second part."""
    key = F.col("n_nationkey")
    x, y = 200 * (key % 5) + 100, 200 * F.floor(key / 5) + 100
    parts = F.explode(F.array(F.array(_ring(OUTLINE, x, y), _ring(DIAMOND, x, y)), F.array(_ring(BESIDE, x, y))))
    return parquet_table(spark, d, "nation").select(key.alias("poly"), parts.alias("rings"))


_sides = ", ".join(f"({a}, {b}, {c}, {e})" for ring in (OUTLINE, DIAMOND, BESIDE) for (a, b), (c, e) in zip(ring, (*ring[1:], ring[0])))
OCTAGONS = f"""edges AS (
  SELECT n_nationkey AS poly, 200 * (n_nationkey % 5) + 100.0::DOUBLE + a AS x1, 200 * (n_nationkey // 5) + 100.0::DOUBLE + b AS y1, 200 * (n_nationkey % 5) + 100.0::DOUBLE + c AS x2, 200 * (n_nationkey // 5) + 100.0::DOUBLE + e AS y2
  FROM nation CROSS JOIN (VALUES {_sides}) AS t(a, b, c, e))"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(id, nation, rings): a box for each supplier."""
    key = F.col("s_suppkey")
    x, y, w, h = key * 37 % 1000, key * 91 % 997, 40 + key * 13 % 121, 30 + key * 29 % 97
    ring = F.array(*(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))))
    return parquet_table(spark, d, "supplier").select(key.alias("id"), F.col("s_nationkey").alias("nation"), F.array(ring).alias("rings"))


BOXES = "boxes AS (SELECT s_suppkey AS id, s_nationkey AS nation, s_suppkey * 37 % 1000 AS x0, s_suppkey * 91 % 997 AS y0, 40 + s_suppkey * 13 % 121 AS w, 30 + s_suppkey * 29 % 97 AS h FROM supplier)"


def great_edges(spark: SparkSession, d: str) -> DataFrame:
    """(poly, x1, y1, x2, y2, w): one toothed wheel about the middle, with eight corners for each order."""
    orders = parquet_table(spark, d, "orders")
    n = orders.count() * CORNERS
    at = orders.select(F.explode(F.sequence(F.col("o_orderkey") * CORNERS, F.col("o_orderkey") * CORNERS + (CORNERS - 1))).alias("i"))

    def corner(i, k: int):
        r, a = 400 - 30 * (F.floor(i % n * 40 / n) % 2) + i % n * 7919 % 997 / 1000, 2 * pi * (i % n) / n
        return [(500 + r * F.cos(a)).alias(f"x{k}"), (500 + r * F.sin(a)).alias(f"y{k}")]

    i = F.col("i")
    return winding.left_to_right(at.select(F.lit(100).alias("poly"), *corner(i, 1), *corner(i + 1, 2), F.lit(1).alias("w")))


@query("q109_pip_holes_parts", f"""WITH {views.POINTS}, n AS (SELECT count(*) * {CORNERS} AS n FROM orders),
  o AS (SELECT n_nationkey AS poly, 200 * (n_nationkey % 5) + 100 AS cx, 200 * (n_nationkey // 5) + 100 AS cy FROM nation),
  g AS (SELECT *, CAST(floor((CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END) / (2 * pi()) * n) AS BIGINT) % n AS i FROM (SELECT *, atan2(y - 500, x - 500) AS t FROM points, n)),
  c AS (SELECT *, 400 - 30 * ((i * 40 // n) % 2) + i * 7919 % 997 / 1000 AS r1, 2 * pi() * i / n AS a1, 400 - 30 * ((((i + 1) % n) * 40 // n) % 2) + (i + 1) % n * 7919 % 997 / 1000 AS r2, 2 * pi() * ((i + 1) % n) / n AS a2 FROM g)
  SELECT point_id, poly FROM points JOIN o ON abs(x - cx) < 90 AND abs(y - cy) < 90 AND abs(x - cx) + abs(y - cy) < 120 AND abs(x - cx) + abs(y - cy) > 40
  UNION ALL SELECT point_id, poly FROM points JOIN o ON x > cx + 90 AND x < cx + 100 AND y > cy + 85 AND y < cy + 95
  UNION ALL SELECT point_id, 100 FROM c WHERE (r2 * cos(a2) - r1 * cos(a1)) * (y - 500 - r1 * sin(a1)) - (r2 * sin(a2) - r1 * sin(a1)) * (x - 500 - r1 * cos(a1)) > 0""")  # fmt: skip
def q109(spark, d):
    grid = winding.Grid(50.0, depth=3)
    edges = winding.edges_of(octagons(spark, d), ["poly"]).unionByName(great_edges(spark, d))
    return winding.within_edges(views.points(spark, d), edges, "poly", grid).select("point_id", "poly")


def _area(rings="rings"):
    return F.round(F.sum(geometry.polygon_area(F.col(rings))), 6).alias("area")


@query("q110_intersected_shapes", f"WITH {OCTAGONS}, {BOXES}, " + _shared_area("boxes", "edges", "id", 6))
def q110(spark, d):
    found = overlay.intersected(octagons(spark, d), boxes(spark, d), ("poly", "id"), SIDE, 0.125)
    return found.groupBy("poly", "id").agg(_area())


#: Cells between all sides of boxes, and the boxes that cover them.
_CELLS = """xs AS (SELECT {key}, x, lead(x) OVER (PARTITION BY {key} ORDER BY x) AS x2 FROM (SELECT {key}, x0 AS x FROM boxes UNION SELECT {key}, x0 + w FROM boxes)),
  ys AS (SELECT {key}, y, lead(y) OVER (PARTITION BY {key} ORDER BY y) AS y2 FROM (SELECT {key}, y0 AS y FROM boxes UNION SELECT {key}, y0 + h FROM boxes)),
  cells AS (SELECT xs.{key}, x, x2, y, y2 FROM xs JOIN ys ON xs.{key} = ys.{key} WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.{key} = xs.{key} AND b.x0 <= x AND x2 <= b.x0 + b.w AND b.y0 <= y AND y2 <= b.y0 + b.h))"""


@query("q111_dissolved_parts", f"""WITH RECURSIVE {BOXES}, {_CELLS.format(key="nation")},
  near AS (SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.nation = b.nation AND least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) >= 0 AND least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) >= 0
    AND least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) + least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) > 0),
  reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
  parts AS (SELECT nation, count(*) AS parts FROM (SELECT a, min(b) AS b FROM reach GROUP BY a) JOIN boxes ON id = a WHERE a = b GROUP BY nation)
  SELECT c.nation, parts, CAST(sum((x2 - x) * (y2 - y)) AS DOUBLE) AS area FROM cells c JOIN parts p ON c.nation = p.nation GROUP BY c.nation, parts""")  # fmt: skip
def q111(spark, d):
    return overlay.dissolved(boxes(spark, d), "id", "nation", SIDE, 0.25).groupBy("nation").agg(F.count(F.lit(1)).alias("parts"), _area())


@query("q112_differenced_shapes", f"""WITH {OCTAGONS}, {BOXES.replace("boxes AS (SELECT", "boxes AS (SELECT 0 AS one,")}, {_CELLS.format(key="one")}, {_shared_area("(SELECT x AS x0, y AS y0, x2 - x AS w, y2 - y AS h, x AS cx, y AS cy FROM cells)", "edges", "cx, cy", 6).replace("\n  SELECT poly, cx, cy, round(area, 6) AS area FROM p WHERE area > 1e-6", ",\n  q AS (SELECT poly, sum(area) AS gone FROM p GROUP BY poly)")}
  SELECT n_nationkey AS poly, round(90 * 90 * 4 - 4 * 60 * 60 / 2 - 2 * 40 * 40 + 100 - coalesce(gone, 0), 6) AS area FROM nation LEFT JOIN q ON q.poly = n_nationkey WHERE 90 * 90 * 4 - 4 * 60 * 60 / 2 - 2 * 40 * 40 + 100 - coalesce(gone, 0) > 1e-6""")  # fmt: skip
def q112(spark, d):
    return overlay.differenced(octagons(spark, d), boxes(spark, d), ("poly", "id"), SIDE, 0.125).groupBy("poly").agg(_area())


@query("q113_buffered_shapes", f"""WITH {BOXES}, r AS (SELECT unnest([30.0::DOUBLE, 1000.0::DOUBLE]) AS reach)
  SELECT id, CAST(reach AS BIGINT) AS reach, 1 AS parts, round(w * h + 2 * (w + h) * reach + 32 * reach * reach * sin(pi() / 32), 0) AS area FROM boxes, r""")
def q113(spark, d):
    both = [overlay.buffered(boxes(spark, d), "id", r, SIDE + r, 16, 1e-4).withColumn("reach", F.lit(int(r)).cast("long")) for r in (30.0, 1000.0)]
    return both[0].unionByName(both[1]).groupBy("id", "reach").agg(F.count(F.lit(1)).cast("int").alias("parts"), F.round(F.sum(geometry.polygon_area(F.col("rings"))), 0).alias("area"))


@query("q114_repaired_shapes", """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 4 AS kind, 2 * (20 + s_suppkey * 13 % 61) AS w, 2 * (15 + s_suppkey * 29 % 49) AS h FROM supplier)
  SELECT id, CASE kind WHEN 0 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS parts, CASE kind WHEN 1 THEN 1 ELSE 0 END AS holes, CAST(CASE kind WHEN 0 THEN w * h / 2 WHEN 1 THEN w * h - w * h / 8 WHEN 2 THEN w * h ELSE w * h / 2 END AS DOUBLE) AS area FROM s""")  # fmt: skip
def q114(spark, d):
    """A bow tie; a box whose outline runs into a diamond in its middle; a box with an edge there and back; two boxes that
    touch in a corner, drawn as one ring."""
    key = F.col("s_suppkey")
    x, y, w, h = key * 37 % 1000, key * 91 % 997, 2 * (20 + key * 13 % 61), 2 * (15 + key * 29 % 49)
    kinds = [
        ((0, 0), (1, 1), (1, 0), (0, 1)), ((0, 0), (1, 0), (1, 1), (0.5, 1), (0.25, 0.75), (0.5, 0.5), (0.75, 0.75), (0.5, 1), (0, 1)), ((0, 0), (1, 0), (1, 1), (0.5, 1), (0.5, 0.5), (0.5, 1), (0, 1)),
        ((0, 0), (0.5, 0), (0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1), (0.5, 0.5), (0, 0.5)),
    ]
    rings = [F.array(*(F.struct((x + a * w).cast("double").alias("x"), (y + b * h).cast("double").alias("y")) for a, b in (*k, k[0]))) for k in kinds]
    made = F.when(key % 4 == 0, rings[0]).when(key % 4 == 1, rings[1]).when(key % 4 == 2, rings[2]).otherwise(rings[3])
    found = overlay.repaired(parquet_table(spark, d, "supplier").select(key.alias("id"), F.array(made).alias("rings")), "id", SIDE, 0.125)
    return found.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("parts"), F.sum(F.size("rings") - 1).cast("int").alias("holes"), _area())
