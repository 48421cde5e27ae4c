"""Spatial joins, lines, splits, partitions, and event-time extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import objects, spatial, statistics, tiling
from ..sources.storage import parquet_table
from . import views
from .registry import query, r6

SIDE = 200.0


@query("q38_pip", f"WITH {views.PAIRS} SELECT poly, round(sum(area_ha), 4) AS area_sum, count(*) AS area_count, median(area_ha) AS area_median FROM pairs GROUP BY poly")
def q38(spark, d):
    found = spatial.within_join(views.points(spark, d), views.polys(spark, d).select("poly", "ring"), SIDE)
    return statistics.area_statistics(found, ["poly"]).select("poly", F.round("area_sum", 4).alias("area_sum"), "area_count", "area_median")


@query("q39_pip_right", f"WITH {views.PAIRS} SELECT n_nationkey AS poly, count(point_id) AS n, round(coalesce(sum(area_ha), 0), 4) AS area_sum FROM nation LEFT JOIN pairs ON poly = n_nationkey AND area_ha > 280 GROUP BY n_nationkey")
def q39(spark, d):
    found = spatial.within_join(views.points(spark, d).filter("area_ha > 280"), views.polys(spark, d).select("poly", "ring"), SIDE, "right")
    return found.groupBy("poly").agg(F.count("point_id").alias("n"), F.round(F.coalesce(F.sum("area_ha"), F.lit(0.0)), 4).alias("area_sum"))


@query("q40_semi_anti_spatial", f"""WITH {views.PAIRS} SELECT point_id, EXISTS (SELECT 1 FROM pairs p WHERE p.point_id = q.point_id AND area_ha > 20) AS found FROM points q""")
def q40(spark, d):
    some, polys = views.points(spark, d), views.polys(spark, d).select("poly", "ring")
    large = some.filter("area_ha > 20")
    semi = spatial.within_join(large, polys, SIDE, "left_semi")
    anti = spatial.within_join(large, polys, SIDE, "left_anti").unionByName(some.filter("area_ha <= 20 OR area_ha IS NULL"))
    return semi.select("point_id", F.lit(True).alias("found")).unionByName(anti.select("point_id", F.lit(False).alias("found")))


@query("q41_nearest", f"""WITH {views.POINTS}, c AS (SELECT n_nationkey AS target_id, 200.0 * (n_nationkey % 5) + 100 AS tx, 200.0 * (n_nationkey // 5) + 100 AS ty FROM nation)
  SELECT point_id, target_id, round(sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)), 6) AS apart FROM points CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY (x - tx) * (x - tx) + (y - ty) * (y - ty), target_id) = 1""")  # fmt: skip
def q41(spark, d):
    k = F.col("n_nationkey")
    centres = parquet_table(spark, d, "nation").select(k.alias("target_id"), (200.0 * (k % 5) + 100).alias("tx"), (200.0 * F.floor(k / 5) + 100).alias("ty"))
    return spatial.nearest_small(views.points(spark, d), centres).select("point_id", "target_id", r6("apart", "apart"))


@query("q42_zonal", f"""WITH {views.PAIRS} SELECT n_nationkey AS poly, max(area_ha) AS most, count(point_id) AS n_cells, round(avg(area_ha), 6) AS mean FROM nation LEFT JOIN pairs ON poly = n_nationkey GROUP BY n_nationkey""")
def q42(spark, d):
    cells = views.points(spark, d).select("point_id", ((F.col("x") - 1) / 2).alias("col"), ((F.col("y") - 1) / 2).alias("row"), F.col("area_ha").alias("value"))
    half = views.polys(spark, d, 0.5).select("poly", "ring")
    z = spatial.zonal(cells, half, SIDE / 2, "poly", F.max("value").alias("most"), F.count(F.lit(1)).alias("n_cells"), F.avg("value").alias("mean"))
    return z.select("poly", "most", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), r6("mean", "mean"))


@query("q43_fragmentation", f"""WITH {views.PAIRS}, b AS (SELECT poly, max(area_ha) AS base FROM pairs GROUP BY poly), f AS (SELECT poly, sum(area_ha) AS flow FROM pairs WHERE area_ha > 100 GROUP BY poly)
  SELECT n_nationkey AS poly, round(100 * coalesce(flow, 0) / CASE WHEN coalesce(base, 0) = 0 THEN 1 ELSE base END, 4) AS fragmentation FROM nation LEFT JOIN b ON b.poly = n_nationkey LEFT JOIN f ON f.poly = n_nationkey""")  # fmt: skip
def q43(spark, d):
    polys = views.polys(spark, d).select("poly", "ring")
    found = spatial.within_join(views.points(spark, d), polys, SIDE)
    base = polys.select("poly").join(found.groupBy("poly").agg(F.max("area_ha").alias("base")), "poly", "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    return statistics.fragmentation(base, found.filter("area_ha > 100"), "poly", "area_ha", "base").select("poly", F.round("fragmentation", 4).alias("fragmentation"))


@query("q44_hexbin", f"""WITH {views.POINTS}, h AS (SELECT x / 50.0 AS u, y / 86.0 AS v FROM points), c AS (SELECT u, v, floor(u + 0.5) AS i1, floor(v + 0.5) AS j1, floor(u) AS i2, floor(v) AS j2 FROM h),
  e AS (SELECT *, (u - i1) * (u - i1) + 3 * (v - j1) * (v - j1) <= (u - i2 - 0.5) * (u - i2 - 0.5) + 3 * (v - j2 - 0.5) * (v - j2 - 0.5) AS first FROM c)
  SELECT CASE WHEN first THEN i1 * 50.0 ELSE (i2 + 0.5) * 50.0 END AS hx, CASE WHEN first THEN j1 * 86.0 ELSE (j2 + 0.5) * 86.0 END AS hy, count(*) AS n FROM e GROUP BY ALL""")  # fmt: skip
def q44(spark, d):
    hx, hy, _ = geometry.hex_cell(F.col("x"), F.col("y"), 50.0, 86.0)
    return views.points(spark, d).groupBy(hx.alias("hx"), hy.alias("hy")).agg(F.count(F.lit(1)).alias("n"))


_CELL = "CAST(floor(x / 20) AS BIGINT) * 100 + CAST(floor(y / 20) AS BIGINT)"


@query("q45_object_union", f"""WITH {views.POINTS}, o AS (SELECT point_id AS id, area_ha AS area, {_CELL} AS cell FROM points), l AS (SELECT * FROM o WHERE id % 3 = 0), r AS (SELECT * FROM o WHERE id % 3 = 1),
  p AS (SELECT l.id, r.id AS partner, greatest(l.area, r.area) AS area, row_number() OVER (PARTITION BY l.id ORDER BY r.area DESC, r.id) AS k FROM l JOIN r USING (cell))
  SELECT id, partner, area, 'both' AS source FROM p WHERE k = 1 UNION ALL SELECT id, NULL, area, 'left' FROM l WHERE cell NOT IN (SELECT cell FROM r) UNION ALL SELECT id, NULL, area, 'right' FROM r WHERE cell NOT IN (SELECT cell FROM l)""")  # fmt: skip
def q45(spark, d):
    cell = (F.floor(F.col("x") / 20) * 100 + F.floor(F.col("y") / 20)).alias("cell")
    own = views.points(spark, d).select(F.col("point_id").alias("id"), F.col("area_ha").alias("area"), cell)
    left, right = own.filter("id % 3 = 0"), own.filter("id % 3 = 1")
    return objects.union_by_cell(left, right)


def _albers_sql() -> str:
    e2, e, n, c, rho0, _ = geometry._conic(geometry.ALBERS)
    a = geometry.ALBERS["a"]
    s = "sin(radians(lat))"
    q = f"{1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r})"
    return f"""WITH {views.POINTS}, g AS (SELECT point_id, -75 + x * 0.04 AS lon, -33 + y * 0.038 AS lat FROM points), p AS (SELECT point_id, {a!r} * sqrt({c!r} - {n!r} * ({q})) / {n!r} AS rho, {n!r} * radians(lon + 60) AS theta FROM g)
  SELECT point_id, round(rho * sin(theta), 2) AS x, round({rho0!r} - rho * cos(theta), 2) AS y FROM p"""


@query("q46_albers", _albers_sql())
def q46(spark, d):
    x, y = geometry.albers(-75 + F.col("x") * 0.04, -33 + F.col("y") * 0.038)
    return views.points(spark, d).select("point_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("q47_line_cross", f"""WITH {views.SEGMENTS}, p AS (SELECT a.id AS a_id, b.id AS b_id, a.x1, a.y1, a.x2 - a.x1 AS ax, a.y2 - a.y1 AS ay, b.x2 - b.x1 AS bx, b.y2 - b.y1 AS by_, b.x1 - a.x1 AS sx, b.y1 - a.y1 AS sy FROM segments a JOIN segments b ON a.id % 2 = 0 AND b.id % 2 = 1),
  t AS (SELECT *, (sx * by_ - sy * bx) / (ax * by_ - ay * bx) AS t, (sx * ay - sy * ax) / (ax * by_ - ay * bx) AS u FROM p WHERE ax * by_ - ay * bx <> 0)
  SELECT a_id, b_id, round(x1 + t * ax, 6) AS x, round(y1 + t * ay, 6) AS y FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""")  # fmt: skip
def q47(spark, d):
    s = views.segments(spark, d)
    return spatial.intersections(s.filter("id % 2 = 0"), s.filter("id % 2 = 1"), 64.0).select("a_id", "b_id", r6("x", "x"), r6("y", "y"))


@query("q48_line_length", f"""WITH {views.SEGMENTS}, b AS (SELECT n_nationkey AS box_id, 200 * (n_nationkey % 5) + 10 AS xa, 200 * (n_nationkey % 5) + 190 AS xb, 200 * (n_nationkey // 5) + 10 AS ya, 200 * (n_nationkey // 5) + 190 AS yb FROM nation),
  p AS (SELECT box_id, id, x2 - x1 AS dx, y2 - y1 AS dy, xa - x1 AS l1, xb - x1 AS h1, ya - y1 AS l2, yb - y1 AS h2 FROM segments CROSS JOIN b),
  c AS (SELECT box_id, id, dx, dy, CASE WHEN (dx = 0 AND (l1 > 0 OR h1 < 0)) OR (dy = 0 AND (l2 > 0 OR h2 < 0)) THEN 2.0 ELSE greatest(0.0, CASE WHEN dx <> 0 THEN least(l1 / dx, h1 / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least(l2 / dy, h2 / dy) ELSE 0 END) END AS a,
    least(1.0, CASE WHEN dx <> 0 THEN greatest(l1 / dx, h1 / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest(l2 / dy, h2 / dy) ELSE 1 END) AS z FROM p),
  s AS (SELECT box_id, sum((z - a) * sqrt(dx * dx + dy * dy)) AS length, count(*) AS parts FROM c WHERE z > a AND (dx <> 0 OR dy <> 0) GROUP BY box_id)
  SELECT b.box_id, round(coalesce(length, 0), 4) AS length, coalesce(parts, 0) AS parts FROM b LEFT JOIN s USING (box_id)""")  # fmt: skip
def q48(spark, d):
    k = F.col("n_nationkey")
    boxes = parquet_table(spark, d, "nation").select(k.alias("box_id"), *((200.0 * side + off).alias(n) for n, side, off in (("x_min", k % 5, 10), ("x_max", k % 5, 190), ("y_min", F.floor(k / 5), 10), ("y_max", F.floor(k / 5), 190))))
    sums = spatial.clipped_length(views.segments(spark, d), boxes, 100.0).groupBy("box_id").agg(F.sum("inside").alias("length"), F.count(F.lit(1)).alias("parts"))
    return boxes.select("box_id").join(sums, "box_id", "left").select("box_id", F.round(F.coalesce("length", F.lit(0.0)), 4).alias("length"), F.coalesce("parts", F.lit(0)).alias("parts"))


@query("q49_split", """WITH h AS (SELECT p_partkey, p_size > 25 AS s, md5('7' || p_partkey) AS h FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY s) AS n, row_number() OVER (PARTITION BY s ORDER BY h, p_partkey) AS k FROM h)
  SELECT p_partkey, CASE WHEN k <= round(n * 0.7) THEN 'train' WHEN k <= round(n * 0.7) + round(n * 0.2) THEN 'test' ELSE 'val' END AS part FROM r""")  # fmt: skip
def q49(spark, d):
    return tiling.split(parquet_table(spark, d, "part"), "p_partkey", 0.2, 0.1, "7", F.col("p_size") > 25).select("p_partkey", "part")


@query("q50_hier_partition", """WITH o AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b, p_retailprice AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
  r AS (SELECT corr(y, a) AS ya, corr(y, b) AS yb, corr(y, c) AS yc, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM o),
  f AS (SELECT unnest(range(0, 8)) AS subset, unnest([0, ya ** 2, yb ** 2, (ya ** 2 + yb ** 2 - 2 * ya * yb * ab) / (1 - ab ** 2), yc ** 2, (ya ** 2 + yc ** 2 - 2 * ya * yc * ac) / (1 - ac ** 2), (yb ** 2 + yc ** 2 - 2 * yb * yc * bc) / (1 - bc ** 2),
    (ya ** 2 * (1 - bc ** 2) + yb ** 2 * (1 - ac ** 2) + yc ** 2 * (1 - ab ** 2) - 2 * ya * yb * (ab - ac * bc) - 2 * ya * yc * (ac - ab * bc) - 2 * yb * yc * (bc - ab * ac)) / (1 + 2 * ab * ac * bc - ab ** 2 - ac ** 2 - bc ** 2)]) AS r2 FROM r),
  t AS (SELECT unnest(range(0, 3)) AS term),
  g AS (SELECT term, bit_count(a.subset) AS size, avg(b.r2 - a.r2) AS gain FROM t JOIN f a ON (a.subset & (1 << term)) = 0 JOIN f b ON b.subset = (a.subset | (1 << term)) GROUP BY ALL)
  SELECT CAST(term AS INTEGER) AS term, round(max(gain) FILTER (WHERE size = 2), 6) + 0.0 AS "unique", round(avg(gain) - max(gain) FILTER (WHERE size = 2), 6) + 0.0 AS average, round(avg(gain), 6) + 0.0 AS total FROM g GROUP BY term""")  # fmt: skip
def q50(spark, d):
    sold = parquet_table(spark, d, "lineitem").join(parquet_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = statistics.hierarchical_partition(statistics.subset_fits(sold, "l_extendedprice", ["l_quantity", "l_discount", "p_retailprice"]), 3)
    return p.select("term", r6("unique", "unique"), r6("average", "average"), r6("total", "total"))


@query("q60_near_polys", f"""WITH {views.PAIRS}, g AS (SELECT point_id, poly, min(CASE WHEN t < 0 THEN sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)) WHEN t > 1 THEN sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) ELSE abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) END) AS apart
    FROM (SELECT *, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS t FROM points CROSS JOIN edges) GROUP BY point_id, poly)
  SELECT g.poly, count(*) AS within_reach, count(*) FILTER (WHERE q.point_id IS NULL) AS in_ring FROM g LEFT JOIN pairs q USING (point_id, poly) WHERE q.point_id IS NOT NULL OR apart <= 12.3 GROUP BY g.poly""")  # fmt: skip
def q60(spark, d):
    near = spatial.near_join(views.points(spark, d), views.polys(spark, d).select("poly", "ring"), SIDE, 12.3)
    return near.groupBy("poly").agg(F.count(F.lit(1)).alias("within_reach"), F.count_if(F.col("apart") > 0).alias("in_ring"))


@query("q61_zonal_classes", f"""WITH {views.PAIRS}, c AS (SELECT poly, CAST(floor(area_ha / 50) AS BIGINT) AS value, count(*) AS n FROM pairs GROUP BY ALL) SELECT poly, value, n, round(n / sum(n) OVER (PARTITION BY poly), 6) AS share FROM c""")
def q61(spark, d):
    cells = views.points(spark, d).select(((F.col("x") - 1) / 2).alias("col"), ((F.col("y") - 1) / 2).alias("row"), F.floor(F.col("area_ha") / 50).alias("value"))
    return spatial.zonal_classes(cells, views.polys(spark, d, 0.5).select("poly", "ring"), SIDE / 2, "poly").select("poly", "value", "n", r6("share", "share"))


@query("q62_nearest_many", f"""WITH {views.POINTS}, a AS (SELECT * FROM points), b AS (SELECT c_custkey AS target_id, CAST(c_custkey * 37 % 5000 AS DOUBLE) AS tx, CAST(c_custkey * 91 % 997 AS DOUBLE) AS ty FROM customer)
  SELECT point_id, target_id, round(sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)), 6) AS apart FROM a CROSS JOIN b QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY (x - tx) * (x - tx) + (y - ty) * (y - ty), target_id) = 1""")  # fmt: skip
def q62(spark, d):
    p = views.points(spark, d)
    k = F.col("c_custkey")
    targets = parquet_table(spark, d, "customer").select(k.alias("target_id"), (k * 37 % 5000).cast("double").alias("tx"), (k * 91 % 997).cast("double").alias("ty"))
    found = spatial.nearest(p, targets, 30.0)
    return found.select("point_id", "target_id", r6("apart", "apart"))


@query("q63_polygon_measures", f"""WITH {views.POLYS} SELECT poly, sum(x1 * y2 - x2 * y1) / 2.0 AS area, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) AS length, CAST(min(x1) AS DOUBLE) AS x_min, CAST(max(y1) AS DOUBLE) AS y_max, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3.0 * sum(x1 * y2 - x2 * y1)), 6) AS cx, TRUE AS valid FROM edges GROUP BY poly""")
def q63(spark, d):
    ring = F.col("ring")
    b = geometry.bounds(ring)
    return views.polys(spark, d).select("poly", geometry.ring_area(ring).alias("area"), r6(geometry.line_length(ring), "length"), b["x_min"].alias("x_min"), b["y_max"].alias("y_max"), r6(geometry.ring_centroid(ring)[0], "cx"), geometry.ring_valid(ring).alias("valid"))


@query("ext_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_window(spark, d):
    w = F.window("ts", "1 day").alias("w")
    return parquet_table(spark, d, "events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("ext_session", """WITH g AS (SELECT user_id, ts, coalesce(CAST(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE AS INTEGER), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def ext_session(spark, d):
    s = F.session_window("ts", "30 minutes").alias("s")
    return parquet_table(spark, d, "events").groupBy("user_id", s).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")
