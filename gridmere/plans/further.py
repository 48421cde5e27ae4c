"""Left joins, ungrouped sums, slices, band stacks, windows by bounds, and other small forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import raster, reshape, series, spatial, statistics, tiling
from ..sources.storage import parquet_table
from . import views
from .registry import query, r6

SIDE = 200.0


@query("q90_pip_left", f"WITH {views.PAIRS} SELECT q.point_id, p.poly FROM points q LEFT JOIN pairs p ON p.point_id = q.point_id")
def q90(spark, d):
    return spatial.within_join(views.points(spark, d), views.polys(spark, d).select("poly", "ring"), SIDE, "left").select("point_id", "poly")


@query("q91_second_bounds", f"WITH {views.OBJECTS} SELECT round(sum(area_ha), 4) AS area_sum, count(*) AS area_count, median(area_ha) AS area_median, round(avg(area_ha), 6) AS area_mean FROM objects WHERE hp_max < 100 AND area_ha < 100")
def q91(spark, d):
    kept = views.objects(spark, d).filter("hp_max < 100 AND area_ha < 100")
    return statistics.area_statistics(kept, [], mean=True).select(F.round("area_sum", 4).alias("area_sum"), "area_count", "area_median", r6("area_mean", "area_mean"))


@query("q92_first_known", """WITH e AS (SELECT user_id, event_id, CASE WHEN value > 50 THEN value END AS high, CASE WHEN event_type = 'click' THEN event_type END AS kind FROM events)
  SELECT user_id, arg_min(high, event_id) FILTER (WHERE high IS NOT NULL) AS high, arg_min(kind, event_id) FILTER (WHERE kind IS NOT NULL) AS kind FROM e GROUP BY user_id""")  # fmt: skip
def q92(spark, d):
    high, kind = F.when(F.col("value") > 50, F.col("value")), F.when(F.col("event_type") == "click", F.col("event_type"))
    own = parquet_table(spark, d, "events").select("user_id", "event_id", high.alias("high"), kind.alias("kind"))
    return statistics.first_known(own, ["user_id"], "event_id", ["high", "kind"])


@query("q93_averaged_metrics", f"""WITH {views.PREDICTIONS}, c AS (SELECT user_id, count(*) FILTER (WHERE pred AND truth) AS tp, count(*) FILTER (WHERE pred AND NOT truth) AS fp, count(*) FILTER (WHERE NOT pred AND truth) AS fn FROM predictions GROUP BY user_id)
  SELECT round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(tp) + sum(fp) + sum(fn), 0), 6) AS micro_iou, round(avg(tp / nullif(tp + fp, 0)), 6) AS image_precision, round(avg(tp / nullif(tp + fp + fn, 0)), 6) AS image_iou FROM c""")  # fmt: skip
def q93(spark, d):
    counts = statistics.confusion(views.predictions(spark, d), ["user_id"], F.col("pred"), F.col("truth"))
    both = statistics.averaged_metrics(counts, ["precision", "iou"])
    return both.select(*(r6(c, c) for c in both.columns))


@query("q94_replace_kept", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'first' WHEN '5-LOW' THEN 'last' ELSE o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY ALL")
def q94(spark, d):
    name = scalars.replaced(F.col("o_orderpriority"), {"1-URGENT": "first", "5-LOW": "last"})
    return parquet_table(spark, d, "orders").groupBy(name.alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("q95_slices", """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)
  SELECT o_custkey, o_orderkey FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 3""")  # fmt: skip
def q95(spark, d):
    kept = series.without_multiples(parquet_table(spark, d, "orders"), "o_orderkey", 5)
    return series.first_rows(kept, ["o_totalprice", "o_orderkey"], 3, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("q96_band_stack", f"WITH {views.GRID} SELECT row, col, CAST(value AS DOUBLE) AS b0, CAST(row AS DOUBLE) AS b1, CAST(2 * value + 1 AS DOUBLE) AS b2 FROM grid WHERE col % 3 <> 0 AND value > 0")
def q96(spark, d):
    g = views.grid(spark, d)
    red, green, blue = g, g.filter("col % 3 <> 0").withColumn("value", 2 * F.col("value") + 1), g.filter("value > 0").withColumn("value", F.col("row"))
    bands = raster.picked_bands(raster.stacked_bands({"red": red, "green": green, "blue": blue}), ["red"], ["blue", "green"])
    return bands.select("row", "col", *(F.get("bands", i).alias(f"b{i}") for i in range(3)))


@query("q97_window_by_bounds", f"WITH {views.GRID} SELECT row, col, value FROM grid WHERE row BETWEEN 9 AND 38 AND col BETWEEN 3 AND 22")
def q97(spark, d):
    # bounds of 20 x 10 cells from row 14 and column 8 on, padded to 30 x 20 about their centre
    return raster.window_of(views.grid(spark, d), 180.0, 660.0, 280.0, 860.0, 100.0, 1000.0, 10.0, (30, 20)).select("row", "col", "value")


@query("q98_column_sums", "SELECT sum(c_custkey) AS c_custkey, sum(c_nationkey) AS c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal FROM customer")
def q98(spark, d):
    return statistics.column_sums(parquet_table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name")).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("q99_transposed", f"""WITH {views.OBJECTS}, s AS (SELECT satellite, count(*) AS n, max(hp_max) AS hp FROM objects GROUP BY satellite)
  SELECT name, CAST(max(v) FILTER (WHERE satellite = 'A') AS BIGINT) AS "A", CAST(max(v) FILTER (WHERE satellite = 'N') AS BIGINT) AS "N", CAST(max(v) FILTER (WHERE satellite = 'R') AS BIGINT) AS "R"
  FROM (SELECT satellite, 'n' AS name, n AS v FROM s UNION ALL SELECT satellite, 'hp', hp FROM s) GROUP BY name""")  # fmt: skip
def q99(spark, d):
    sums = views.objects(spark, d).groupBy("satellite").agg(F.count(F.lit(1)).alias("n"), F.max("hp_max").cast("long").alias("hp"))
    return reshape.transposed(sums, "satellite", ["n", "hp"], ["A", "N", "R"])


@query("q100_renamed_picked", "SELECT s_suppkey, s_nationkey AS nation_19, s_acctbal AS s_acctbal_19 FROM supplier")
def q100(spark, d):
    named = reshape.renamed(parquet_table(spark, d, "supplier"), {"s_nationkey": "nation"}, suffix="_19", keep=["s_suppkey"])
    return reshape.picked(named, containing="nation", starting="s_acct", keep=["s_suppkey"])


@query("q101_class_fractions", f"""WITH {views.PREDICTIONS}, s AS (SELECT user_id, avg(CAST(k % 4 = 0 AS INTEGER)) AS forest, avg(CAST(k % 4 = 1 AS INTEGER)) AS savanna, avg(CAST(k % 4 = 2 AS INTEGER)) AS water FROM predictions WHERE k IS NOT NULL GROUP BY user_id)
  SELECT user_id, round(forest + savanna, 6) AS natural, round(1 - forest - savanna - water, 6) + 0.0 AS other, round((forest + savanna) / nullif(1 - water, 0), 6) AS natural_dry FROM s""")  # fmt: skip
def q101(spark, d):
    part = {n: F.avg((F.col("k") % 4 == i).cast("int")).alias(n) for i, n in enumerate(("forest", "savanna", "water"))}
    s = views.predictions(spark, d).filter("k IS NOT NULL").groupBy("user_id").agg(*part.values())
    f = scalars.class_fractions({n: F.col(n) for n in part}, ["forest", "savanna"], ["water"])
    return s.select("user_id", *(r6(f[n], n) for n in ("natural", "other", "natural_dry")))


@query("q102_drawn_tiles", f"""WITH {views.GRID}, t AS (SELECT CAST(row // 10 AS BIGINT) AS tile_row, CAST(col // 4 AS BIGINT) AS tile_col, count(*) AS n FROM grid GROUP BY ALL HAVING bool_and(value <> 0) AND count(*) = 40) SELECT count(*) AS drawn, count(*) AS fit FROM t""")
def q102(spark, d):
    full = tiling.full_tiles(views.grid(spark, d), 10, 4)
    drawn = tiling.drawn_tiles(full, 1_000_000, 7)  # more than there are: all that are full
    return full.agg(F.count(F.lit(1)).alias("fit")).crossJoin(drawn.agg(F.count(F.lit(1)).alias("drawn"))).select("drawn", "fit")


def _shared_area(boxes: str, edges: str, key: str, digits: int) -> str:
    """SQL for the area of polygons inside boxes (x0, y0, w, h): the integral under each edge, between the box's sides."""
    below = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} >= h THEN h * {0} - h * h / 2 ELSE {0} * {0} / 2 END"
    return f"""s AS (SELECT poly, {key}, y0, h, x1, y1, x2, y2, greatest(x0, least(x0 + w, x1)) AS a, greatest(x0, least(x0 + w, x2)) AS b FROM {edges} CROSS JOIN {boxes} WHERE x1 <> x2),
  t AS (SELECT poly, {key}, h, b - a AS w, y1 + (y2 - y1) * (a - x1) / (x2 - x1) - y0 AS u, y1 + (y2 - y1) * (b - x1) / (x2 - x1) - y0 AS v FROM s WHERE a <> b),
  p AS (SELECT poly, {key}, abs(sum(w * CASE WHEN abs(v - u) < 1e-12 THEN greatest(0, least(h, u)) ELSE ({below.format("v")} - {below.format("u")}) / (v - u) END)) AS area FROM t GROUP BY poly, {key})
  SELECT poly, {key}, round(area, {digits}) AS area FROM p WHERE area > 1e-6"""


@query("q103_fractions", f"WITH {views.POLYS}, small AS (SELECT poly, x1 / 17.3 AS x1, y1 / 17.3 AS y1, x2 / 17.3 AS x2, y2 / 17.3 AS y2 FROM edges), boxes AS (SELECT i // 60 AS row, i % 60 AS col, i % 60 AS x0, i // 60 AS y0, 1.0::DOUBLE AS w, 1.0::DOUBLE AS h FROM range(3600) r(i)), " + _shared_area("boxes", "small", "row, col", 5))
def q103(spark, d):
    i = F.col("id")
    cells = spark.range(3600).select(F.floor(i / 60).alias("row"), (i % 60).alias("col"))
    found = spatial.fractions(cells, views.polys(spark, d, 1 / 17.3), "poly")
    return found.filter("share > 1e-6").select("poly", "row", "col", F.round("share", 5).alias("area"))


@query("q104_clipped_polygons", f"WITH {views.POLYS}, {views.SEGMENTS}, boxes AS (SELECT id, x1 AS x0, y1 AS y0, 70.0::DOUBLE AS w, 50.0::DOUBLE AS h FROM segments), " + _shared_area("boxes", "edges", "id", 4))
def q104(spark, d):
    boxes = views.segments(spark, d).select("id", F.col("x1").alias("x_min"), F.col("y1").alias("y_min"), (F.col("x1") + 70).alias("x_max"), (F.col("y1") + 50).alias("y_max"))
    cut = spatial.clipped(views.polys(spark, d), boxes, SIDE)
    return cut.select("poly", "id", F.abs(geometry.ring_area(F.col("ring"))).alias("area")).filter("area > 1e-6").withColumn("area", F.round("area", 4))


_TURN = "sign(({1}.x - {0}.x) * ({2}.y - {0}.y) - ({1}.y - {0}.y) * ({2}.x - {0}.x))"
_IN = "(e.y1 > c.y) <> (e.y2 > c.y) AND c.x < (e.x2 - e.x1) * (c.y - e.y1) / (e.y2 - e.y1) + e.x1"


@query("q105_overlapping_polygons", f"""WITH {views.POLYS}, {views.SEGMENTS},
  sides AS (SELECT id, unnest([x1, x2, x1 + 31]) AS x1, unnest([y1, y2, y1 + 17]) AS y1, unnest([x2, x1 + 31, x1]) AS x2, unnest([y2, y1 + 17, y1]) AS y2 FROM segments),
  m AS (SELECT id, poly, {{'x': s.x1, 'y': s.y1}} AS p, {{'x': s.x2, 'y': s.y2}} AS q, {{'x': e.x1::DOUBLE, 'y': e.y1::DOUBLE}} AS r, {{'x': e.x2::DOUBLE, 'y': e.y2::DOUBLE}} AS z FROM sides s CROSS JOIN edges e
    WHERE greatest(s.x1, s.x2) >= least(e.x1, e.x2) AND greatest(e.x1, e.x2) >= least(s.x1, s.x2) AND greatest(s.y1, s.y2) >= least(e.y1, e.y2) AND greatest(e.y1, e.y2) >= least(s.y1, s.y2))
  SELECT id, poly FROM m WHERE {_TURN.format("p", "q", "r")} * {_TURN.format("p", "q", "z")} <= 0 AND {_TURN.format("r", "z", "p")} * {_TURN.format("r", "z", "q")} <= 0
  UNION SELECT c.id, e.poly FROM (SELECT id, x1 AS x, y1 AS y FROM segments) c JOIN edges e ON {_IN} GROUP BY c.id, e.poly HAVING count(*) % 2 = 1
  UNION SELECT e.id, c.poly FROM (SELECT poly, min_by(x1, y1) AS x, min(y1) AS y FROM edges GROUP BY poly) c JOIN sides e ON {_IN} GROUP BY e.id, c.poly HAVING count(*) % 2 = 1""")  # fmt: skip
def q105(spark, d):
    x, y = F.col("x1"), F.col("y1")
    corners = ((x, y), (F.col("x2"), F.col("y2")), (x + 31, y + 17), (x, y))
    triangles = views.segments(spark, d).select("id", F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in corners)).alias("other_ring"))
    return spatial.overlapping(views.polys(spark, d), triangles, SIDE).select("id", "poly")


#: Points spread wider than the polygons, with no symmetry that makes two of them equally near.
_WIDE = "wide AS (SELECT point_id, x * 3.0137 - 700.31 AS x, y * 2.9871 - 600.17 AS y FROM points)"
_APART = """d AS (SELECT point_id, poly, min(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2)) AS apart, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS inside
    FROM (SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM wide CROSS JOIN edges) GROUP BY ALL)"""


def _wide(spark, d):
    return views.points(spark, d).select("point_id", (F.col("x") * 3.0137 - 700.31).alias("x"), (F.col("y") * 2.9871 - 600.17).alias("y"))


@query("q106_buffer_ring", f"WITH {views.POINTS}, {views.POLYS}, {_WIDE}, {_APART} SELECT point_id, poly, round(apart, 6) AS apart FROM d WHERE NOT inside AND apart <= 41.7")
def q106(spark, d):
    return spatial.around_join(_wide(spark, d), views.polys(spark, d), SIDE, 41.7).select("point_id", "poly", r6("apart", "apart"))


@query("q107_nearest_polygon", f"""WITH {views.POINTS}, {views.POLYS}, {_WIDE}, {_APART}, f AS (SELECT point_id, poly, CASE WHEN inside THEN 0 ELSE apart END AS apart FROM d)
  SELECT point_id, arg_min(poly, apart) AS poly, round(min(apart), 6) AS apart FROM f GROUP BY point_id""")  # fmt: skip
def q107(spark, d):
    return spatial.nearest_polygon(_wide(spark, d), views.polys(spark, d), 50.0).select("point_id", "poly", r6("apart", "apart"))


@query("q108_area_units", "SELECT l_orderkey, l_linenumber, l_quantity * 100 AS square_metres, l_quantity / 10000 AS square_km FROM lineitem")
def q108(spark, d):
    pixels = F.col("l_quantity").cast("double")
    return parquet_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.square_metres(pixels).alias("square_metres"), scalars.square_km(pixels).alias("square_km"))
