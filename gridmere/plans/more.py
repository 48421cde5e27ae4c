"""Further operators on the driver's tables: top sums, keys and codes, cleaning, rasterizing, warping and joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import objects, raster, reshape, series, spatial, statistics, tiling
from ..sources.storage import parquet_table
from . import views
from .registry import query, r6


@query("q64_top_sums", """WITH r AS (SELECT c_nationkey AS nation, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS b FROM customer)
  SELECT nation, round(sum(v) FILTER (WHERE k <= 3), 4) AS top3, round(sum(v) FILTER (WHERE b <= 3), 4) AS last3 FROM r GROUP BY nation""")  # fmt: skip
def q64(spark, d):
    own = parquet_table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation")
    top = statistics.top_sums(own, ["nation"], [F.desc("c_acctbal"), F.col("c_custkey")], "c_acctbal", 3, "top3")
    last = statistics.top_sums(own, ["nation"], [F.col("c_acctbal"), F.col("c_custkey")], "c_acctbal", 3, "last3")
    return reshape.joined(top, last, ["nation"]).select("nation", F.round("top3", 4).alias("top3"), F.round("last3", 4).alias("last3"))


@query("q65_weighted_annual", """WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderstatus AS s, sum(o_totalprice) AS v FROM orders GROUP BY ALL), a AS (SELECT s, y, sum(v) AS v FROM m GROUP BY ALL)
  SELECT s AS status, round(avg(v), 2) AS mean_year, count(*) AS years, round((SELECT sum(o_totalprice * o_custkey) FROM orders WHERE o_orderstatus = s) / 1e12, 6) AS weighted FROM a GROUP BY s""")  # fmt: skip
def q65(spark, d):
    orders = parquet_table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status")
    monthly = orders.groupBy("status", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    annual = monthly.groupBy("status", F.year("month").alias("y")).agg(F.sum("v").alias("v")).groupBy("status").agg(F.round(F.avg("v"), 2).alias("mean_year"), F.count(F.lit(1)).alias("years"))
    weighted = statistics.weighted_totals(orders, "o_custkey", ["o_totalprice"], ["status"]).select("status", r6("o_totalprice", "weighted"))
    return reshape.joined(annual, weighted, ["status"])


@query("q66_distinct_share", "SELECT (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_acctbal > 9900) / (SELECT count(*) FROM nation) AS share")
def q66(spark, d):
    rich = parquet_table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return statistics.distinct_share(parquet_table(spark, d, "nation"), rich, "n_nationkey")


@query("q67_numbering", """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders)
  SELECT o_orderkey, id FROM n WHERE back > 4""")  # fmt: skip
def q67(spark, d):
    orders = parquet_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    ids = series.numbered(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")
    return ids.join(series.without_last(orders, ["o_orderdate", "o_orderkey"], 4).select("o_orderkey"), "o_orderkey", "left_semi")


@query("q68_prefix_hierarchy", "SELECT substr(CAST(1000000 + l_orderkey AS VARCHAR), 1, 4) AS prefix, max(l_linenumber) AS most, count(*) AS n FROM lineitem GROUP BY 1")
def q68(spark, d):
    code = (1_000_000 + F.col("l_orderkey")).cast("string")
    return parquet_table(spark, d, "lineitem").groupBy(F.substring(code, 1, 4).alias("prefix")).agg(F.max("l_linenumber").alias("most"), F.count(F.lit(1)).alias("n"))


@query("q69_rasterized_mean", f"""WITH {views.POLYS}, c AS (SELECT r.i AS row, c.i AS col FROM (SELECT unnest(range(0, 100)) AS i) r CROSS JOIN (SELECT unnest(range(0, 100)) AS i) c),
  h AS (SELECT row, col, poly FROM c JOIN edges ON (y1 > row * 10 + 5.25) <> (y2 > row * 10 + 5.25) AND col * 10 + 5.25 < (x2 - x1) * (row * 10 + 5.25 - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
  SELECT poly, count(*) AS n_cells, avg(row * 7 % 13 + col) AS mean FROM h GROUP BY poly""")  # fmt: skip
def q69(spark, d):
    cells = spatial.rasterized(views.polys(spark, d).select("poly", "ring"), "poly", 0.25, 0.25, 10.0)
    return cells.groupBy("poly").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(F.col("row") * 7 % 13 + F.col("col")).alias("mean"))


@query("q70_warp", f"WITH {views.GRID}, t AS (SELECT a.i AS ty, b.i AS tx FROM (SELECT unnest(range(0, 80)) AS i) a CROSS JOIN (SELECT unnest(range(0, 40)) AS i) b) SELECT ty, tx, CAST(value AS BIGINT) AS value FROM t LEFT JOIN grid ON row = CAST(floor(ty * 1.3 + 0.2 + 0.5) AS BIGINT) AND col = CAST(floor(tx * 0.9 - 0.3 + 0.5) AS BIGINT)")
def q70(spark, d):
    target = spark.range(80).select(F.col("id").alias("ty")).crossJoin(spark.range(40).select(F.col("id").alias("tx")))
    return spatial.warped(views.grid(spark, d), target, (F.col("tx") * 0.9 - 0.3, F.col("ty") * 1.3 + 0.2), 0.0, 0.0, 1.0, 1.0)


@query("q71_coverage", f"""WITH {views.POLYS}, c AS (SELECT r.i AS row, c.i AS col, k.i AS k FROM (SELECT unnest(range(0, 12)) AS i) r CROSS JOIN (SELECT unnest(range(0, 12)) AS i) c CROSS JOIN (SELECT unnest(range(0, 16)) AS i) k),
  s AS (SELECT row, col, k, poly FROM (SELECT row, col, k, (col + (k % 4 + 0.5) / 4) * 17.3 AS x, (row + (k // 4 + 0.5) / 4) * 17.3 AS y FROM c) JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
  SELECT poly, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, count(*) / 16.0 AS share FROM s GROUP BY ALL""")  # fmt: skip
def q71(spark, d):
    cells = spark.range(144).select(F.floor(F.col("id") / 12).alias("row"), (F.col("id") % 12).alias("col"))
    return spatial.coverage(cells, views.polys(spark, d, 1 / 17.3).select("poly", "ring"), 200 / 17.3, "poly")


@query("q72_split_prefixed", f"""WITH {views.OBJECTS}, o AS (SELECT year, area_ha, hp_max < 50 AS hit FROM objects), w AS (SELECT year, sum(area_ha) FILTER (WHERE hit) AS a, count(*) FILTER (WHERE hit) AS b, sum(area_ha) FILTER (WHERE NOT hit) AS c, count(*) FILTER (WHERE NOT hit) AS e FROM o GROUP BY year)
  SELECT year, 'overlap' AS side, a AS total_area, b AS count FROM w UNION ALL SELECT year, 'no_overlap', c, e FROM w""")  # fmt: skip
def q72(spark, d):
    split = statistics.overlap_split(views.objects(spark, d), ["year"], F.col("hp_max") < 50, "area_ha")
    return reshape.split_prefixed(split, ["year"], ["overlap_", "no_overlap_"], ["total_area", "count"])


@query("q73_land_classes", """WITH c AS (SELECT user_id, 50 * count(*) FILTER (WHERE event_type = 'click') AS ag, 50 * count(*) FILTER (WHERE event_type = 'error') AS nat, count(*) FILTER (WHERE event_type = 'click') AS crop, count(*) FILTER (WHERE event_type = 'view') AS pasture, count(*) FILTER (WHERE event_type = 'signup') AS forest, count(*) AS n FROM events GROUP BY user_id)
  SELECT user_id, CASE WHEN ag < 1000 AND nat > 1000 THEN 'natural' WHEN ag > 1000 THEN 'ag' ELSE 'other' END AS land,
    CASE WHEN (crop / n + pasture / n) > 0.45 THEN CASE WHEN crop >= pasture THEN 'crop' ELSE 'pasture' END WHEN crop >= pasture AND crop >= forest THEN 'crop' WHEN pasture >= forest THEN 'pasture' ELSE 'forest' END AS property FROM c""")  # fmt: skip
def q73(spark, d):
    n = {k: F.count_if(F.col("event_type") == t) for k, t in (("crop", "click"), ("pasture", "view"), ("forest", "signup"), ("nat", "error"))}
    c = parquet_table(spark, d, "events").groupBy("user_id").agg(*(v.alias(k) for k, v in n.items()), F.count(F.lit(1)).alias("n"))
    shares = {k: F.col(k) / F.col("n") for k in ("crop", "pasture", "forest")}
    return c.select("user_id", scalars.land_class(50 * F.col("crop"), 50 * F.col("nat")).alias("land"), scalars.property_class(shares, least=0.45).alias("property"))


@query("q74_text_cleaning", """SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS name, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS size, CAST(1000 * p_size AS DOUBLE) AS thousands,
  least(CAST(floor(p_retailprice / 5) AS BIGINT), 254) AS capped, p_size * 100 / 10000.0 AS ha FROM part""")  # fmt: skip
def q74(spark, d):
    size = F.col("p_size")
    text = F.when(size % 5 == 0, "-").when(size % 7 == 0, "...").otherwise(size.cast("string"))
    cleaned = F.when(text == "-", scalars.clean_number(text)).otherwise(scalars.clean_number(text, default=0.0))
    grouped = F.concat(size.cast("string"), F.lit(",000"))
    return parquet_table(spark, d, "part").select("p_partkey", scalars.capitalized(F.col("p_name")).alias("name"), cleaned.alias("size"), scalars.number_with_separators(grouped).alias("thousands"), scalars.capped(F.col("p_retailprice") / 5).alias("capped"), scalars.hectares(size).alias("ha"))


@query("q75_byte_scaling", f"WITH {views.GRID}, b AS (SELECT min(value) AS low, max(value) AS high FROM grid WHERE value <> 0) SELECT row, col, CAST(CASE WHEN value = 0 THEN 0 ELSE round_even(255 * (value - low) / (high - low), 0) END AS INTEGER) AS byte FROM grid CROSS JOIN b")
def q75(spark, d):
    g = views.grid(spark, d)
    span = g.filter("value <> 0").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return g.crossJoin(F.broadcast(span)).select("row", "col", scalars.byte_scaled(F.col("value"), F.col("low"), F.col("high")).alias("byte"))


@query("q76_cleaned_masks", f"""WITH {views.GRID}, m AS (SELECT row // 3 AS image, row, col, CASE WHEN value > 6 THEN value ELSE 0 END AS value FROM grid)
  SELECT image, CAST(sum(CASE WHEN n = 1 THEN 0 ELSE b END) AS BIGINT) AS n_set FROM (SELECT image, CAST(value > 0 AS INTEGER) AS b, sum(CAST(value > 0 AS INTEGER)) OVER (PARTITION BY image) AS n FROM m) GROUP BY image""")  # fmt: skip
def q76(spark, d):
    g = views.grid(spark, d).select(F.floor(F.col("row") / 3).alias("image"), "row", "col", F.when(F.col("value") > 6, F.col("value")).otherwise(0).alias("value"))
    return raster.cleaned_masks(g).groupBy("image").agg(F.sum("value").alias("n_set"))


@query("q77_dissolved", """WITH RECURSIVE b AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 997 AS DOUBLE) AS y FROM supplier), e AS (SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON abs(p.x - q.x) <= 40 AND abs(p.y - q.y) <= 40),
  r(a, b) AS (SELECT id, id FROM b UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS "group" FROM r GROUP BY a""")  # fmt: skip
def q77(spark, d):
    k = F.col("s_suppkey")
    boxes = parquet_table(spark, d, "supplier").select(k.alias("id"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 997).cast("double").alias("y"))
    return objects.dissolved_near(boxes, 40.0)


@query("q78_border_codes", f"""WITH {views.GRID}, c AS (SELECT row // 50 AS tile_row, col // 10 AS tile_col, row % 50 AS r, col % 10 AS c FROM grid)
  SELECT tile_row, tile_col, code, count(*) AS n FROM (SELECT *, CAST(CASE WHEN r = 49 THEN c + 1 WHEN r = 0 THEN -(c + 1) WHEN c = 9 THEN 11 + r WHEN c = 0 THEN -(11 + r) ELSE 0 END AS INTEGER) AS code FROM c) WHERE code <> 0 GROUP BY ALL""")  # fmt: skip
def q78(spark, d):
    cells = views.grid(spark, d).select(F.floor(F.col("row") / 50).alias("tile_row"), F.floor(F.col("col") / 10).alias("tile_col"), (F.col("row") % 50).alias("r"), (F.col("col") % 10).alias("c"))
    return cells.withColumn("code", raster.border_code(50, 10)).filter("code <> 0").groupBy("tile_row", "tile_col", "code").agg(F.count(F.lit(1)).alias("n"))


@query("q79_model_inference", f"WITH {views.BANDS} SELECT vec_id, CAST(round_even(least(greatest(sum(v * (band % 3)) + 0.5, 0), 1) * 100, 0) AS INTEGER) AS probability FROM bands GROUP BY vec_id")
def q79(spark, d):
    tiles = parquet_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("bands"))

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        scores = [sum(v * (i % 3) for i, v in enumerate(b)) + 0.5 for b in batch["bands"]]
        return pd.DataFrame({"vec_id": batch["vec_id"], "p": [min(max(s, 0.0), 1.0) for s in scores]})

    return raster.predicted(tiles, model, "vec_id long, p double").select("vec_id", scalars.quantized(F.col("p"), 100).alias("probability"))


@query("q80_full_tiles", f"""WITH {views.GRID} SELECT row // 3 AS tile_row, col // 5 AS tile_col, count(*) AS n FROM grid GROUP BY ALL HAVING bool_and(value <> 0) AND count(*) = 15""")
def q80(spark, d):
    return tiling.full_tiles(views.grid(spark, d), 3, 5)


@query("q81_three_key_merge", f"""WITH {views.OBJECTS}, a AS (SELECT region, year, satellite, count(*) AS n FROM objects WHERE hp_max < 60 GROUP BY ALL), b AS (SELECT region, year, satellite, count(*) AS n FROM objects WHERE area_ha > 45 GROUP BY ALL)
  SELECT region, year, satellite, a.n AS n_x, b.n AS n_y, a.n - b.n AS difference FROM a JOIN b USING (region, year, satellite)""")  # fmt: skip
def q81(spark, d):
    keys = ["region", "year", "satellite"]
    a, b = (views.objects(spark, d).filter(c).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) for c in ("hp_max < 60", "area_ha > 45"))
    return reshape.joined(a, b, keys).withColumn("difference", F.col("n_x") - F.col("n_y"))


_CELL = "CAST(floor(x / 20) AS BIGINT) * 100 + CAST(floor(y / 20) AS BIGINT)"


@query("q82_confirmed", f"WITH {views.POINTS}, o AS (SELECT point_id AS id, {_CELL} AS cell FROM points) SELECT id, cell FROM o WHERE id % 4 = 0 AND cell IN (SELECT cell FROM o WHERE id % 3 = 1 UNION SELECT cell FROM o WHERE id % 5 = 2)")
def q82(spark, d):
    cell = (F.floor(F.col("x") / 20) * 100 + F.floor(F.col("y") / 20)).alias("cell")
    own = views.points(spark, d).select(F.col("point_id").alias("id"), cell)
    return objects.confirmed(own.filter("id % 4 = 0"), [own.filter("id % 3 = 1"), own.filter("id % 5 = 2")]).select("id", "cell")


@query("q83_first_match", f"""WITH {views.PAIRS}, s AS (SELECT point_id, poly, area_ha FROM pairs) SELECT poly, point_id, area_ha FROM s QUALIFY row_number() OVER (PARTITION BY poly ORDER BY area_ha DESC, point_id) = 1""")
def q83(spark, d):
    pairs = spatial.within_join(views.points(spark, d), views.polys(spark, d).select("poly", "ring"), 200.0).withColumn("order", -F.col("area_ha"))
    return spatial.first_match(pairs, ["poly"], ["order", "point_id"]).select("poly", "point_id", "area_ha")


@query("q84_albers_inverse", f"WITH {views.POINTS} SELECT point_id, round(-75 + x * 0.04, 5) AS lon, round(-33 + y * 0.038, 5) AS lat FROM points")
def q84(spark, d):
    x, y = geometry.albers(-75 + F.col("x") * 0.04, -33 + F.col("y") * 0.038)
    lon, lat = geometry.albers_inverse(F.col("mx"), F.col("my"))
    return views.points(spark, d).select("point_id", x.alias("mx"), y.alias("my")).select("point_id", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


@query("q85_ordered_by_reference", f"""WITH {views.OBJECTS}, s AS (SELECT region, year, sum(area_ha) AS v FROM objects GROUP BY ALL), p AS (SELECT region, CAST(row_number() OVER (ORDER BY v DESC, region) AS INTEGER) AS place FROM s WHERE year = 1998)
  SELECT region, year, v, place FROM s LEFT JOIN p USING (region)""")  # fmt: skip
def q85(spark, d):
    s = views.objects(spark, d).groupBy("region", "year").agg(F.sum("area_ha").alias("v"))
    return series.ordered_by_reference(s, "region", "year", "v", 1998)


@query("q86_aligned_difference", """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey <> 7 GROUP BY 1) SELECT k, a.n - b.n AS difference, round(100 * b.n / a.n, 6) AS percent FROM a FULL JOIN b USING (k)""")
def q86(spark, d):
    a = parquet_table(spark, d, "customer").filter("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = parquet_table(spark, d, "supplier").filter("s_nationkey <> 7").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return reshape.joined(a, b, ["k"], "full").select("k", (F.col("n_x") - F.col("n_y")).alias("difference"), r6(100 * F.try_divide(F.col("n_y"), F.col("n_x")), "percent"))


@query("q87_affine_pixels", f"WITH {views.GRID} SELECT row, col, CAST((col + 0.5) * 30.0 + 100.5 AS DOUBLE) AS x, CAST((row + 0.5) * -30.0 + 900.25 AS DOUBLE) AS y FROM grid")
def q87(spark, d):
    x, y = geometry.pixel_centre(F.col("row"), F.col("col"), 30.0, 0.0, 100.5, 0.0, -30.0, 900.25)
    shown = views.grid(spark, d).select("row", "col", x.alias("x"), y.alias("y"))
    back = geometry.pixel_of(F.col("x"), F.col("y"), 30.0, 100.5, -30.0, 900.25)
    return shown.filter((back[0] == F.col("row")) & (back[1] == F.col("col")))


@query("q88_lines_in_polygons", f"""WITH {views.SEGMENTS}, {views.POLYS}, t AS (SELECT s.id, e.poly, ((e.x1 - s.x1) * (e.y2 - e.y1) - (e.y1 - s.y1) * (e.x2 - e.x1)) / nullif((s.x2 - s.x1) * (e.y2 - e.y1) - (s.y2 - s.y1) * (e.x2 - e.x1), 0) AS t, ((e.x1 - s.x1) * (s.y2 - s.y1) - (e.y1 - s.y1) * (s.x2 - s.x1)) / nullif((s.x2 - s.x1) * (e.y2 - e.y1) - (s.y2 - s.y1) * (e.x2 - e.x1), 0) AS u FROM segments s CROSS JOIN edges e),
  k AS (SELECT id, poly, t FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 UNION ALL SELECT s.id, n_nationkey, v.t FROM segments s CROSS JOIN nation CROSS JOIN (VALUES (0.0), (1.0)) AS v(t)),
  p AS (SELECT id, poly, t AS a, lead(t) OVER (PARTITION BY id, poly ORDER BY t) AS b FROM k), m AS (SELECT p.*, s.x1 + (a + b) / 2 * (s.x2 - s.x1) AS mx, s.y1 + (a + b) / 2 * (s.y2 - s.y1) AS my, sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)) AS l FROM p JOIN segments s USING (id) WHERE b > a),
  i AS (SELECT m.id, m.poly, m.a, any_value((b - a) * l) AS part FROM m JOIN edges e ON e.poly = m.poly AND (e.y1 > my) <> (e.y2 > my) AND mx < (e.x2 - e.x1) * (my - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY ALL HAVING count(*) % 2 = 1)
  SELECT poly, round(sum(part), 4) AS length FROM i GROUP BY poly""")  # fmt: skip
def q88(spark, d):
    found = spatial.polygon_line_lengths(views.segments(spark, d), views.polys(spark, d).select("poly", "ring"), "poly", 100.0)
    return found.groupBy("poly").agg(F.round(F.sum("inside"), 4).alias("length"))
