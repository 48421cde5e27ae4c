"""Regional, yearly and agreement statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, scalars
from ..functions.geometry import ring_area
from ..operators import reshape, series, statistics
from ..sources.storage import parquet_table
from . import views
from .registry import query, r6

KEPT = "hp_max <= 50 AND area_ha BETWEEN 0.05 AND 50"


@query("q01_region_stats", f"""WITH {views.OBJECTS}
  SELECT region, round(sum(area_ha), 6) AS area_sum, count(*) AS area_count, median(area_ha) AS area_median, round(count(*) / 25440.0, 6) AS density
  FROM objects WHERE hp_max <= 50 AND area_ha BETWEEN 0.05 AND 50 GROUP BY region""")  # fmt: skip
def q01(spark, d):
    stats = statistics.area_statistics(views.objects(spark, d).filter(KEPT), ["region"])
    sizes = views.polys(spark, d).select("region", F.abs(ring_area(F.col("ring"))).alias("size"))
    return stats.join(sizes, "region").select("region", r6("area_sum", "area_sum"), "area_count", "area_median", r6(F.col("area_count") / F.col("size"), "density"))


_Q02 = "SELECT year, satellite, round(avg(area_ha), 6) AS area_ha_mean, median(area_ha) AS area_ha_median, sum(area_ha) AS area_ha_sum, count(*) AS area_ha_count, round(avg(area_ha / 100), 6) AS area_km2_mean, round(median(area_ha / 100), 6) AS area_km2_median, round(sum(area_ha / 100), 4) AS area_km2_sum, count(*) AS area_km2_count FROM objects GROUP BY year, satellite"


def _by_year(spark, d):
    own = views.objects(spark, d).withColumn("area_km2", F.col("area_ha") / 100)
    return statistics.statistics_of(own, ["year", "satellite"], ["area_ha", "area_km2"])


@query("q02_year_sensor_stats", f"WITH {views.OBJECTS} {_Q02}")
def q02(spark, d):
    s = _by_year(spark, d)
    return s.select("year", "satellite", r6("area_ha_mean", "area_ha_mean"), "area_ha_median", "area_ha_sum", "area_ha_count", r6("area_km2_mean", "area_km2_mean"), r6("area_km2_median", "area_km2_median"), F.round("area_km2_sum", 4).alias("area_km2_sum"), "area_km2_count")


@query("q03_sensor_means", f"""WITH {views.OBJECTS}, s AS (SELECT year, satellite, avg(area_ha) AS m, median(area_ha) AS md, sum(area_ha) AS s, count(*) AS n FROM objects GROUP BY year, satellite)
  SELECT satellite, round(avg(m), 6) AS mean_of_means, round(avg(md), 6) AS mean_of_medians, round(avg(s), 4) AS mean_of_sums, round(avg(n), 6) AS mean_of_counts
  FROM s WHERE year BETWEEN 1996 AND 2000 AND NOT (satellite = 'A' AND year > 1998) GROUP BY satellite""")  # fmt: skip
def q03(spark, d):
    kept = _by_year(spark, d).filter(F.col("year").between(1996, 2000) & ~((F.col("satellite") == "A") & (F.col("year") > 1998)))
    return kept.groupBy("satellite").agg(r6(F.avg("area_ha_mean"), "mean_of_means"), r6(F.avg("area_ha_median"), "mean_of_medians"), F.round(F.avg("area_ha_sum"), 4).alias("mean_of_sums"), r6(F.avg("area_ha_count"), "mean_of_counts"))


@query("q04_size_shares", f"""WITH {views.OBJECTS}
  SELECT round(avg(CAST(area_ha > 10 AS INTEGER)), 6) AS large_count_share, round(sum(area_ha) FILTER (WHERE area_ha > 10) / sum(area_ha), 6) AS large_area_share,
    round(avg(CAST(area_ha < 5 AS INTEGER)), 6) AS small_count_share, round(sum(area_ha) FILTER (WHERE area_ha < 5) / sum(area_ha), 6) AS small_area_share FROM objects""")  # fmt: skip
def q04(spark, d):
    s = statistics.conditional_shares(views.objects(spark, d), "area_ha", {"large": F.col("area_ha") > 10, "small": F.col("area_ha") < 5})
    return s.select(*(r6(c, c) for c in s.columns))


_BOUNDS = (5, 10, 20, 30, 40)


@query("q05_size_class_intervals", f"""WITH {views.OBJECTS}
  SELECT 'left' AS closed, {' + '.join(f'CAST(area_ha >= {b} AS INTEGER)' for b in _BOUNDS)} AS size_class, count(*) AS n FROM objects GROUP BY ALL
  UNION ALL SELECT 'right', {' + '.join(f'CAST(area_ha > {b} AS INTEGER)' for b in _BOUNDS)}, count(*) FROM objects GROUP BY ALL""")  # fmt: skip
def q05(spark, d):
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("closed"), scalars.size_class(F.col("area_ha"), _BOUNDS, k).alias("size_class")) for k in ("left", "right")))).alias("c")
    return views.objects(spark, d).select(both).groupBy("c.closed", "c.size_class").agg(F.count(F.lit(1)).alias("n"))


@query("q06_cleaned_trail", f"""WITH {views.OBJECTS}
  SELECT '0 all' AS step, count(*) AS n, sum(area_ha) AS area FROM objects UNION ALL SELECT '1 overlap', count(*), sum(area_ha) FROM objects WHERE hp_max <= 50
  UNION ALL SELECT '2 large', count(*), sum(area_ha) FROM objects WHERE hp_max <= 50 AND area_ha <= 40 UNION ALL SELECT '3 small', count(*), sum(area_ha) FROM objects WHERE hp_max <= 50 AND area_ha BETWEEN 3 AND 40""")  # fmt: skip
def q06(spark, d):
    steps = {"0 all": F.lit(True), "1 overlap": F.col("hp_max") <= 50}
    steps["2 large"] = steps["1 overlap"] & (F.col("area_ha") <= 40)
    steps["3 small"] = steps["2 large"] & (F.col("area_ha") >= 3)
    sums = views.objects(spark, d).agg(*(a for i, c in enumerate(steps.values()) for a in (F.count_if(c).alias(f"n{i}"), F.sum(F.when(c, F.col("area_ha"))).alias(f"a{i}"))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("area")) for i, s in enumerate(steps)))).alias("r")).select("r.*")


@query("q07_value_counts_share", "SELECT p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_type")
def q07(spark, d):
    return statistics.counts_with_share(parquet_table(spark, d, "part"), ["p_type"]).select("p_type", "n", r6("share", "share"))


@query("q08_argmax_group", """SELECT nation, total, o_orderkey FROM (
  SELECT n_name AS nation, o_totalprice AS total, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS k
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE k = 1""")  # fmt: skip
def q08(spark, d):
    orders, customer, nation = (parquet_table(spark, d, t) for t in ("orders", "customer", "nation"))
    own = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_totalprice").alias("total"), "o_orderkey", "c_nationkey")
    best = statistics.best_row(own, ["c_nationkey"], "total", "o_orderkey", ["o_orderkey"])
    return best.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), "total", "o_orderkey")


@query("q09_spread_stats", """SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS std, min(p_retailprice) AS low, max(p_retailprice) AS high, round(max(p_retailprice) - min(p_retailprice), 6) AS range,
  round(stddev_samp(p_retailprice) / avg(p_retailprice), 6) AS std_over_mean FROM part GROUP BY p_brand""")  # fmt: skip
def q09(spark, d):
    s = statistics.spread_statistics(parquet_table(spark, d, "part"), ["p_brand"], "p_retailprice")
    return s.select("p_brand", r6("std", "std"), "low", "high", r6("range", "range"), r6("std_over_mean", "std_over_mean"))


@query("q10_rollup_fold", """WITH c AS (SELECT r_name AS region, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
  f AS (SELECT region, CASE WHEN n * 25 < (SELECT sum(n) FROM c) THEN 'Other' ELSE segment END AS segment, n FROM c)
  SELECT region, segment, CAST(sum(n) AS BIGINT) AS n, CAST(GROUPING(region, segment) AS INTEGER) AS level FROM f GROUP BY ROLLUP (region, segment)""")  # fmt: skip
def q10(spark, d):
    customer, nation, region = (parquet_table(spark, d, t) for t in ("customer", "nation", "region"))
    own = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))
    return statistics.fold_small(own, "region", "segment", -(-customer.count() // 25))


_YEARS = tuple(range(1995, 2002))


def _pivoted(spark, d):
    return reshape.wide(views.objects(spark, d), ["satellite"], "year", _YEARS, F.sum("area_ha"), "y")


@query("q11_pivot_year", f"WITH {views.OBJECTS} SELECT satellite, {', '.join(f'sum(area_ha) FILTER (WHERE year = {y}) AS y{y}' for y in _YEARS)} FROM objects GROUP BY satellite")
def q11(spark, d):
    return _pivoted(spark, d)


@query("q12_unpivot", f"WITH {views.OBJECTS} SELECT satellite, 'y' || year AS name, sum(area_ha) AS value FROM objects GROUP BY satellite, year")
def q12(spark, d):
    return reshape.long(_pivoted(spark, d), ["satellite"], [f"y{y}" for y in _YEARS], "name", "value").filter("value IS NOT NULL")


@query("q13_outer_chain", """SELECT * FROM (SELECT c_nationkey AS nation, CAST(count(*) AS DOUBLE) AS customers FROM customer WHERE c_nationkey < 20 GROUP BY 1)
  FULL JOIN (SELECT s_nationkey AS nation, CAST(count(*) AS DOUBLE) AS suppliers FROM supplier WHERE s_nationkey > 3 GROUP BY 1) USING (nation)
  FULL JOIN (SELECT c_nationkey AS nation, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) USING (nation)
  FULL JOIN (SELECT c_nationkey AS nation, round(max(o_totalprice), 2) AS largest FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 3 = 0 GROUP BY 1) USING (nation)""")  # fmt: skip
def q13(spark, d):
    customer, supplier, orders = (parquet_table(spark, d, t) for t in ("customer", "supplier", "orders"))
    own = customer.withColumnRenamed("c_nationkey", "nation")
    tables = {
        "customers": own.filter("nation < 20").groupBy("nation").agg(F.count(F.lit(1)).alias("customers")),
        "suppliers": supplier.withColumnRenamed("s_nationkey", "nation").filter("nation > 3").groupBy("nation").agg(F.count(F.lit(1)).alias("suppliers")),
        "balance": own.filter("nation % 2 = 0").groupBy("nation").agg(F.round(F.sum("c_acctbal"), 2).alias("balance")),
        "largest": orders.join(own.filter("nation % 3 = 0"), F.col("o_custkey") == F.col("c_custkey")).groupBy("nation").agg(F.round(F.max("o_totalprice"), 2).alias("largest")),
    }
    return statistics.outer_chain(tables, "nation")


@query("q14_density_percapita", """WITH b AS (SELECT n_nationkey AS nation, count(c_custkey) AS people, sum(c_acctbal) AS money FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1),
  h AS (SELECT nation, people, CASE WHEN nation % 4 = 0 THEN NULL ELSE money END AS money, people - CAST(5 AS DOUBLE) * (nation % 7) AS net FROM b)
  SELECT nation, people, round(coalesce(money, avg(money) OVER ()), 4) AS money, round(coalesce(money, avg(money) OVER ()) / nullif(people, 0), 4) AS money_per_capita,
    round(people / 25440.0, 6) AS people_density, greatest(net, CAST(0 AS DOUBLE)) AS net FROM h""")  # fmt: skip
def q14(spark, d):
    nation, customer = (parquet_table(spark, d, t) for t in ("nation", "customer"))
    base = nation.join(customer.filter("c_acctbal > 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").alias("nation")).agg(F.count("c_custkey").alias("people"), F.sum("c_acctbal").alias("money"))
    holes = base.select("nation", "people", F.when(F.col("nation") % 4 != 0, F.col("money")).alias("money"), (F.col("people") - 5.0 * (F.col("nation") % 7)).alias("net"), F.lit(25440.0).alias("size"))
    clean = statistics.clean_predictors(holes, mean=["money"], least_zero=["net"])
    full = statistics.ratios(statistics.ratios(clean, ["money"], "people", "_per_capita"), ["people"], "size", "_density")
    return full.select("nation", "people", F.round("money", 4).alias("money"), F.round("money_per_capita", 4).alias("money_per_capita"), r6("people_density", "people_density"), "net")


_COUNTS = "count(*) FILTER (WHERE pred AND truth) AS tp, count(*) FILTER (WHERE pred AND NOT truth) AS fp, count(*) FILTER (WHERE NOT pred AND truth) AS fn, count(*) FILTER (WHERE NOT pred AND NOT truth) AS tn"


@query("q15_confusion", f"""WITH {views.PREDICTIONS}, c AS (SELECT user_id, {_COUNTS} FROM predictions GROUP BY user_id),
  m AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp + fn, 0) AS iou FROM c)
  SELECT user_id, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(iou, 6) AS iou FROM m
  UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), CAST(sum(tn) AS BIGINT), round(sum(tp) / (sum(tp) + sum(fp)), 6), round(sum(tp) / (sum(tp) + sum(fn)), 6), round(sum(tp) / (sum(tp) + sum(fp) + sum(fn)), 6) FROM c
  UNION ALL SELECT -1, NULL, NULL, NULL, NULL, round(avg(precision), 6), round(avg(recall), 6), round(avg(iou), 6) FROM m""")  # fmt: skip
def q15(spark, d):
    counts = statistics.confusion(views.predictions(spark, d), ["user_id"], F.col("pred"), F.col("truth"))
    m = statistics.metrics()
    rated = counts.select("*", *(m[k].alias(k) for k in ("precision", "recall", "iou")))
    shown = [r6(k, k) for k in ("precision", "recall", "iou")]
    each = rated.select("user_id", "tp", "fp", "fn", "tn", *shown)
    none = F.lit(None).cast("long")
    micro = counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))).select(none.alias("user_id"), "tp", "fp", "fn", "tn", *(r6(m[k], k) for k in ("precision", "recall", "iou")))
    mean = rated.agg(*(F.avg(k).alias(k) for k in ("precision", "recall", "iou"))).select(F.lit(-1).cast("long").alias("user_id"), *(none.alias(c) for c in ("tp", "fp", "fn", "tn")), *shown)
    return each.unionByName(micro).unionByName(mean)


@query("q16_threshold_sweep", f"""WITH {views.PREDICTIONS}, s AS (SELECT c * 5.0 AS cutoff, count(*) FILTER (WHERE value > c * 5.0 AND truth) AS tp, count(*) FILTER (WHERE value > c * 5.0 AND NOT truth) AS fp, count(*) FILTER (WHERE value <= c * 5.0 AND truth) AS fn
  FROM predictions CROSS JOIN (SELECT unnest(range(0, 101)) AS c) GROUP BY c),
  m AS (SELECT *, round(tp / nullif(tp + fp + fn, 0), 12) AS iou FROM s)
  SELECT CAST(cutoff AS DOUBLE) AS cutoff, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(iou, 6) AS iou,
    CAST((SELECT median(cutoff) FROM m WHERE iou = (SELECT max(iou) FROM m)) AS DOUBLE) AS best FROM m""")  # fmt: skip
def q16(spark, d):
    sweep = statistics.threshold_sweep(views.predictions(spark, d), "value", "truth", [5.0 * i for i in range(101)])
    m = statistics.metrics()
    best = statistics.best_cutoff(sweep).select(F.col("cutoff").alias("best"))
    return sweep.select("cutoff", "tp", "fp", "fn", *(r6(m[k], k) for k in ("precision", "recall", "iou"))).crossJoin(F.broadcast(best))


@query("q17_pr_curve", f"""WITH {views.PREDICTIONS}, c AS (SELECT value, count(*) FILTER (WHERE truth) AS pos, count(*) AS n FROM predictions GROUP BY value),
  r AS (SELECT value, sum(pos) OVER (ORDER BY value DESC) AS tp, sum(n) OVER (ORDER BY value DESC) AS called, sum(pos) OVER () AS everything FROM c)
  SELECT value, CAST(tp AS BIGINT) AS tp, round(tp / called, 6) AS precision, round(tp / everything, 6) AS recall FROM r""")  # fmt: skip
def q17(spark, d):
    return statistics.precision_recall(views.predictions(spark, d), "value", "truth").select("value", "tp", r6("precision", "precision"), r6("recall", "recall"))


_DAILY = "daily AS (SELECT event_type, day(ts) AS day, avg(value) AS v FROM events GROUP BY ALL)"


def _daily(spark, d):
    return parquet_table(spark, d, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("v"))


@query("q18_rolling", f"""WITH {_DAILY} SELECT event_type, CAST(day AS INTEGER) AS day, round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS expanding,
  round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING), 6) AS rolling, round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smoothed FROM daily""")  # fmt: skip
def q18(spark, d):
    key, order = ["event_type"], ["day"]
    return _daily(spark, d).select("event_type", "day", r6(series.expanding_mean("v", key, order), "expanding"), r6(series.rolling_mean("v", key, order, 7), "rolling"), r6(series.smoothed("v", key, order), "smoothed"))


@query("q19_first_last_change", f"""WITH {views.OBJECTS}, s AS (SELECT region, year, sum(area_ha) AS v FROM objects WHERE year <= 2000 GROUP BY ALL),
  f AS (SELECT region, arg_min(v, year) AS first_value, arg_max(v, year) AS last_value FROM s GROUP BY region)
  SELECT region, CAST(year AS INTEGER) AS year, round(v / max(v) FILTER (WHERE year = 1997) OVER (PARTITION BY region), 6) AS scaled, first_value, last_value, round(100 * (last_value - first_value) / first_value, 6) AS change_percent
  FROM s JOIN f USING (region)""")  # fmt: skip
def q19(spark, d):
    s = views.objects(spark, d).filter("year <= 2000").groupBy("region", "year").agg(F.sum("area_ha").alias("v"))
    change = series.first_last_change(s, ["region"], "year", "v")
    return series.scaled_to(s, ["region"], "year", "v", 1997).join(change, "region").select("region", "year", r6("scaled", "scaled"), "first_value", "last_value", r6("change_percent", "change_percent"))


@query("q20_t_interval", f"""WITH s AS (SELECT user_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, CAST(1.959963984540054 AS DOUBLE) AS z, CAST(count(value) - 1 AS DOUBLE) AS v FROM events GROUP BY user_id HAVING count(value) > 1),
  t AS (SELECT *, z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3) + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * v**4)
    + (27 * z**11 + 339 * z**9 + 930 * z**7 - 1782 * z**5 - 765 * z**3 + 17955 * z) / (368640 * v**5) AS t FROM s)
  SELECT user_id, n, round(mean, 4) AS mean, round(mean - t * std / sqrt(n), 4) AS low, round(mean + t * std / sqrt(n), 4) AS high FROM t""")  # fmt: skip
def q20(spark, d):
    return statistics.t_interval(parquet_table(spark, d, "events"), ["user_id"], "value").filter("n > 1").select("user_id", "n", *((F.round(c, 4) + 0.0).alias(c) for c in ("mean", "low", "high")))


@query("q21_filename_parse", r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(url, '/[^/]*$', '') AS folder, TRY_CAST(nullif(regexp_extract(url || '/1999_' || (1000 + page_id % 2000), '.*([1-2][0-9]{3})', 1), '') AS INTEGER) AS year,
  substr(regexp_extract(url, '([^/]*)$', 1), 1, 3) AS satellite, CAST(list_sum(list_transform(regexp_extract_all(url, '\d+'), lambda s: CAST(s AS BIGINT))) AS BIGINT) AS digits FROM pages""")  # fmt: skip
def q21(spark, d):
    url = F.col("url")
    base = parsing.base_name(url)
    named = F.concat(url, F.lit("/1999_"), (1000 + F.col("page_id") % 2000).cast("string"))
    total = F.aggregate(parsing.digit_runs(url), F.lit(0).cast("long"), lambda a, x: a + x)
    runs = parsing.digit_runs(url)
    return parquet_table(spark, d, "pages").select("page_id", base.alias("base"), parsing.folder(url).alias("folder"), parsing.last_year(named).alias("year"), parsing.satellite_year(base)[0].alias("satellite"), F.when(F.size(runs) > 0, total).cast("long").alias("digits"))


@query("q22_array_parse", """WITH t AS (SELECT user_id, '[' || string_agg(CAST(k AS VARCHAR), ' ' ORDER BY k) || ']' AS text FROM (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY user_id),
  p AS (SELECT user_id, text, list_filter(list_transform(string_split(replace(replace(text, '[', ''), ']', ''), ' '), lambda s: CAST(s AS INTEGER)), lambda n: n <> 0) AS a FROM t)
  SELECT user_id, text, len(a) AS n, CAST(list_sum(a) AS BIGINT) AS total, len(a) > 0 AS on_border FROM p""")  # fmt: skip
def q22(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    text = parquet_table(spark, d, "events").select("user_id", k.alias("k")).groupBy("user_id").agg(parsing.array_text(F.array_sort(F.collect_set("k"))).alias("text"))
    a = parsing.number_array(F.col("text"))
    return text.select("user_id", "text", F.size(a).cast("long").alias("n"), F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y).alias("total"), (F.size(a) > 0).alias("on_border"))


@query("q23_dict_parse", """WITH c AS (SELECT user_id, day(ts) AS day, count(*) AS n FROM events GROUP BY ALL),
  t AS (SELECT user_id, '{' || string_agg(day || ': ' || n, ', ' ORDER BY day) || '}' AS text FROM c GROUP BY user_id)
  SELECT user_id, text, CAST(coalesce(sum(n) FILTER (WHERE day IN (3, 15, 21)), 0) AS BIGINT) AS chosen, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (WHERE day = 3), 0) AS BIGINT) AS c3, CAST(coalesce(sum(n) FILTER (WHERE day = 15), 0) AS BIGINT) AS c15
  FROM t JOIN c USING (user_id) GROUP BY user_id, text""")  # fmt: skip
def q23(spark, d):
    counted = parquet_table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda e: F.concat_ws(": ", e["day"].cast("string"), e["n"].cast("string")))
    text = counted.groupBy("user_id").agg(F.concat(F.lit("{"), F.array_join(entry, ", "), F.lit("}")).alias("text"))
    m = text.withColumn("m", parsing.count_map(F.col("text")))
    return reshape.map_columns(m.select("user_id", "text", "m", parsing.map_sum(F.col("m"), [3, 15, 21]).alias("chosen"), parsing.map_sum(F.col("m")).alias("total")), ["user_id", "text", "chosen", "total"], "m", [3, 15])


@query("q24_hist", "SELECT CAST(least(floor((value - 0.0) / 20.0), 19) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 400 GROUP BY 1")
def q24(spark, d):
    return statistics.histogram(parquet_table(spark, d, "events"), "value", 0.0, 400.0, 20)
