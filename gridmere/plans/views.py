"""Views of the driver's tables that stand for rasters, objects, points and regions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import parquet_table

COLUMNS = 30  # of the grid: days
#: Offsets of the octagons' corners from their centres.
OCTAGON = ((-90, -32), (-30, -90), (30, -90), (90, -32), (90, 32), (30, 90), (-30, 90), (-90, 32))


def objects(spark: SparkSession, d: str) -> DataFrame:
    item, supplier, nation = (parquet_table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    return item.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("l_quantity").alias("area_ha"), F.floor(F.col("l_discount") * 1000 + 0.0).cast("int").alias("hp_max"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("satellite"), F.col("n_name").alias("region"), "n_nationkey"
    )


OBJECTS = """objects AS (
  SELECT l_quantity AS area_ha, CAST(floor(l_discount * 1000 + 0.0) AS INTEGER) AS hp_max, CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS satellite, n_name AS region, n_nationkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, value) of every user and day: the events counted, 0 where there are none."""
    events = parquet_table(spark, d, "events")
    counted = events.groupBy(F.col("user_id").alias("row"), (F.dayofmonth("ts") - 1).cast("long").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    rows = events.agg(F.max("user_id").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("row"))
    cells = rows.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COLUMNS - 1).cast("long"))).alias("col"))
    return cells.join(counted, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("value"))


GRID = f"""grid AS (
  SELECT a.row, b.col, coalesce(n, 0) AS value
  FROM (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS row) a CROSS JOIN (SELECT unnest(range(0, {COLUMNS})) AS col) b
  LEFT JOIN (SELECT user_id AS row, day(ts) - 1 AS col, count(*) AS n FROM events GROUP BY ALL) e ON e.row = a.row AND e.col = b.col)"""
MASK = f"{GRID}, mask AS (SELECT row, col, value, row * {COLUMNS} + col AS id FROM grid WHERE value > (SELECT quantile_cont(value, 0.8) FROM grid))"


def with_ids(cells: DataFrame) -> DataFrame:
    return cells.withColumn("id", F.col("row") * COLUMNS + F.col("col"))


def weeks(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, year, value, cloud): users, days of the week, and weeks as years, with a made-up cloud cover."""
    g = grid(spark, d)
    cell = g.select("row", (F.col("col") % 7).alias("col"), F.floor(F.col("col") / 7).alias("year"), "value")
    return cell.withColumn("cloud", (F.col("row") * 7 + F.col("col") * 13 + F.col("year") * 29) % 101)


WEEKS = f"{GRID}, weeks AS (SELECT row, col % 7 AS col, col // 7 AS year, value, (row * 7 + (col % 7) * 13 + (col // 7) * 29) % 101 AS cloud FROM grid)"


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return parquet_table(spark, d, "events").select(
        e.alias("point_id"), (2 * (e * 37 % 500) + 1).cast("double").alias("x"), (2 * ((e * 91 + F.floor(e / 500)) % 500) + 1).cast("double").alias("y"), F.col("value").alias("area_ha")
    )


POINTS = "points AS (SELECT event_id AS point_id, CAST(2 * (event_id * 37 % 500) + 1 AS DOUBLE) AS x, CAST(2 * ((event_id * 91 + event_id // 500) % 500) + 1 AS DOUBLE) AS y, value AS area_ha FROM events)"


def polys(spark: SparkSession, d: str, scale: float = 1.0) -> DataFrame:
    """(poly, region, ring): an octagon for each nation."""
    key = F.col("n_nationkey")
    cx, cy = 200 * (key % 5) + 100, 200 * F.floor(key / 5) + 100
    ring = F.array(*(F.struct(((cx + a) * scale).cast("double").alias("x"), ((cy + b) * scale).cast("double").alias("y")) for a, b in (*OCTAGON, OCTAGON[0])))
    return parquet_table(spark, d, "nation").select(key.alias("poly"), F.col("n_name").alias("region"), ring.alias("ring"))


_corners = ", ".join(f"({i}, {a}, {b}, {OCTAGON[(i + 1) % 8][0]}, {OCTAGON[(i + 1) % 8][1]})" for i, (a, b) in enumerate(OCTAGON))
POLYS = f"""edges AS (
  SELECT n_nationkey AS poly, 200 * (n_nationkey % 5) + 100 + a AS x1, 200 * (n_nationkey // 5) + 100 + b AS y1, 200 * (n_nationkey % 5) + 100 + c AS x2, 200 * (n_nationkey // 5) + 100 + e AS y2
  FROM nation CROSS JOIN (VALUES {_corners}) AS t(i, a, b, c, e))"""
PAIRS = f"""{POINTS}, {POLYS}, pairs AS (
  SELECT point_id, poly, any_value(area_ha) AS area_ha, any_value(x) AS x, any_value(y) AS y FROM points JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
  GROUP BY point_id, poly HAVING count(*) % 2 = 1)"""


def bands(spark: SparkSession, d: str) -> DataFrame:
    return parquet_table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("band", "v")).withColumn("v", F.col("v").cast("double"))


BANDS = "bands AS (SELECT vec_id, unnest(range(0, len(embedding))) AS band, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return parquet_table(spark, d, "events").select("event_id", "user_id", "value", k.alias("k"), (F.col("value") > 50).alias("pred"), (k > 50).alias("truth"))


PREDICTIONS = "predictions AS (SELECT event_id, user_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value > 50 AS pred, CAST(json_extract(props, '$.k') AS INTEGER) > 50 AS truth FROM events)"
#: Event types as land-cover classes.
TYPE_CLASS = {"click": "crop", "error": "forest", "purchase": "savanna", "signup": "grassland", "view": "pasture"}


def class_history(spark: SparkSession, d: str) -> DataFrame:
    """(row, year, value): for each user and day the commonest event type, the first in the alphabet of equal ones."""
    counted = parquet_table(spark, d, "events").groupBy(F.col("user_id").alias("row"), F.dayofmonth("ts").alias("year"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("row", "year").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("value"))


HISTORY = """history AS (
  SELECT row, year, value FROM (
    SELECT user_id AS row, day(ts) AS year, event_type AS value, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY count(*) DESC, event_type) AS k
    FROM events GROUP BY user_id, day(ts), event_type) WHERE k = 1)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Short segments, one for each supplier."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 1000).cast("double"), (k * 91 % 997).cast("double")
    return parquet_table(spark, d, "supplier").select(k.alias("id"), x.alias("x1"), y.alias("y1"), (x + k * 13 % 121 - 60).alias("x2"), (y + k * 29 % 119 - 59).alias("y2"))


SEGMENTS = """segments AS (
  SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 1000 AS DOUBLE) AS x1, CAST(s_suppkey * 91 % 997 AS DOUBLE) AS y1,
    CAST(s_suppkey * 37 % 1000 AS DOUBLE) + s_suppkey * 13 % 121 - 60 AS x2, CAST(s_suppkey * 91 % 997 AS DOUBLE) + s_suppkey * 29 % 119 - 59 AS y2 FROM supplier)"""
