"""Files of other programs' formats, written and read back: tiled rasters, grid cubes, polygons, workbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..sources import netcdf, parts, shapefile, storage, tiff, workbook
from ..sources.storage import parquet_table
from . import shapes, views
from .registry import query, r6

ROWS = 1024  # of a raster file


@query("q121_tiff_windows", f"WITH {views.GRID} SELECT row, col, value AS first, value * 3 + 1 AS second FROM grid WHERE row % {ROWS} BETWEEN 13 AND 77 AND col BETWEEN 6 AND 21")
def q121(spark, d):
    """Two bands as sibling files, each of tiles of 16 x 16; a window of every file reads its tiles and stacks the bands."""
    g = views.grid(spark, d)
    bands = F.explode(F.array(F.struct(F.lit("first").alias("band"), F.col("value")), F.struct(F.lit("second").alias("band"), (F.col("value") * 3 + 1).alias("value")))).alias("b")
    name = F.concat(F.col("b.band"), F.lit("_"), F.floor(F.col("row") / ROWS).cast("string"))
    path = storage.scratch(spark, "rasters")
    tiff.write(g.select("row", "col", bands).select(name.alias("name"), (F.col("row") % ROWS).alias("row"), "col", F.col("b.value").alias("value")), path, tile=16, dtype="<i4", nodata=-1.0, place=(-50.0, -10.0, 0.25, -0.25))
    read = tiff.cells(spark, path, (13, 6, 65, 16))
    part = F.split(parts.stem(F.col("path")), "_")
    placed = read.select(part[0].alias("band"), (part[1].cast("long") * ROWS + F.col("row")).alias("row"), "col", F.col("value").cast("long").alias("value"))
    return placed.groupBy("row", "col").pivot("band", ["first", "second"]).agg(F.first("value"))


@query("q122_cube_means", """WITH n AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, c_nationkey % 5 AS col, c_nationkey // 5 AS row, CAST(count(*) AS DOUBLE) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT CAST(year AS INTEGER) AS year, -10.0 + 0.5 * row AS y, -50.0 + 0.5 * col AS x, round(avg(n), 6) AS mean, count(*) AS months FROM n WHERE year >= 1994 GROUP BY ALL""")  # fmt: skip
def q122(spark, d):
    """Monthly cubes, a file for each year; means by year and cell from the first year that is asked for."""
    o, c = parquet_table(spark, d, "orders"), parquet_table(spark, d, "customer")
    month = F.trunc("o_orderdate", "month")
    n = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(month.alias("month"), "c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("value"))
    cells = n.select(
        F.concat(F.lit("orders_"), F.year("month").cast("string")).alias("name"), (F.datediff("month", F.lit("1900-01-01").cast("date")) * 24).alias("time"), F.floor(F.col("c_nationkey") / 5).alias("row"), (F.col("c_nationkey") % 5).alias("col"), "value"
    )
    path = storage.scratch(spark, "cubes")
    netcdf.write(cells, path, "orders", "hours since 1900-01-01", y=(-10.0, 0.5), x=(-50.0, 0.5))
    cube = netcdf.cube(spark, path, "orders", dates=("1994-01-01", "2100-12-31"))
    return cube.groupBy(F.year("date").alias("year"), "y", "x").agg(r6(F.avg("value"), "mean"), F.count("value").alias("months")).filter("months > 0")


@query("q123_shapefile_box", f"""WITH {shapes.BOXES} SELECT id, CAST(nation AS BIGINT) AS nation, s_name AS name, 0.75 * w * h AS area FROM boxes JOIN supplier ON id = s_suppkey WHERE x0 + w >= 200 AND x0 <= 620 AND y0 + h >= 150 AND y0 <= 480""")
def q123(spark, d):
    """Polygons with holes as shapefiles, found by a box."""
    outer = F.get("rings", 0)
    ends = geometry.bounds(outer)
    quarter = F.transform(outer, lambda p: F.struct(*((0.5 * p[c] + 0.25 * (ends[f"{c}_min"] + ends[f"{c}_max"])).alias(c) for c in "xy")))
    named = shapes.boxes(spark, d).join(parquet_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")
    path = storage.scratch(spark, "shapes")
    shapefile.write(named.select("id", "nation", "name", F.array(outer, quarter).alias("rings")), path, 250.0)
    found = shapefile.polygons(spark, path, "id long, nation long, name string", (200, 150, 620, 480))
    return found.select("id", "nation", "name", geometry.polygon_area(F.col("rings")).alias("area"))


@query("q124_workbooks", """SELECT c_custkey AS "key", c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance FROM customer""")
def q124(spark, d):
    """A workbook for each nation and range of customers, with two lines of title, a header and a total; read as one table."""
    c = parquet_table(spark, d, "customer")
    name = F.concat_ws("_", F.lit("nation"), F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / 1_000_000).cast("string")).alias("name")
    text = [F.col("c_custkey").cast("string"), F.col("c_name"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).cast("string")]
    rows = c.select(name, (F.col("c_custkey") + 10).alias("row"), *(t.alias(f"t{i}") for i, t in enumerate(text)))
    books = rows.groupBy("name").agg(F.count(F.lit(1)).cast("string").alias("n"))
    line = lambda row, *texts: F.struct(F.lit(row).cast("long").alias("row"), *(t.cast("string").alias(f"t{i}") for i, t in enumerate(texts)))
    none = F.lit(None)
    around = F.explode(F.array(line(0, F.lit("Customers & balances"), none, none), line(1, F.col("name"), none, none), line(2, F.lit("key"), F.lit("name"), F.lit("balance")), line(1 << 62, F.lit("total"), F.col("n"), none)))
    path = storage.scratch(spark, "books")
    workbook.write(rows.unionByName(books.select("name", around.alias("l")).select("name", "l.*")), path)
    return workbook.table(spark, path, "key long, name string, balance double", header=2, skip_tail=1).select("key", "name", "balance")
