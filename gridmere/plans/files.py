"""Tables that are written to files and read back: text with converters, appended parts, tiles, records, polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, parsing
from ..operators import tiling
from ..sources import storage
from ..sources.storage import parquet_table
from . import shapes, views
from .registry import query


@query("q115_csv_appended", """SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, list_filter([c_nationkey, c_custkey % 3, 5], lambda x: x <> 0) AS overlaps FROM customer""")
def q115(spark, d):
    """Two appends of CSV with a header, a missing number as NaN, and an array as text, read with a schema and a converter."""
    c = parquet_table(spark, d, "customer")
    numbers = F.array(F.col("c_nationkey").cast("int"), (F.col("c_custkey") % 3).cast("int"), F.lit(5))
    balance = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    rows = c.select("c_custkey", "c_name", balance.alias("c_acctbal"), parsing.array_text(numbers).alias("overlaps"))
    path = storage.scratch(spark, "csv")
    storage.append_csv(rows.filter("c_nationkey < 12"), path)
    storage.append_csv(rows.filter("c_nationkey >= 12"), path)
    return storage.csv(spark, path, "c_custkey long, c_name string, c_acctbal double, overlaps string", overlaps=parsing.number_array)


@query("q116_tiles_window", f"WITH {views.GRID} SELECT row, col, value FROM grid WHERE row BETWEEN 13 AND 57 AND col BETWEEN 6 AND 21")
def q116(spark, d):
    """A raster in folders of tiles of 10 x 10; a window reads the tiles that it meets."""
    cells = views.grid(spark, d).withColumns({"tile_row": F.floor(F.col("row") / 10), "tile_col": F.floor(F.col("col") / 10)})
    path = storage.scratch(spark, "tiles")
    storage.write_tiles(cells, path)
    return storage.read_window(spark, path, 13, 6, 45, 16, 10).select("row", "col", "value")


@query("q117_label_records", """SELECT 'order-' || o_orderkey AS "ID", 'mask://' || o_custkey || '/' || k AS uri FROM orders, range(0, 3) t(k) WHERE o_orderkey % 4 <> 0 AND k < o_orderkey % 3 + 1""")
def q117(spark, d):
    """Nested records as JSON, without the skipped ones, a row for each object."""
    o = parquet_table(spark, d, "orders")
    uris = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")), lambda k: F.struct(F.concat(F.lit("mask://"), F.col("o_custkey").cast("string"), F.lit("/"), k.cast("string")).alias("instanceURI")))
    records = o.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("ID"), (F.col("o_orderkey") % 4 == 0).alias("Skipped"), F.struct(uris.alias("objects")).alias("Label"))
    path = storage.scratch(spark, "records")
    records.write.json(path)
    return storage.json_labels(spark, path)


@query("q118_polygons_in_box", f"""WITH {shapes.BOXES} SELECT id, CAST(nation AS BIGINT) AS nation, CAST(w * h AS DOUBLE) AS area FROM boxes WHERE x0 + w >= 200 AND x0 <= 620 AND y0 + h >= 150 AND y0 <= 480""")
def q118(spark, d):
    """Polygons as lines of GeoJSON, read back, kept with their boxes as a table (once), and searched by a box."""
    path = storage.scratch(spark, "polygons")
    storage.write_geojson(shapes.boxes(spark, d).select("id", "nation", F.get("rings", 0).alias("ring")), path)
    read = storage.geojson(spark, path, "id long, nation long", lines=True).withColumn("ring", F.get("rings", 0))
    kept = storage.write_once(read.select("id", "nation", "rings", *(c.alias(n) for n, c in geometry.bounds(F.col("ring")).items())), storage.scratch(spark, "boxes"))
    return storage.in_box(kept, 200, 150, 620, 480).select("id", "nation", geometry.polygon_area(F.col("rings")).alias("area"))


@query("q119_listed_parts", """SELECT n_nationkey AS part, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def q119(spark, d):
    """Files of many folders in one read, with a number from each file's path; listed in order without reading them."""
    path = storage.scratch(spark, "parts")
    parquet_table(spark, d, "customer").select("c_custkey", F.concat(F.lit("19"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("folder")).repartition("folder").write.partitionBy("folder").csv(path)
    paths = [r.path for r in storage.listed(spark, f"{path}/folder=*/*.csv").select("path").toLocalIterator()]  # names of files, a few for each folder
    rows = storage.csv(spark, paths, "c_custkey long", header=False).select(parsing.last_year(parsing.folder(F.col("_metadata.file_path"))).alias("year"))
    return rows.groupBy((F.col("year") - 1900).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("q120_few_drawn_tiles", f"""WITH {views.GRID}, t AS (SELECT CAST(row // 5 AS BIGINT) AS tile_row, CAST(col // 2 AS BIGINT) AS tile_col FROM grid GROUP BY ALL HAVING bool_and(value <> 0) AND count(*) = 10)
  SELECT tile_row, tile_col FROM t ORDER BY md5(concat_ws(':', '11', tile_row, tile_col)), tile_row, tile_col LIMIT 60""")  # fmt: skip
def q120(spark, d):
    """A sample of tiles without nodata: the limit is the draw."""
    return tiling.drawn_tiles(tiling.full_tiles(views.grid(spark, d), 5, 2), 60, 11).select("tile_row", "tile_col")
