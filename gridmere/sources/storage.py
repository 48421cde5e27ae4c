"""Readers and writers: typed CSV, file names as columns, JSON and GeoJSON, tiles, resumable steps, shared scratch tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing
from ..functions.scalars import null_if_nan


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str | Sequence[str], schema: str, header: bool = True, **converters: Callable[[Column], Column]) -> DataFrame:
    """Typed CSV with or without a header line. A converter makes its column from the text as it stands in the file; its
    type in the schema is then ignored. NaN becomes null."""
    fields = T.StructType.fromDDL(schema).fields
    read = T.StructType([T.StructField(f.name, T.StringType() if f.name in converters else f.dataType) for f in fields])
    df = spark.read.schema(read).csv(list(path) if not isinstance(path, str) else path, header=header)
    return null_if_nan(df.withColumns({name: make(F.col(name)) for name, make in converters.items()}) if converters else df)


def csv_two_headers(spark: SparkSession, path: str, types: dict[str, str], join: str = "_") -> DataFrame:
    """CSV whose first two lines name the columns together; those two lines are all that the driver reads."""
    first, second = (line.split(",") for line in (r.value for r in spark.read.text(path).limit(2).collect()))
    names, group = [], ""
    for a, b in zip(first, second):
        group = a.strip() or group
        names.append(join.join(x for x in (group, b.strip()) if x))
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    heads = F.lit(False)
    for line in (first, second):
        same = F.lit(True)
        for n, text in zip(names, line):
            same = same & F.coalesce(F.col(f"`{n}`"), F.lit("")).eqNullSafe(F.lit(text))
        heads = heads | same
    kept = raw.filter(~heads)
    return kept.select(*(F.col(f"`{n}`").try_cast(types[n]).alias(n) if n in types else F.col(f"`{n}`") for n in names))


def named_files(df: DataFrame, satellite: tuple[int, int] = (0, 3), year: tuple[int, int] = (4, 8)) -> DataFrame:
    """Satellite and year of each row's file, from fixed places of its name."""
    name = parsing.base_name(F.col("_metadata.file_path"))
    sat, y = parsing.satellite_year(name, satellite, year)
    return df.select("*", name.alias("file_name"), sat.alias("satellite"), y.alias("year"))


def json_labels(spark: SparkSession, path: str) -> DataFrame:
    """(ID, uri) of each label's objects, without skipped records."""
    schema = "ID string, Skipped boolean, Label struct<objects: array<struct<instanceURI: string>>>"
    records = spark.read.schema(schema).json(path)
    return records.filter(~F.coalesce("Skipped", F.lit(False))).select("ID", F.explode(F.transform("Label.objects", lambda o: o["instanceURI"])).alias("uri"))


def geojson(spark: SparkSession, path: str, properties: str = "", lines: bool = False) -> DataFrame:
    """(properties..., part, rings) of the polygons and multipolygons of a feature collection, or with `lines` of files of
    one feature a line, which can be split among tasks."""
    feature = f"properties struct<{properties or 'none: string'}>, geometry struct<type: string, coordinates: string>"
    if lines:
        features = spark.read.schema(feature).json(path).select(F.struct("properties", "geometry").alias("f"))
    else:
        features = spark.read.schema(f"features array<struct<{feature}>>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    single, multi = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    text = F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(text, single))).when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(text, multi))
    rings = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return features.select("f.properties.*", F.posexplode(parts).alias("part", "rings")).withColumn("rings", rings)


def write_geojson(polygons: DataFrame, path: str, ring: str = "ring") -> None:
    """A folder of files with one polygon feature a line; all other columns are properties."""
    names = [c for c in polygons.columns if c != ring]
    outline = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    shape = F.struct(F.lit("Polygon").alias("type"), outline.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*names).alias("properties"), shape.alias("geometry"))
    polygons.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the files that a path or pattern names, in the order of their paths; nothing of
    what they hold is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").orderBy("path")


def in_box(df: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float) -> DataFrame:
    """Rows whose box columns meet a box; plain comparisons that reach the parquet scan."""
    return df.filter((F.col("x_max") >= x_min) & (F.col("x_min") <= x_max) & (F.col("y_max") >= y_min) & (F.col("y_min") <= y_max))


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, values) of .npy files."""

    def load(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            loaded = [np.load(io.BytesIO(bytes(c)), allow_pickle=False) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "shape": [list(a.shape) for a in loaded], "values": [a.astype(float).ravel().tolist() for a in loaded]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, shape array<int>, values array<double>")


def draw(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About `rows` rows drawn with replacement."""
    count = df.count()
    return df.sample(withReplacement=True, fraction=rows / count, seed=seed) if count else df


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write unless the table is there already, and read it: a step that was done is not done again. A table is there when
    its writer has said so (_SUCCESS); what a job that died has left is written anew."""
    spark = df.sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        return spark.read.parquet(path)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def write_tiles(cells: DataFrame, path: str) -> None:
    """A raster in long form, a folder for each tile row and column."""
    cells.repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)


def read_window(spark: SparkSession, path: str, row: int, col: int, height: int, width: int, tile: int) -> DataFrame:
    """Cells of a window; only the tiles that it meets are read."""
    tiles = F.col("tile_row").between(row // tile, (row + height - 1) // tile) & F.col("tile_col").between(col // tile, (col + width - 1) // tile)
    return spark.read.parquet(path).filter(tiles & F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are not yet done: the resume step of a job that appends what it has finished or rejected."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Where a session on one machine names none (as in
    tests), a temporary one is made; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='gridmere-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone at exit
            pass


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write rows to the shared folder and read them: the lineage ends there, and lost executors lose nothing."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
