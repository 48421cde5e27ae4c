"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task holds decoded at a time; it bounds the Python workers' memory.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000

_written: list[tuple[SparkSession, str]] = []


#: What empties each operator's cached model in this Python worker, and the operator whose task ran last.
_caches: dict[str, Callable[[], None]] = {}
_holder: list[str] = []


def cached(owner: str, empty: Callable[[], None]) -> None:
    """Tell how to empty an operator's cache."""
    _caches[owner] = empty


def hold(owner: str) -> None:
    """Called where a task begins: a worker, which Spark uses for one stage after another, keeps the model of one operator at
    a time. At a change all caches are emptied, and what they took is given back to the system."""
    if _holder and _holder[0] != owner:
        for empty in _caches.values():
            empty()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    _holder[:] = [owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids give null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def is_fold(column: str, modulus: int, remainder: int) -> Column:
    """True for ids of that remainder; null ids belong to no fold and give false."""
    return F.coalesce(id_remainder(column, modulus) == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='gridmere-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _discard_all() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the session may be gone at exit
            pass


atexit.register(_discard_all)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridmere-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


#: Removes a query's shuffle files when it ends. Else they stay until the driver's heap is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one job. Within it, a query's shuffle files go when it ends, and the tables when they are discarded,
    or at its own end, so that the disk holds what is still to be read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        return self

    def __exit__(self, *_: object) -> None:
        self.discard()
        self.spark.conf.set(CLEANUP, self.before)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, name)
        self.paths.append(path)
        return table

    def discard(self) -> None:
        while self.paths:
            path = self.paths.pop()
            discard(self.spark, path)
            _written[:] = [x for x in _written if x[1] != path]


def slices(lengths: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose lengths sum to the limit at most; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts are long, and both sides hold whole batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[list, list], list]], limit: int = SLICE_BYTES) -> DataFrame:
    """Map (key, text as bytes) rows, a bounded slice at a time.

    df's last column is the text as binary; the others are passed to the function as lists, in order. make() runs once
    in each task; the function that it returns gets those lists and gives the output columns as lists or arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(make.__module__)
        fn = make()
        for batch in batches:
            sizes = pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_pylist()
            for start, end in slices(sizes, limit):
                part = batch.slice(start, end - start)
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    return df.mapInArrow(run, schema)
