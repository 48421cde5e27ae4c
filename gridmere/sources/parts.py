"""Files that are read and written by parts: found by Spark, opened at an offset by tasks, published when a job is done.

Tasks open files by their own file system clients: shared local folders, and the stores that pyarrow knows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files that one task is to read.
TASK_BYTES = 32 << 20


def located(path: str):
    """File system and name of a path as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    where, name = located(path)
    return where.open_input_file(name)


def read_at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) < size:
        raise ValueError(f"a file ends before {offset + size}")
    return data


def found(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, length) of the files with a suffix below a path; nothing of what they hold is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "length")


def tasks_for(files: DataFrame) -> int:
    """Number of tasks that read files of this total length."""
    return max(1, min(math.ceil((files.agg(F.sum("length")).first()[0] or 0) / TASK_BYTES), 100_000))


def dealt(ranges: DataFrame, tasks: int) -> DataFrame:
    """Ranges (path, offset, ...) among tasks: neighbours in a file mostly together, a large file to many."""
    return ranges.repartition(tasks, "path", F.floor(F.col("offset") / (TASK_BYTES // 4)))


def by_file(batches: Iterator, read: Callable) -> Iterator:
    """read(file, path, rows of the ranges) for each file of a task, opened once."""
    for pdf in batches:
        for path, rows in pdf.sort_values(["path", "offset"]).groupby("path", sort=False):
            with opened(path) as file:
                yield from read(file, path, rows)


def new_folder(spark: SparkSession, path: str) -> str:
    """A folder for the files of one job, in the one where they are to be, as a full name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_temporary-{uuid.uuid4().hex}")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    return system.makeQualified(where).toString()


def stream_to(folder: str):
    """(name, open output) of a new file; each attempt of a task has its own."""
    where, base = located(folder)
    name = uuid.uuid4().hex
    return f"{folder}/{name}", where.open_output_stream(f"{base}/{name}")


def publish(written: DataFrame, folder: str, path: str) -> None:
    """Run the job that writes files and returns (attempt, name), and give the files of the attempts that counted their
    names; others go. The driver gets the names alone. Readers that ask for _SUCCESS see all of the files or none."""
    spark = written.sparkSession
    names = written.select("attempt", "name").collect()
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    doubled = {n for n, k in _counts(r["name"] for r in names).items() if k > 1}
    if doubled:
        raise ValueError(f"files written twice: {sorted(doubled)[:3]}")
    for r in names:
        system.delete(of(f"{path}/{r['name']}"), False)
        if not system.rename(of(r["attempt"]), of(f"{path}/{r['name']}")):
            raise OSError(f"cannot name {r['name']}")
    system.delete(of(folder), True)
    system.create(of(f"{path}/_SUCCESS")).close()


def _counts(names) -> dict[str, int]:
    out: dict[str, int] = {}
    for n in names:
        out[n] = out.get(n, 0) + 1
    return out


def stem(path: Column) -> Column:
    """A file's name without its folder and suffix."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def runs(batches: Iterator, keys: list[str]) -> Iterator:
    """(key, frame) of consecutive rows with equal keys, joined across the batches of sorted rows."""
    import pandas as pd

    at, held = None, []
    for pdf in batches:
        for key, rows in pdf.groupby(keys, sort=False):
            if key != at and held:
                yield at, pd.concat(held, ignore_index=True)
                held = []
            at = key
            held.append(rows)
    if held:
        yield at, pd.concat(held, ignore_index=True)
