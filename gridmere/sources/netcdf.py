"""Grid cubes in NetCDF classic files: headers give each time step's place in its file, and tasks read the steps they are
dealt."""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parts

# fixed values of the format: types by number, tags of the header's lists
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


class Header:
    """Dimensions, variables and attributes of a file of the classic format (with offsets of 32 or 64 bits, or large counts)."""

    def __init__(self, file):
        self.file, self.at = file, 4
        magic = parts.read_at(file, 0, 4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.count, self.place = (">Q" if magic[3] == 5 else ">I"), (">I" if magic[3] == 1 else ">Q")
        records = self._number()
        self.dims = [(self._name(), self._number()) for _ in range(self._list(DIMENSIONS))]
        self.attributes = self._attributes()
        self.variables = {}
        for _ in range(self._list(VARIABLES)):
            name = self._name()
            dims = [self._number() for _ in range(self._number())]
            attributes, kind, size = self._attributes(), self._read(">I"), self._number()
            self.variables[name] = dict(dims=dims, attributes=attributes, dtype=TYPES[kind], begin=self._read(self.place), moving=bool(dims) and self.dims[dims[0]][1] == 0)
        moving = [v for v in self.variables.values() if v["moving"]]
        # steps of one variable alone are not padded
        self.stride = self.slab(moving[0]) if len(moving) == 1 else sum(-(-self.slab(v) // 4) * 4 for v in moving)
        if records == (1 << (64 if self.count == ">Q" else 32)) - 1 and moving:  # the writer did not say: as many as the file holds
            records = (file.size() - min(v["begin"] for v in moving)) // self.stride
        self.records = records

    def _read(self, form: str) -> int:
        raw = parts.read_at(self.file, self.at, struct.calcsize(form))
        self.at += len(raw)
        return struct.unpack(form, raw)[0]

    def _number(self) -> int:
        return self._read(self.count)

    def _bytes(self, size: int) -> bytes:
        raw = parts.read_at(self.file, self.at, size)
        self.at += -(-size // 4) * 4
        return raw

    def _name(self) -> str:
        return self._bytes(self._number()).decode()

    def _list(self, tag: int) -> int:
        found, n = self._read(">I"), self._number()
        if found not in (0, tag):
            raise ValueError("a NetCDF header is not in order")
        return n

    def _attributes(self) -> dict:
        import numpy as np

        out = {}
        for _ in range(self._list(ATTRIBUTES)):
            name, kind, n = self._name(), self._read(">I"), self._number()
            raw = self._bytes(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode() if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out

    def length(self, dim: int) -> int:
        return self.dims[dim][1] or self.records

    def slab(self, v: dict) -> int:
        """Bytes of a variable at one step of its first dimension."""
        import numpy as np

        size = np.dtype(v["dtype"]).itemsize
        for d in v["dims"][1:]:
            size *= self.dims[d][1]
        return size

    def steps(self, name: str) -> list[tuple[int, int]]:
        """(offset, bytes) of each step of a variable's first dimension."""
        v = self.variables[name]
        size = self.slab(v)
        stride = self.stride if v["moving"] else size
        return [(v["begin"] + k * stride, size) for k in range(self.length(v["dims"][0]))]

    def coordinate(self, dim: int) -> list[float]:
        """Values of a dimension's own variable, or its numbers where there is none."""
        import numpy as np

        name, n = self.dims[dim][0], self.length(dim)
        if name not in self.variables:
            return [float(i) for i in range(n)]
        return [float(np.frombuffer(parts.read_at(self.file, at, size), self.variables[name]["dtype"])[0]) for at, size in self.steps(name)]


INDEX = "path string, step int, time double, date date, offset long, bytes long"


def _days(units: str) -> tuple[str, float] | None:
    """First day and days of a unit, of units such as `hours since 1900-01-01`."""
    said = re.match(r"(day|hour|minute|second)s?\s+since\s+(\d{1,4}-\d{1,2}-\d{1,2})", units)
    return said and (said[2], {"day": 1.0, "hour": 1 / 24, "minute": 1 / 1440, "second": 1 / 86400}[said[1]])


def index(spark: SparkSession, path: str, variable: str, suffix: str = ".nc") -> DataFrame:
    """A row for each file and time step of a variable (time, y, x): the step's time, its date where the unit names days,
    hours, minutes or seconds since a day, and its place in the file."""

    def load(batches):
        import pandas as pd

        for pdf in batches:
            for name in pdf["path"]:
                with parts.opened(name) as file:
                    head = Header(file)
                    v = head.variables[variable]
                    if len(v["dims"]) != 3:
                        raise ValueError(f"{variable} has {len(v['dims'])} dimensions, not time, y, x")
                    times, places = head.coordinate(v["dims"][0]), head.steps(variable)
                    own = head.variables.get(head.dims[v["dims"][0]][0])
                    unit = _days(str(own["attributes"].get("units", ""))) if own else None
                dates = [(pd.Timestamp(unit[0]) + pd.Timedelta(days=t * unit[1]) + pd.Timedelta(milliseconds=1)).date() if unit else None for t in times]
                yield pd.DataFrame({"path": name, "step": range(len(times)), "time": times, "date": dates, "offset": [a for a, _ in places], "bytes": [b for _, b in places]})

    return parts.found(spark, path, suffix).select("path").mapInPandas(load, INDEX)


def cube(spark: SparkSession, path: str, variable: str, times: tuple[float, float] | None = None, dates: tuple[str, str] | None = None, suffix: str = ".nc") -> DataFrame:
    """(path, time, date, row, col, y, x, value) of a variable in all files below a path, as one cube; values are unscaled,
    and fill values and NaN are null. Steps outside `times` or `dates` (ends included) are not read."""
    chosen = index(spark, path, variable, suffix)
    if times:
        chosen = chosen.filter(F.col("time").between(*times))
    if dates:
        chosen = chosen.filter(F.col("date").between(*(F.lit(d).cast("date") for d in dates)))

    def load(batches):
        import numpy as np
        import pandas as pd

        def of(file, name, rows):
            head = Header(file)
            v = head.variables[variable]
            about = v["attributes"]
            y, x = (np.array(head.coordinate(d)) for d in v["dims"][1:])
            fills = [f for key in ("_FillValue", "missing_value") for f in about.get(key, [])]
            for s in rows.itertuples():
                raw = np.frombuffer(parts.read_at(file, s.offset, s.bytes), v["dtype"]).reshape(len(y), len(x))
                value = np.where(np.isin(raw, fills), np.nan, raw.astype(float)) * about.get("scale_factor", [1.0])[0] + about.get("add_offset", [0.0])[0]
                r, c = np.indices(raw.shape).reshape(2, -1)
                yield pd.DataFrame({"path": name, "time": s.time, "date": s.date, "row": r, "col": c, "y": y[r], "x": x[c], "value": value.ravel()})

        yield from parts.by_file(batches, of)

    size = parts.tasks_for(parts.found(spark, path, suffix))
    read = parts.dealt(chosen, size).mapInPandas(load, "path string, time double, date date, row int, col int, y double, x double, value double")
    return read.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def layout(variable: str, steps: int, y: list[float], x: list[float], units: str) -> bytes:
    """Header and coordinates of a file with records of a time and a grid of doubles."""
    dims = [("time", 0), ("y", len(y)), ("x", len(x))]
    unit = struct.pack(">II", ATTRIBUTES, 1) + _text("units") + struct.pack(">I", 2) + _text(units)
    none = struct.pack(">II", 0, 0)
    named = [("y", [1], none), ("x", [2], none), ("time", [0], unit), (variable, [0, 1, 2], none)]
    sizes = [8 * len(y), 8 * len(x), 8, 8 * len(y) * len(x)]

    def body(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">III", steps, DIMENSIONS, len(dims)) + b"".join(_text(n) + struct.pack(">I", k) for n, k in dims) + none + struct.pack(">II", VARIABLES, len(named))
        for (name, ids, attributes), size, begin in zip(named, sizes, begins):
            out += _text(name) + struct.pack(f">I{len(ids)}I", len(ids), *ids) + attributes + struct.pack(">IIQ", 6, min(size, (1 << 32) - 1), begin)
        return out

    begins = [len(body([0] * 4))]
    for size in sizes[:-1]:
        begins.append(begins[-1] + size)
    return body(begins) + struct.pack(f">{len(y) + len(x)}d", *y, *x)


def write(cells: DataFrame, path: str, variable: str, units: str, y: tuple[float, float] = (0.0, 1.0), x: tuple[float, float] = (0.0, 1.0)) -> None:
    """A file for each name of (name, time, row, col, value), with its times in order as records, published together.
    Coordinates are first values and steps. Missing cells are NaN, of repeated ones the greatest counts; a task holds one
    step of a file."""
    spark = cells.sparkSession
    size = cells.groupBy("name").agg(F.countDistinct("time").alias("steps"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    keyed = cells.select("name", F.col("time").cast("double").alias("time"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    ordered = keyed.join(size, "name").repartition("name").sortWithinPartitions("name", "time", F.asc_nulls_first("value"))
    folder = parts.new_folder(spark, path)

    def save(batches):
        import numpy as np
        import pandas as pd

        at, out, attempt = None, None, ""
        for (name, time), rows in parts.runs(batches, ["name", "time"]):
            if name != at:
                if out is not None:
                    out.close()
                    yield pd.DataFrame({"attempt": [attempt], "name": [f"{at}.nc"]})
                steps, height, width = (int(rows[c].iloc[0]) for c in ("steps", "rows", "cols"))
                at = name
                attempt, out = parts.stream_to(folder)
                out.write(layout(variable, steps, [y[0] + y[1] * i for i in range(height)], [x[0] + x[1] * i for i in range(width)], units))
            grid = np.full((height, width), np.nan, ">f8")
            grid[rows["row"], rows["col"]] = rows["value"]
            out.write(struct.pack(">d", time) + grid.tobytes())
        if out is not None:
            out.close()
            yield pd.DataFrame({"attempt": [attempt], "name": [f"{at}.nc"]})

    parts.publish(ordered.mapInPandas(save, "attempt string, name string"), folder, path)
