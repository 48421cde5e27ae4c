"""Polygons in shapefiles: ranges of records from the index file, boxes tested before outlines are decoded, and a writer of
many files by place, whose own boxes tell readers which to leave out."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry
from . import parts

POLYGON, HEAD = 5, 100  # fixed values of the format: the type of polygons, bytes of the headers
RING = "array<struct<x: double, y: double>>"
#: Bytes of records in a range, and about in a written file.
RANGE_BYTES, FILE_BYTES = 4 << 20, 32 << 20


def _beside(path: str, suffix: str) -> str:
    return path[: path.rindex(".")] + suffix


def ranges(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(path, offset, bytes, first, records): runs of records of about RANGE_BYTES, from the index files (.shx). Files
    whose own box does not meet the box have none."""

    def load(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name in pdf["path"]:
                with parts.opened(name) as file:
                    x0, y0, x1, y1 = struct.unpack("<4d", parts.read_at(file, 36, 32))
                if box and not (x1 >= box[0] and x0 <= box[2] and y1 >= box[1] and y0 <= box[3]):
                    continue
                with parts.opened(_beside(name, ".shx")) as file:
                    entries = np.frombuffer(parts.read_at(file, HEAD, file.size() - HEAD), ">i4").reshape(-1, 2).astype(np.int64) * 2
                if not len(entries):
                    continue
                ends = entries.sum(axis=1) + 8
                group = (entries[:, 0] - HEAD) // RANGE_BYTES
                first = np.flatnonzero(np.diff(group, prepend=-1))
                last = np.append(first[1:], len(entries))
                offset = entries[first, 0]
                yield pd.DataFrame({"path": name, "offset": offset, "bytes": np.maximum.reduceat(ends, first) - offset, "first": first, "records": last - first})

    return parts.found(spark, path, ".shp").select("path").mapInPandas(load, "path string, offset long, bytes long, first long, records long")


def outlines(record: bytes) -> list | None:
    """Rings of a polygon's record (also with z or m, which are left out), None for an empty shape."""
    import numpy as np

    kind = struct.unpack_from("<i", record)[0]
    if kind == 0:
        return None
    if kind % 10 != POLYGON:
        raise ValueError(f"shapes of type {kind} are not read")
    n, corners = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{n}i", record, 44), corners]
    xy = np.frombuffer(record, "<f8", 2 * corners, 44 + 4 * n).reshape(-1, 2)
    return [[{"x": x, "y": y} for x, y in xy[a:b].tolist()] for a, b in zip(starts, starts[1:])]


def polygons(spark: SparkSession, path: str, schema: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(path, record, fields of the schema, rings) of the polygons below a path. With a box (x_min, y_min, x_max, y_max),
    files outside it are not opened beyond their headers, and outlines outside it not decoded. Rings come as they stand:
    outlines clockwise, holes the other way. Fields are read by name (of ten letters) from the table beside, cast from
    its text, null where they are blank or absent; records that are marked as deleted stay, as their shapes do."""
    fields = T.StructType.fromDDL(schema).fields
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("record", T.LongType()), *(T.StructField(f.name, T.StringType()) for f in fields)]).add("rings", T._parse_datatype_string(f"array<{RING}>"))

    def load(batches):
        import pandas as pd

        def of(file, name, rows):
            with parts.opened(_beside(name, ".dbf")) as table:
                head, width = struct.unpack("<HH", parts.read_at(table, 8, 4))
                described, places, at = parts.read_at(table, 32, head - 32), {}, 1
                for i in range(0, len(described) - 31, 32):
                    if described[i] == 0x0D:
                        break
                    places[described[i : i + 11].split(b"\0")[0].decode().lower()] = (at, described[i + 16])
                    at += described[i + 16]
                for r in rows.itertuples():
                    data, texts = parts.read_at(file, r.offset, r.bytes), parts.read_at(table, head + r.first * width, r.records * width)
                    at, found = 0, []
                    for k in range(r.records):
                        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
                        record, at = memoryview(data)[at + 8 : at + 8 + size], at + 8 + size
                        if box:
                            if size < 36:
                                continue
                            x0, y0, x1, y1 = struct.unpack_from("<4d", record, 4)
                            if not (x1 >= box[0] and x0 <= box[2] and y1 >= box[1] and y0 <= box[3]):
                                continue
                        row = texts[k * width : (k + 1) * width]
                        values = [row[p : p + n].decode(errors="replace").strip() or None for p, n in (places.get(f.name[:10].lower(), (0, 0)) for f in fields)]
                        found.append((name, r.first + k, *values, outlines(record)))
                    yield pd.DataFrame(found, columns=out.names)

        yield from parts.by_file(batches, of)

    dealt = parts.dealt(ranges(spark, path, box), parts.tasks_for(parts.found(spark, path, ".shp")))
    return dealt.mapInPandas(load, out).select("path", "record", *(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields), "rings")


def _record(number: int, rings) -> tuple[bytes, tuple | None]:
    """A polygon's record and box; a shape without rings is empty."""
    if not rings:
        return struct.pack(">2i", number, 2) + struct.pack("<i", 0), None
    corners = [(p["x"], p["y"]) for ring in rings for p in ring]
    starts, at = [], 0
    for ring in rings:
        starts.append(at)
        at += len(ring)
    xs, ys = zip(*corners)
    box = (min(xs), min(ys), max(xs), max(ys))
    body = struct.pack("<i4d2i", POLYGON, *box, len(rings), at) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{2 * at}d", *(v for c in corners for v in c))
    return struct.pack(">2i", number, len(body) // 2) + body, box


def curve(gx: Column, gy: Column, bits: int = 20) -> Column:
    """Place of a square on a curve that keeps neighbours together: the bits of both numbers in turn."""
    place = F.lit(0).cast("long")
    for shift, number in ((0, gx), (1, gy)):
        n = (number + (1 << (bits - 1))).cast("long")
        for i in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(n, i).bitwiseAND(F.lit(1)), 2 * i + shift))
    return place


def write(shapes: DataFrame, path: str, side: float, rings: str = "rings", width: int = 32, file_bytes: int = FILE_BYTES) -> None:
    """Shapefiles of polygons with numbers and texts as fields, published together. Polygons are dealt in ranges of the
    curve through the squares of their boxes' corners, in files of about `file_bytes`, so that a file's own box is small; a
    task holds one file. Rings are turned as the format wants them: the first of a polygon clockwise and those after it, its holes, the other way. Texts beyond
    `width` bytes are refused; names keep ten letters."""
    spark = shapes.sparkSession
    names = [c for c in shapes.columns if c != rings]
    texts = [F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(names)]
    low = geometry.bounds(F.get(rings, 0))
    at = curve(F.floor(low["x_min"] / side), F.floor(low["y_min"] / side))
    by_place = shapes.select(*texts, F.col(rings).alias("rings"), at.alias("at")).repartitionByRange("at").sortWithinPartitions("at")
    numeric = [isinstance(shapes.schema[c].dataType, T.NumericType) for c in names]
    digits = [0 if isinstance(shapes.schema[c].dataType, T.IntegralType) or not n else 15 for c, n in zip(names, numeric)]
    short = [c[:10] for c in names]
    if len({c.lower() for c in short}) < len(short):
        raise ValueError(f"names are not distinct in ten letters: {names}")
    folder = parts.new_folder(spark, path)

    def trio(rows):
        """Bytes of the three files of some rows."""
        import uuid

        shp, shx, dbf, boxes = bytearray(), bytearray(), bytearray(), []
        for number, r in enumerate(rows, 1):
            turned = [_turned([(p["x"], p["y"]) for p in ring], i == 0) for i, ring in enumerate(r["rings"] or [])]
            record, box = _record(number, [[{"x": a, "y": b} for a, b in ring] for ring in turned])
            shx += struct.pack(">2i", (HEAD + len(shp)) // 2, (len(record) - 8) // 2)
            shp += record
            if box:
                boxes.append(box)
            dbf += b" "
            for i in range(len(names)):
                text = (r[f"f{i}"] or "").encode()
                if len(text) > width:
                    raise ValueError(f"a text of {len(text)} bytes in {names[i]}")
                dbf += text.rjust(width) if numeric[i] else text.ljust(width)
        whole = [f(b[i] for b in boxes) if boxes else 0.0 for i, f in enumerate((min, min, max, max))]
        heads = [struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (HEAD + len(body)) // 2) + struct.pack("<2i8d", 1000, POLYGON, *whole, 0, 0, 0, 0) for body in (shp, shx)]
        described = b"".join(struct.pack("<11sc4xBB14x", short[i].encode(), b"N" if numeric[i] else b"C", width, digits[i]) for i in range(len(names)))
        table = struct.pack("<BBBBIHH20x", 3, 100, 1, 1, len(rows), 33 + len(described), 1 + width * len(names)) + described + b"\r"
        name = f"part-{uuid.uuid4().hex}"
        for body, suffix in ((bytes(heads[1] + shx), ".shx"), (table + bytes(dbf) + b"\x1a", ".dbf"), (bytes(heads[0] + shp), ".shp")):
            attempt, out = parts.stream_to(folder)
            with out:
                out.write(body)
            yield attempt, name + suffix

    def save(batches):
        import pyarrow as pa

        def files(rows):
            return pa.RecordBatch.from_pylist([{"attempt": a, "name": n} for a, n in trio(rows)])

        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                size += 16 * sum(map(len, r["rings"] or [])) + 60
                if size >= file_bytes:
                    yield files(held)
                    held, size = [], 0
        if held:
            yield files(held)

    parts.publish(by_place.mapInArrow(save, "attempt string, name string"), folder, path)


def _turned(ring: list[tuple[float, float]], clockwise: bool) -> list[tuple[float, float]]:
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    return ring if (twice <= 0) == clockwise else ring[::-1]
