"""Rasters in tiled TIFF files: an index of tiles from the headers alone, windows as filters on the index, and tiles decoded
by the tasks that they are dealt to."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parts

# fixed values of the format: sizes of field types, and the tags that are read
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, KIND, SCALE, TIEPOINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946

INDEX = (
    "path string, band int, row long, col long, height int, width int, offset long, bytes long, "
    "tile_height int, tile_width int, samples int, dtype string, packing int, predictor int, nodata double, x0 double, y0 double, dx double, dy double"
)


def header(file) -> dict:
    """Tags of a file's first image, and its byte order, from its header and its directory."""
    start = parts.read_at(file, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    magic = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", parts.read_at(file, 8, 8))[0] if big else struct.unpack(f"{order}I", start[4:])[0]
    counts, entry, inline = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
    n = struct.unpack(order + counts, parts.read_at(file, at, struct.calcsize(order + counts)))[0]
    at += struct.calcsize(order + counts)
    width = struct.calcsize(order + entry) + inline
    table, tags = parts.read_at(file, at, n * width), {"order": order}
    for i in range(n):
        raw = table[i * width : (i + 1) * width]
        tag, kind, count = struct.unpack(order + entry, raw[:-inline])
        size = SIZES.get(kind, 1) * count
        data = raw[-inline:][:size] if size <= inline else parts.read_at(file, struct.unpack(order + ("Q" if big else "I"), raw[-inline:])[0], size)
        tags[tag] = data if kind not in CODES else struct.unpack(f"{order}{count}{CODES[kind]}", data)
    return tags


def tiles(file, path: str) -> Iterator[dict]:
    """A row of the index for each tile (or strip) of a file."""
    tags = header(file)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    height, width, samples, planar = one(HEIGHT, 0), one(WIDTH, 0), one(SAMPLES, 1), one(PLANAR, 1)
    tiled = TILES in tags
    th, tw = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    offsets, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    kind = {1: "u", 2: "i", 3: "f"}[one(KIND, 1)]
    scale, tie = tags.get(SCALE), tags.get(TIEPOINT)
    text = tags.get(NODATA, b"").split(b"\0")[0].strip()
    about = dict(
        path=path, tile_height=th, tile_width=tw, samples=samples if planar == 1 else 1, dtype=f"{tags['order']}{kind}{one(BITS, 1) // 8}",
        packing=one(COMPRESSION, 1), predictor=one(PREDICTOR, 1), nodata=float(text) if text else None,
    )
    if one(BITS, 1) % 8:
        raise ValueError(f"{path}: samples of {one(BITS, 1)} bits are not read")
    place = dict(x0=tie[3] - tie[0] * scale[0], y0=tie[4] + tie[1] * scale[1], dx=scale[0], dy=-scale[1]) if scale and tie else dict(x0=None, y0=None, dx=None, dy=None)
    across, down = -(-width // tw), -(-height // th)
    for i, (offset, size) in enumerate(zip(offsets, sizes)):
        band, rest = divmod(i, across * down)
        row, col = rest // across * th, rest % across * tw
        if size:  # a tile without bytes is all nodata
            # a strip is no longer than its rows, a tile is whole
            yield dict(about, **place, band=band, row=row, col=col, height=min(th, height - row), width=min(tw, width - col), offset=offset, bytes=size) | ({} if tiled else {"tile_height": min(th, height - row)})


def index(spark: SparkSession, path: str, suffix: str = ".tif") -> DataFrame:
    """The tiles of all files below a path: where they lie in their raster, in their file, and how they are packed."""

    def load(batches):
        import pandas as pd

        for pdf in batches:
            for name in pdf["path"]:
                with parts.opened(name) as file:
                    rows = list(tiles(file, name))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])

    return parts.found(spark, path, suffix).select("path").mapInPandas(load, INDEX)


def unpacked(data: bytes, packing: int) -> bytes:
    if packing == NONE:
        return data
    if packing in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if packing == LZW:
        return lzw(data)
    raise ValueError(f"compression {packing} is not read")


def lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first, that grow one code early; 256 clears, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def decoded(data: bytes, t) -> "numpy.ndarray":  # noqa: F821
    """(row, col, sample) of a tile."""
    import numpy as np

    values = np.frombuffer(unpacked(data, t.packing), t.dtype)[: t.tile_height * t.tile_width * t.samples].reshape(t.tile_height, t.tile_width, t.samples)
    if t.predictor == 2:
        values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
    elif t.predictor != 1:
        raise ValueError(f"predictor {t.predictor} is not read")
    return values[: t.height, : t.width]


def within(tile_index: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """Tiles that a window meets."""
    return tile_index.filter((F.col("row") < row + height) & (F.col("row") + F.col("height") > row) & (F.col("col") < col + width) & (F.col("col") + F.col("width") > col))


def cells(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, suffix: str = ".tif") -> DataFrame:
    """(path, band, row, col, value) of the files below a path; nodata and NaN are null. With a window (row, col, height,
    width), in each file, only the tiles that it meets are read and decoded. Tiles that a file leaves out have no rows."""
    chosen = index(spark, path, suffix)
    if window:
        chosen = within(chosen, *window)

    def load(batches):
        import numpy as np
        import pandas as pd

        def of(file, name, rows):
            for t in rows.itertuples():
                values = decoded(parts.read_at(file, t.offset, t.bytes), t)
                r, c, s = np.indices(values.shape).reshape(3, -1)
                value = values.astype(float).ravel()
                value[value == t.nodata] = np.nan
                yield pd.DataFrame({"path": name, "band": t.band + s, "row": t.row + r, "col": t.col + c, "value": pd.array(value, "Float64")})

        yield from parts.by_file(batches, of)

    out = parts.dealt(chosen, parts.tasks_for(parts.found(spark, path, suffix))).mapInPandas(load, "path string, band int, row long, col long, value double")
    out = out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    if window:
        row, col, height, width = window
        out = out.filter(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))
    return out


def layout(height: int, width: int, tile: int, dtype: str, nodata: float | None, place: tuple[float, float, float, float] | None) -> tuple[bytes, int]:
    """Header and directory of a file of one band whose tiles follow unpacked, and the bytes of a tile. Files that four
    bytes cannot address are written in the format's large form."""
    import numpy as np

    size = tile * tile * np.dtype(dtype).itemsize
    n = -(-height // tile) * -(-width // tile)
    big = n * size + 16 * n > 4_000_000_000
    long, kind, inline, head = ("Q", 16, 8, 16) if big else ("I", 4, 4, 8)
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [np.dtype(dtype).itemsize * 8]), (COMPRESSION, 3, [NONE]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1])]
    fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILES, kind, [0] * n), (TILE_BYTES, kind, [size] * n), (KIND, 3, [{"u": 1, "i": 2, "f": 3}[np.dtype(dtype).kind]])]
    if place:
        x0, y0, dx, dy = place
        fields += [(SCALE, 12, [dx, -dy, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, x0, y0, 0.0])]
    if nodata is not None:
        fields.append((NODATA, 2, f"{nodata!r}\0".encode()))

    def body(first: int) -> bytes:
        entry, rest, extra = b"", head + struct.calcsize("<Q" if big else "<H") + len(fields) * (4 + 2 * inline) + inline, b""
        for tag, k, values in fields:
            values = [first + i * size for i in range(n)] if tag == TILES else values
            raw = values if k == 2 else struct.pack(f"<{len(values)}{CODES[k]}", *values)
            entry += struct.pack(f"<HH{long}", tag, k, len(values))
            entry += raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack(f"<{long}", rest + len(extra))
            extra += raw + b"\0" * (len(raw) % 2) if len(raw) > inline else b""
        start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, head) if big else struct.pack("<2sHI", b"II", 42, head)
        return start + struct.pack("<Q" if big else "<H", len(fields)) + entry + b"\0" * inline + extra

    return body(len(body(0))), size


def write(cells: DataFrame, path: str, tile: int = 256, dtype: str = "<f8", nodata: float | None = None, place: tuple[float, float, float, float] | None = None) -> None:
    """A tiled file for each name of (name, row, col, value), as large as its last row and column, published together.
    Missing cells and nulls are nodata (NaN or 0 without one), of repeated cells the greatest value counts. Places of tiles
    are known beforehand, so that a file is a stream of which a task holds one tile."""
    spark = cells.sparkSession
    place = tuple(map(float, place)) if place else None
    size = cells.groupBy("name").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    keyed = cells.select("name", (F.floor(F.col("row") / tile)).alias("tr"), F.floor(F.col("col") / tile).alias("tc"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    ordered = keyed.join(size, "name").repartition("name").sortWithinPartitions("name", "tr", "tc", F.asc_nulls_first("value"))
    folder = parts.new_folder(spark, path)

    def save(batches):
        import numpy as np
        import pandas as pd

        empty = nodata if nodata is not None else np.nan if np.dtype(dtype).kind == "f" else 0
        blank = np.full((tile, tile), empty, dtype)
        at, out, done, total = None, None, 0, 0
        for (name, tr, tc), rows in parts.runs(batches, ["name", "tr", "tc"]):
            if name != at:
                if out is not None:
                    for _ in range(total - done):
                        out.write(blank.tobytes())
                    out.close()
                    yield pd.DataFrame({"attempt": [attempt], "name": [f"{at}.tif"]})
                height, width = int(rows["rows"].iloc[0]), int(rows["cols"].iloc[0])
                at, done, across = name, 0, -(-width // tile)
                total = across * -(-height // tile)
                attempt, out = parts.stream_to(folder)
                out.write(layout(height, width, tile, dtype, nodata, place)[0])
            for _ in range(int(tr * across + tc) - done):
                out.write(blank.tobytes())
            block, known = blank.copy(), rows[rows["value"].notna()]
            block[known["row"] % tile, known["col"] % tile] = known["value"]
            out.write(block.tobytes())
            done = int(tr * across + tc) + 1
        if out is not None:
            for _ in range(total - done):
                out.write(blank.tobytes())
            out.close()
            yield pd.DataFrame({"attempt": [attempt], "name": [f"{at}.tif"]})

    parts.publish(ordered.mapInPandas(save, "attempt string, name string"), folder, path)
