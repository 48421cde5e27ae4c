"""Files of other programs' formats: bytes made by hand from the formats' descriptions, round trips, and reads that leave out."""

import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmere.sources import netcdf, parts, shapefile, tiff, workbook


def packed_lzw(data: bytes) -> bytes:
    """An encoder by the format's text: the table grows with each code, codes widen when entry 511, 1023 or 2047 is made."""
    codes, table, width, word = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    size = 258
    for i in range(len(data)):
        letter = data[i : i + 1]
        if word + letter in table:
            word += letter
            continue
        codes.append((table[word], width))
        table[word + letter] = size
        size += 1
        if size - 1 in (511, 1023, 2047):
            width += 1
        if size == 4095:
            codes.append((256, width))
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        word = letter
    if word:
        codes.append((table[word], width))
        size += 1
        if size - 1 in (511, 1023, 2047):
            width += 1
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def a_tiff(values, order="<", packing=1, tile=None, planar=1, predictor=1, big=False, spoilt=()):
    """Bytes of a file of (row, col, sample) values, in tiles or in strips of three rows."""
    height, width, samples = values.shape
    th, tw = (tile, tile) if tile else (3, width)
    planes = [values] if planar == 1 else [values[:, :, [s]] for s in range(samples)]
    blocks = []
    for plane in planes:
        for r in range(0, height, th):
            for c in range(0, width, tw):
                block = plane[r : r + th, c : c + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = block.astype(values.dtype.newbyteorder(order)).tobytes()
                blocks.append(raw if packing == 1 else zlib.compress(raw) if packing == 8 else packed_lzw(raw))
    head = 16 if big else 8
    data, offsets = b"", []
    for i, b in enumerate(blocks):
        offsets.append(head + len(data))
        data += b"\xff" * len(b) if i in spoilt else b
    at = head + len(data)
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [values.dtype.itemsize * 8] * samples), (259, 3, [packing]), (277, 3, [samples]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kind] * samples)]
    tags += [(322, 4, [tw]), (323, 4, [th]), (324, 4, offsets), (325, 4, [len(b) for b in blocks])] if tile else [(273, 4, offsets), (278, 4, [th]), (279, 4, [len(b) for b in blocks])]
    tags.sort()
    inline, long, entry = (8, "Q", "HHQ") if big else (4, "I", "HHI")
    rest = at + (8 if big else 2) + len(tags) * (4 + 2 * inline) + inline
    body, extra = b"", b""
    for tag, k, v in tags:
        raw = struct.pack(f"{order}{len(v)}{'H' if k == 3 else 'I'}", *v)
        body += struct.pack(order + entry, tag, k, len(v)) + (raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack(order + long, rest + len(extra)))
        extra += raw if len(raw) > inline else b""
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return start + data + struct.pack(order + ("Q" if big else "H"), len(tags)) + body + b"\0" * inline + extra


def as_array(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["row"], r["col"], r["band"]] = np.nan if r["value"] is None else r["value"]
    return out


def test_lzw_by_the_formats_example_and_round_trips():
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    bits += "0" * (-len(bits) % 8)
    assert tiff.lzw(int(bits, 2).to_bytes(len(bits) // 8, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"ab" * 9000, bytes(rng.integers(0, 256, 30_000, dtype=np.uint8)), bytes(rng.integers(0, 3, 60_000, dtype=np.uint8))):
        assert tiff.lzw(packed_lzw(data)) == data


@pytest.mark.parametrize("kw", [{}, {"packing": 5, "tile": 16}, {"packing": 8, "tile": 16, "planar": 2}, {"order": ">", "packing": 5}, {"tile": 16, "big": True, "order": ">"}, {"predictor": 2, "packing": 8, "tile": 16}])
@pytest.mark.parametrize("dtype", ["u1", "i2", "f4"])
def test_tiff_forms(spark, tmp_path, kw, dtype):
    if kw.get("predictor") == 2 and dtype == "f4":
        return
    values = np.arange(20 * 37 * 2).reshape(20, 37, 2).astype(dtype)
    (tmp_path / "a.tif").write_bytes(a_tiff(values, **kw))
    assert (as_array(tiff.cells(spark, str(tmp_path)).collect(), values.shape) == values).all()


def test_window_reads_only_its_tiles(spark, tmp_path):
    """Tiles outside the window are spoilt: reading one would fail."""
    values = np.arange(64 * 64).reshape(64, 64, 1).astype("i2")
    wanted = {5, 6, 9, 10}  # rows and columns 16 to 47 of 4 x 4 tiles
    (tmp_path / "a.tif").write_bytes(a_tiff(values, packing=8, tile=16, spoilt=set(range(16)) - wanted))
    window = (20, 30, 20, 10)
    assert tiff.within(tiff.index(spark, str(tmp_path)), *window).count() == 4
    got = tiff.cells(spark, str(tmp_path), window).collect()
    assert sorted((r["row"], r["col"], r["value"]) for r in got) == [(r, c, float(r * 64 + c)) for r in range(20, 40) for c in range(30, 40)]
    with pytest.raises(Exception):
        tiff.cells(spark, str(tmp_path)).collect()


def test_tiff_written(spark, tmp_path):
    rows = [("a", 0, 0, 1.5), ("a", 33, 20, 2.0), ("a", 33, 20, 7.0), ("a", 5, 5, None), ("b", 2, 1, -4.0)]
    df = spark.createDataFrame(rows, "name string, row long, col long, value double")
    path = str(tmp_path / "out")
    tiff.write(df, path, tile=16, nodata=-9.0, place=(-50, -10, 0.25, -0.25))
    got = {(r["path"].split("/")[-1], r["row"], r["col"]): r["value"] for r in tiff.cells(spark, path).collect()}
    assert len(got) == 34 * 21 + 3 * 2
    assert {k: v for k, v in got.items() if v is not None} == {("a.tif", 0, 0): 1.5, ("a.tif", 33, 20): 7.0, ("b.tif", 2, 1): -4.0}
    place = tiff.index(spark, path).select("x0", "y0", "dx", "dy", "nodata").distinct().collect()
    assert [tuple(r) for r in place] == [(-50.0, -10.0, 0.25, -0.25, -9.0)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["_SUCCESS", "a.tif", "b.tif"]
    tiff.write(df.filter("name = 'b'"), path, tile=16)  # again, over what is there
    assert tiff.cells(spark, path).filter(F.col("path").endswith("b.tif")).filter("value is not null").count() == 1
    empty = str(tmp_path / "none")
    tiff.write(df.filter("row < 0"), empty)
    assert tiff.cells(spark, empty).count() == 0


def test_large_form_is_laid_out_alike():
    head, size = tiff.layout(40_000, 40_000, 256, "<f4", None, None)
    assert head[2:4] == struct.pack("<H", 43) and size == 256 * 256 * 4
    file = __import__("io").BytesIO(head)
    tags = tiff.header(file)
    assert tags[tiff.WIDTH] == (40_000,) and tags[tiff.TILES][0] == len(head) and tags[tiff.TILES][-1] == len(head) + (157 * 157 - 1) * size


def test_cube_by_hand(spark, tmp_path):
    """Two record variables of other types, so that records are padded; scaled shorts with a fill value; streamed count."""

    def text(s):
        return struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    def head(begins, records):
        out = b"CDF\x01" + struct.pack(">III", records, 10, 3) + text("time") + struct.pack(">I", 0) + text("lat") + struct.pack(">I", 3) + text("lon") + struct.pack(">I", 1) + struct.pack(">II", 0, 0)
        out += struct.pack(">II", 11, 3)
        out += text("time") + struct.pack(">II", 1, 0) + struct.pack(">II", 12, 1) + text("units") + struct.pack(">I", 2) + text("days since 2001-03-01 00:00") + struct.pack(">III", 4, 4, begins[0])
        out += text("lat") + struct.pack(">II", 1, 1) + struct.pack(">II", 0, 0) + struct.pack(">III", 5, 12, begins[1])
        out += text("rain") + struct.pack(">IIII", 3, 0, 1, 2) + struct.pack(">II", 12, 3) + text("scale_factor") + struct.pack(">IId", 6, 1, 0.5) + text("add_offset") + struct.pack(">IId", 6, 1, 10.0) + text("_FillValue") + struct.pack(">IIhh", 3, 1, -1, 0)
        return out + struct.pack(">III", 3, 8, begins[2])

    fixed = len(head([0] * 3, 0))
    begins = [fixed + 12, fixed, fixed + 16]
    records = b"".join(struct.pack(">i3hxx", t, *v) for t, v in ((0, (1, 2, -1)), (31, (4, 5, 6)), (61, (7, -1, 9))))
    for name, count in (("a.nc", 3), ("b.nc", (1 << 32) - 1)):
        (tmp_path / name).write_bytes(head(begins, count) + struct.pack(">3f", -1.5, 0.0, 1.5) + records)
    for name in "ab":
        got = netcdf.cube(spark, str(tmp_path / f"{name}.nc"), "rain").collect()
        want = [(d, y, x, v) for d, vs in (("2001-03-01", (10.5, 11.0, None)), ("2001-04-01", (12.0, 12.5, 13.0)), ("2001-05-01", (13.5, None, 14.5))) for (y, x), v in zip(((-1.5, 0.0), (0.0, 0.0), (1.5, 0.0)), vs)]
        assert sorted(((str(r["date"]), r["y"], r["x"], r["value"]) for r in got), key=str) == sorted(want, key=str)
    assert {str(r["date"]) for r in netcdf.cube(spark, str(tmp_path), "rain", dates=("2001-04-01", "2001-04-30")).collect()} == {"2001-04-01"}
    # steps outside are not read: the file ends before them
    whole = (tmp_path / "a.nc").read_bytes()
    (tmp_path / "a.nc").write_bytes(whole[: begins[0] + 2 * 12 + 4])  # its last values are gone, its times are not
    assert netcdf.cube(spark, str(tmp_path / "a.nc"), "rain", times=(0, 40)).count() == 6
    with pytest.raises(Exception):
        netcdf.cube(spark, str(tmp_path / "a.nc"), "rain").collect()


def test_cube_written(spark, tmp_path):
    rows = [("x", 10.0, 0, 0, 1.0), ("x", 3.0, 1, 2, 2.0), ("x", 3.0, 1, 2, None), ("y", 5.0, 0, 1, 4.0)]
    netcdf.write(spark.createDataFrame(rows, "name string, time double, row long, col long, value double"), str(tmp_path / "c"), "v", "days since 2000-01-01", y=(5, -1), x=(2, 2))
    got = netcdf.cube(spark, str(tmp_path / "c"), "v").collect()
    assert len(got) == 2 * 6 + 2
    assert sorted((str(r["date"]), r["y"], r["x"], r["value"]) for r in got if r["value"] is not None) == [("2000-01-04", 4.0, 6.0, 2.0), ("2000-01-06", 5.0, 4.0, 4.0), ("2000-01-11", 5.0, 2.0, 1.0)]


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in (*corners, corners[0])]


def test_shapes_round_trip_and_files_left_out(spark, tmp_path):
    square = lambda i: ring((100 * i, 0), (100 * i + 10, 0), (100 * i + 10, 10), (100 * i, 10))
    hole = lambda i: ring((100 * i + 2, 2), (100 * i + 4, 2), (100 * i + 4, 4))
    rows = [(i, f"n{i}" if i % 2 else None, i / 4, [square(i), hole(i)]) for i in range(40)] + [(99, "no shape", None, [])]
    df = spark.createDataFrame(rows, "id long, name string, share double, rings array<array<struct<x: double, y: double>>>")
    path = str(tmp_path / "s")
    shapefile.write(df, path, 100.0, file_bytes=1000)
    got = {r["id"]: r for r in shapefile.polygons(spark, path, "id long, name string, share double, absent string").collect()}
    assert set(got) == {*range(40), 99} and got[99]["rings"] is None and got[99]["name"] == "no shape"
    for i in range(40):
        assert (got[i]["name"], got[i]["share"], got[i]["absent"]) == (f"n{i}" if i % 2 else None, i / 4, None)
        assert [sorted({(p["x"], p["y"]) for p in r}) for r in got[i]["rings"]] == [sorted({(p["x"], p["y"]) for p in r}) for r in (square(i), hole(i))]
        turns = [sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:])) for r in got[i]["rings"]]
        assert turns[0] < 0 < turns[1]
    box = (195.0, 5.0, 305.0, 6.0)
    found = shapefile.polygons(spark, path, "id long", box)
    assert sorted(r["id"] for r in found.collect()) == [2, 3]
    # files whose own box is elsewhere are not opened beyond it
    met = {r["path"] for r in shapefile.ranges(spark, path, box).collect()}
    others = {r["path"] for r in parts.found(spark, path, ".shp").collect()} - met
    assert met and others
    for name in others:
        file = name.removeprefix("file:")
        with open(file, "r+b") as f:
            f.truncate(100)
        with open(file[:-4] + ".shx", "r+b") as f:
            f.truncate(101)
    assert sorted(r["id"] for r in shapefile.polygons(spark, path, "id long", box).collect()) == [2, 3]
    with pytest.raises(Exception):
        shapefile.write(df.withColumn("name", F.repeat(F.lit("x"), 40)), str(tmp_path / "t"), 100.0)


def test_records_in_ranges(spark, tmp_path):
    """A file larger than a range is cut between records, each of which is read once."""
    corners = [(k, k * k) for k in range(3000)]
    rows = spark.range(200).select("id", F.array(F.transform(F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in (*corners[:40], corners[0]))), lambda p: F.struct((p["x"] + F.col("id")).alias("x"), p["y"].alias("y")))).alias("rings"))
    many = rows.select((F.col("id") * 50).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("k"), "rings").select((F.col("id") + F.col("k")).alias("id"), "rings")
    shapefile.write(many, str(tmp_path / "s"), 1e9)
    cut = shapefile.ranges(spark, str(tmp_path / "s")).collect()
    assert len(cut) > 1 and sum(r["records"] for r in cut) == 10_000
    got = shapefile.polygons(spark, str(tmp_path / "s"), "id long").select("id", F.array_min(F.transform(F.get("rings", 0), lambda p: p["x"])).alias("x"), F.size(F.get("rings", 0)).alias("n"))
    assert got.filter((F.col("x") == F.floor(F.col("id") / 50)) & (F.col("n") == 41)).select("id").distinct().count() == 10_000 == got.count()


def test_workbook_by_hand(spark, tmp_path):
    """Shared texts with runs and readings, cells without places, errors, a second sheet."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="x1"/><sheet name="Two" sheetId="2" r:id="x2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Type="t" Target="worksheets/s1.xml"/><Relationship Id="x2" Type="t" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>code</t></si><si><r><t>val</t></r><r><t>ue</t></r><rPh><t>no</t></rPh></si><si><t>m1</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>title</t></is></c></row><row r="3"><c r="A3" t="s"><v>0</v></c><c r="AB3" t="s"><v>1</v></c></row><row r="4"><c r="A4" t="s"><v>2</v></c><c r="AB4"><f>1+1</f><v>2</v></c></row><row r="5"><c r="A5" t="s"><v>2</v></c><c r="AB5" t="e"><v>#N/A</v></c></row><row r="9"><c r="A9"><v>5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {main}><sheetData><row><c><v>1</v></c><c><v>2</v></c></row><row><c><v>3</v></c></row></sheetData></worksheet>")
    got = workbook.table(spark, str(tmp_path), "code string, value int, absent string", header=2, skip_tail=1).orderBy("row").collect()
    assert [tuple(r)[1:] for r in got] == [(3, "m1", 2, None), (4, "m1", None, None)]
    assert sorted(tuple(r)[1:] for r in workbook.cells(spark, str(tmp_path), "Two").collect()) == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3")]
    assert [workbook.column_number(workbook.column_name(i) + "1") for i in (0, 25, 26, 701, 702, 16383)] == [0, 25, 26, 701, 702, 16383]


def test_workbook_written(spark, tmp_path):
    rows = [("b1", 2, "a < b & c", 1.5), ("b1", 1, None, -2.0), ("b2", 1, "x", None)]
    workbook.write(spark.createDataFrame(rows, "name string, row int, text string, number double"), str(tmp_path / "w"))
    with zipfile.ZipFile(tmp_path / "w" / "b1.xlsx") as z:
        assert z.testzip() is None
    got = workbook.cells(spark, str(tmp_path / "w")).select(parts.stem(F.col("path")), "row", "col", "text").collect()
    assert sorted(map(tuple, got)) == [("b1", 0, 1, "-2.0"), ("b1", 1, 0, "a < b & c"), ("b1", 1, 1, "1.5"), ("b2", 0, 0, "x")]
