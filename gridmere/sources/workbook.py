"""Workbooks (.xlsx) as tables: the sheets' cells are joined to the texts they share by position, header rows become names,
and rows at the head and the tail are left out."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import parts

# fixed values of the format
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS = 1_048_576


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB3."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def column_name(number: int) -> str:
    name, number = "", number + 1
    while number:
        number, rest = divmod(number - 1, 26)
        name = chr(65 + rest) + name
    return name


def _elements(archive: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """Elements of one tag, one at a time."""
    from xml.etree.ElementTree import iterparse

    with archive.open(name) as file:
        for _, element in iterparse(file):
            if element.tag == MAIN + tag:
                yield element
                element.clear()


def _plain(element) -> str:
    """Text of a cell or shared entry, of all its runs but without readings."""
    return "".join(t.text or "" for part in element for t in ([part] if part.tag == MAIN + "t" else part.findall(MAIN + "t") if part.tag == MAIN + "r" else []))


def _rows(content: bytes, sheet: str | int) -> Iterator[tuple[int, int, str | None]]:
    """(row, col, text) of the cells of a sheet, by name or place."""
    import io
    from xml.etree.ElementTree import fromstring

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        listed = [(s.get("name"), s.get(RELATION)) for s in fromstring(archive.read("xl/workbook.xml")).iter(MAIN + "sheet")]
        chosen = listed[sheet][1] if isinstance(sheet, int) else dict(listed)[sheet]
        target = next(r.get("Target") for r in fromstring(archive.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == chosen)
        inside = target[1:] if target.startswith("/") else f"xl/{target}"
        shared = [_plain(e) for e in _elements(archive, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in archive.namelist() else []
        at = -1
        for row in _elements(archive, inside, "row"):
            at = int(row.get("r")) - 1 if row.get("r") else at + 1
            col = -1
            for c in row.findall(MAIN + "c"):
                col = column_number(c.get("r")) if c.get("r") else col + 1
                value, kind, own = c.find(MAIN + "v"), c.get("t"), c.find(MAIN + "is")
                text = _plain(own) if own is not None else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                if text is not None and kind != "e":  # errors, as #N/A, are missing
                    yield at, col, text


def cells(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """(path, row, col, text) of a sheet of every workbook below a path, counted from 0. A workbook is one task's: the format
    itself bounds its rows; workbooks run side by side."""

    def load(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                held = []
                for r in _rows(bytes(content), sheet):
                    held.append((name, *r))
                    if len(held) >= 50_000:
                        yield pd.DataFrame(held, columns=["path", "row", "col", "text"])
                        held = []
                yield pd.DataFrame(held, columns=["path", "row", "col", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(load, "path string, row int, col int, text string")


def table(spark: SparkSession, path: str, schema: str, header: int = 0, skip_tail: int = 0, sheet: str | int = 0) -> DataFrame:
    """(path, row, columns of the schema): rows below the header row (counted from 0) but for the last `skip_tail` that hold
    anything. Columns are found by the header's names in each workbook; what is absent, blank or no value of its type is null."""
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schema).fields
    all_cells = cells(spark, path, sheet).filter(F.col("text") != "")
    names = all_cells.filter(F.col("row") == header).groupBy("path", F.trim("text").alias("_name")).agg(F.min("col").alias("col"))
    body = all_cells.filter(F.col("row") > header).join(names, ["path", "col"], "left")
    wide = body.groupBy("path", "row").agg(*(F.max(F.when(F.col("_name") == f.name, F.col("text"))).alias(f.name) for f in fields))
    if skip_tail:
        # rows of one workbook, which the format bounds
        wide = wide.withColumn("_from_end", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("row")))).filter(F.col("_from_end") > skip_tail)
    return wide.select("path", "row", *(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields))


def write(rows: DataFrame, path: str, name: str = "name", order: str = "row", sheet: str = "Sheet1") -> None:
    """A workbook for each name, its rows in order and the other columns from left to right, numbers as numbers; published
    together. A task holds a batch of rows; over 1,048,576 rows are refused, as the format does."""
    from pyspark.sql import types as T

    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in (name, order)]
    numeric = [isinstance(rows.schema[c].dataType, T.NumericType) for c in columns]
    ordered = rows.select(F.col(name).cast("string").alias("_name"), F.col(order).alias("_order"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns))).repartition("_name").sortWithinPartitions("_name", "_order")
    folder = parts.new_folder(spark, path)
    kinds = "http://schemas.openxmlformats.org"
    fixed = {
        "[Content_Types].xml": f'<Types xmlns="{kinds}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="r1" Type="{kinds}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="r1" Type="{kinds}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{RELATION[1:-3]}"><sheets><sheet name="{sheet}" sheetId="1" r:id="r1"/></sheets></workbook>',
    }

    def save(batches):
        from xml.sax.saxutils import escape

        import pandas as pd

        at, archive, out, file, attempt, n = None, None, None, None, "", 0

        def closed():
            file.write(b"</sheetData></worksheet>")
            file.close()
            archive.close()
            out.close()
            return pd.DataFrame({"attempt": [attempt], "name": [f"{at}.xlsx"]})

        for pdf in batches:
            for key, some in pdf.groupby("_name", sort=False):
                if key != at:
                    if archive is not None:
                        yield closed()
                    at, n = key, 0
                    attempt, out = parts.stream_to(folder)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    for part, text in fixed.items():
                        archive.writestr(part, text)
                    file = archive.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
                    file.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                for row in some[[f"c{i}" for i in range(len(columns))]].itertuples(index=False):
                    n += 1
                    if n > MOST_ROWS:
                        raise ValueError(f"over {MOST_ROWS} rows in {key}")
                    made = []
                    for i, text in enumerate(row):
                        if isinstance(text, str):
                            place = f"{column_name(i)}{n}"
                            made.append(f'<c r="{place}"><v>{text}</v></c>' if numeric[i] else f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
                    file.write(f'<row r="{n}">{"".join(made)}</row>'.encode())
        if archive is not None:
            yield closed()

    parts.publish(ordered.mapInPandas(save, "attempt string, name string"), folder, path)
