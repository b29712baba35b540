"""Workbooks (xlsx) as DataFrames.

A workbook is a zip of XML parts; a task reads one workbook, which has to be below Spark's limit of
2 GB for a binary file, and streams the rows of its sheets as arrays of texts. Numbers that a style
shows as dates or times become such. Columns get their names from the header row of a sheet.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import settle_table

ROWS_AT_ONCE = 10_000
CELLS = "path string, sheet_name string, sheet_index int, hidden boolean, row_number long, cells array<string>"
# The numbers of the built-in formats that show dates and times, and parts of a format that show no digits.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_UNSHOWN = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|general', re.IGNORECASE)
_LETTERS = re.compile(r"[A-Z]+")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> int:
    n = 0
    for ch in _LETTERS.match(reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _text(element: ET.Element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t.tag) == "t")


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, bool, str]]:
    """Name, whether hidden, and part of each sheet, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter():
        if _local(s.tag) == "sheet":
            key = next(v for k, v in s.attrib.items() if _local(k) == "id")
            part = targets[key].lstrip("/")
            out.append((s.get("name"), s.get("state", "visible") != "visible", part if part.startswith("xl/") else f"xl/{part}"))
    return out


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    own, styles = {}, []
    for e in ET.fromstring(z.read("xl/styles.xml")).iter():
        if _local(e.tag) == "numFmt":
            own[int(e.get("numFmtId"))] = _UNSHOWN.sub("", e.get("formatCode", "")).lower()
        elif _local(e.tag) == "cellXfs":
            styles = [int(x.get("numFmtId", 0)) for x in e]
    return {k for k, n in enumerate(styles) if n in DATE_FORMATS or set("dmyhs") & set(own.get(n, ""))}


def _moment(value: str, from_1904: bool) -> str:
    """A serial number as a date and time, or as a time where it is less than a day."""
    days = float(value)
    at = (dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)) + dt.timedelta(seconds=round(days * 86400))
    return f"{at:%H:%M:%S}" if 0 <= days < 1 else f"{at:%Y-%m-%d %H:%M:%S}"


@dataclass
class _Book:
    """What the cells of a workbook refer to."""

    shared: list[str]
    dates: set[int]
    from_1904: bool


def _cell(c: ET.Element, book: _Book) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return _text(c)
    value = next((v.text for v in c if _local(v.tag) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return book.shared[int(value)]
    if kind == "n" and int(c.get("s", 0)) in book.dates:
        return _moment(value, book.from_1904)
    return {"0": "false", "1": "true"}.get(value, value) if kind == "b" else value


def _rows(z: zipfile.ZipFile, part: str, book: _Book) -> Iterator[tuple[int, list[str | None]]]:
    number = 0
    with z.open(part) as f:
        for _, element in ET.iterparse(f):
            if _local(element.tag) != "row":
                continue
            number = int(element.get("r", number + 1))
            cells: list[str | None] = []
            for c in element:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                cells.append(_cell(c, book))
            yield number, cells
            element.clear()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CELLS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                shared = [_text(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
                book = _Book(shared, _date_styles(z), re.search(rb'date1904="(1|true)"', z.read("xl/workbook.xml")) is not None)
                for index, (sheet, hidden, part) in enumerate(_sheets(z)):
                    rows = []
                    for number, cells in _rows(z, part, book):
                        rows.append((path, sheet, index, hidden, number, cells))
                        if len(rows) == ROWS_AT_ONCE:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row of each sheet: path, sheet_name, sheet_index, hidden, row_number, cells."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_read, CELLS)


def sheet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows and columns of each sheet."""
    return read_cells(spark, path).groupBy("path", "sheet_index", "sheet_name", "hidden").agg(F.max("row_number").alias("rows"), F.max(F.size("cells")).alias("columns"))


def read_excel(spark: SparkSession, path: str, sheets: list[str] | None = None, header_row: int = 1, skip_rows: int = 0, hidden: bool = False) -> DataFrame:
    """The records of sheets, by their header rows, with `_sheet_name` and `_row_number`; hidden sheets only if asked for."""
    cells = read_cells(spark, path)
    if sheets is not None:
        cells = cells.where(F.col("sheet_name").isin(*sheets))
    if not hidden:
        cells = cells.where("NOT hidden")
    cells = settle_table(cells)  # parsed once for heads and rows
    named = F.transform("cells", lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("column_"), i + 1)))
    heads = cells.where(F.col("row_number") == header_row).select("path", "sheet_index", named.alias("_names"))
    columns = heads.select(F.col("sheet_index"), F.posexplode("_names").alias("at", "name")).groupBy("name").agg(F.min(F.struct("sheet_index", "at")).alias("o")).orderBy("o", "name")
    rows = cells.where(F.col("row_number") > header_row + skip_rows).join(heads, ["path", "sheet_index"])
    value = lambda n: F.nullif(F.trim(F.try_element_at("cells", F.nullif(F.array_position("_names", F.lit(n)), F.lit(0)).cast("int"))), F.lit(""))
    names = [r["name"] for r in columns.select("name").collect()]  # the columns of the result
    return rows.select(*(value(n).alias(n) for n in names), F.col("sheet_name").alias("_sheet_name"), F.col("row_number").alias("_row_number"))
