"""Spreadsheets: cells of workbooks as rows, and rows as items.

A workbook is a ZIP of XML parts, which the standard library reads; files come
from Spark's binary source, one task a file.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row long, col long, text string"
SCHEMA = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("text", pa.string())])
#: A sheet is read row by row; rows leave in batches of so many cells.
BATCH = 20_000
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def column_number(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def text_of(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if local(t.tag) == "t")


def cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the cells that have a value; dates as ISO."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [text_of(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(x.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        styles: list[bool] = []
        if "xl/styles.xml" in names:
            formats = next((x for x in ElementTree.fromstring(z.read("xl/styles.xml")) if local(x.tag) == "cellXfs"), ())
            styles = [int(x.get("numFmtId", 0)) in DATE_FORMATS for x in formats]
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(x.tag) == "sheet"):
            target = targets[next(v for k, v in sheet.attrib.items() if local(k) == "id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            with z.open(path) as part:
                for _, c in ElementTree.iterparse(part):
                    if local(c.tag) == "row":
                        c.clear()
                    if local(c.tag) != "c":
                        continue
                    value = next((x.text for x in c if local(x.tag) == "v"), None)
                    kind = c.get("t")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = text_of(c)
                    elif kind == "b" and value is not None:
                        value = "true" if value == "1" else "false"
                    elif kind is None and value is not None and (i := int(c.get("s", 0))) < len(styles) and styles[i]:
                        value = (dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value))).date().isoformat()
                    ref = c.get("r", "")
                    digits = re.search("[0-9]+", ref)
                    if value not in (None, "") and digits:
                        yield sheet.get("name", ""), int(digits[0]) - 1, column_number(ref), value


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks under a path. A file that is no workbook gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for cell in cells(content):
                        rows.append((name, *cell))
                        if len(rows) >= BATCH:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
                            rows = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS)


def sheet_rows(cells_: DataFrame) -> DataFrame:
    """(path, sheet, row, fields): rows below the first row of each sheet as maps by
    its headers; a column without one is ``Column_i``. Empty rows are left out."""
    first = cells_.groupBy("path", "sheet").agg(F.min("row").alias("first"))
    c = cells_.join(first, ["path", "sheet"])
    heads = c.where("row = first").select("path", "sheet", "col", F.trim("text").alias("head"))
    body = c.where("row > first").join(heads, ["path", "sheet", "col"], "left")
    head = F.coalesce(F.nullif("head", F.lit("")), F.concat(F.lit("Column_"), (F.col("col") + 1).cast("string")))
    named = body.select("path", "sheet", "row", F.struct("col", head.alias("head"), "text").alias("x"))
    g = named.groupBy("path", "sheet", "row").agg(F.array_sort(F.collect_list("x")).alias("x"))  # the cells of one row
    once = F.filter("x", lambda a, i: ~F.exists(F.slice("x", F.lit(1), i), lambda b: b["head"] == a["head"]))
    return g.select("path", "sheet", "row", F.map_from_arrays(F.transform(once, lambda a: a["head"]), F.transform(once, lambda a: a["text"])).alias("fields"))
