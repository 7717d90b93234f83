"""A Python data source for workbooks: ``spark.read.format("xlsx")``, one row a cell row.

A folder or a file of .xlsx is read as (path, sheet, row, cells): the sheet's
name, the row's number from 1 and its cells as strings by position, rich text
flattened. One partition a workbook; a workbook is opened where it is read.
Paths are opened on the executors and must be mounted there; for other stores
read the bytes with ``binaryFile`` and use ``workbook_rows``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, sheet string, row int, cells array<string>"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_rows(body: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook's bytes; missing cells are empty strings."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[sheet.get(_REL)]
            tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            for number, row in enumerate(tree.iter(f"{_NS}row"), 1):
                cells: list[str] = []
                for place, c in enumerate(row.iter(f"{_NS}c")):
                    at = _column(c.get("r")) if c.get("r") else place
                    cells += [""] * (at + 1 - len(cells))
                    value = c.find(f"{_NS}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else {"1": "true", "0": "false"}[value.text] if c.get("t") == "b" else value.text or ""
                yield sheet.get("name"), int(row.get("r") or number), cells


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of inline strings; None is an empty cell."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            rows = "".join(f'<row r="{r}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{esc("" if v is None else v)}</t></is></c>' for v in row) + "</row>" for r, row in enumerate(sheets[n], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


class _Workbook(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*.xlsx"))) if os.path.isdir(self.path) else [self.path]
        return [_Workbook(p) for p in found]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for sheet, row, cells in workbook_rows(f.read()):
                yield partition.path, sheet, row, cells


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) through Spark's own file reader, so from any store that it reads."""
    @F.udtf(returnType="sheet string, row int, cells array<string>")
    class Rows:
        def eval(self, content: bytes):
            yield from workbook_rows(content)

    spark.udtf.register("workbook_rows", Rows)
    spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).createOrReplaceTempView("_workbooks")
    return spark.sql("SELECT path, r.sheet, r.row, r.cells FROM _workbooks, LATERAL workbook_rows(content) AS r")
