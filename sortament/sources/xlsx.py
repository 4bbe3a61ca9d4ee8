"""Workbooks as cells, and cells as workbooks, with nothing but zip and XML.

Reading is distributed over files; each workbook is parsed in one task, as its format
demands. ``.xls`` is not supported: no reader for it is installed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortament.session import ship_package

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "file string, sheet string, sheet_ix int, row_no int, cells array<struct<v:string,is_num:boolean>>"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(index: int) -> str:
    """0 is A, 26 is AA."""
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def read_workbook(content: bytes) -> Iterator[tuple[str, int, int, list[tuple[str | None, bool]]]]:
    """(sheet, sheet_ix, row_no, [(value, is number)]) of all rows that hold a cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in root.iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for ix, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            for row in ElementTree.fromstring(z.read(path)).iter(f"{_MAIN}row"):
                cells: list[tuple[str | None, bool]] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [(None, False)] * (at - len(cells))
                    kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    cells.append((value, kind == "n" and value is not None))
                yield sheet.get("name"), ix, int(row.get("r") or 0), cells


def price_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, path, length, readable) of the workbooks directly in a folder, by name
    whatever the case; Office's lock files are none. Old workbooks (``.xls``) are listed
    but not readable. A folder that doesn't exist raises."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")  # contents aren't read
    named = files.withColumn("file", F.url_decode(F.regexp_replace(F.regexp_extract("path", r"[^/]+$", 0), r"\+", "%2B")))
    books = named.where(F.lower("file").rlike(r"\.xlsx?$") & ~F.col("file").startswith("~$"))
    return books.select("file", "path", "length", F.lower("file").endswith(".xlsx").alias("readable")).orderBy(F.lower("file"), "file")


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the workbooks directly in a folder, without Office's lock files."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!~]*.[xX][lL][sS][xX]").load(folder).select("path", "content")

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                rows = [(name, s, ix, n, [{"v": v, "is_num": m} for v, m in cells]) for s, ix, n, cells in read_workbook(content)]
                yield pd.DataFrame(rows, columns=["file", "sheet", "sheet_ix", "row_no", "cells"])

    return files.mapInPandas(parse, SCHEMA)


def safe_sheet_name(name: str) -> str:
    """Without the signs that a sheet's name may not have, at most 31 long."""
    return re.sub(r"[\[\]:*?/\\]", "_", name).strip("'")[:31] or "Sheet"


def write_workbook(path: str, sheets: dict[str, Iterable[Iterable[object]]], *, autofilter: bool = True) -> None:
    """A workbook on the driver from rows of each sheet, first the header; numbers stay
    numbers. Rows are consumed as they come, so ``DataFrame.toLocalIterator`` can feed it."""
    names = [safe_sheet_name(n) for n in sheets]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _MAIN[1:-1], _REL[1:-1]
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>',
        )
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            width = count = 0
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for count, row in enumerate(rows, 1):
                    cells = []
                    for c, value in enumerate(row):
                        width = max(width, c + 1)
                        at = f"{column_name(c)}{count}"
                        if value is None:
                            continue
                        if isinstance(value, bool) or not isinstance(value, (int, float)) and not hasattr(value, "as_tuple"):
                            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
                        else:
                            cells.append(f'<c r="{at}"><v>{value}</v></c>')
                    out.write(f'<row r="{count}">{"".join(cells)}</row>'.encode())
                out.write(b"</sheetData>")
                if autofilter and width and count:
                    out.write(f'<autoFilter ref="A1:{column_name(width - 1)}{count}"/>'.encode())
                out.write(b"</worksheet>")


def free_name(folder_names: set[str], base: str, suffix: str) -> str:
    """``base`` or ``base2``, ``base3``..., the first that isn't taken, of safe letters."""
    clean = re.sub(r'[<>:"/\\|?*\x00-\x1f]+', "_", base).strip(" ._") or "result"
    name, n = f"{clean}{suffix}", 2
    while name in folder_names:
        name, n = f"{clean}{n}{suffix}", n + 1
    return name
