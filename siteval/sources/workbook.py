"""Spreadsheet workbooks (.xlsx) as tables.

A workbook is a zip archive of XML parts. Spark lists and reads the files, so any store that it reaches will do; each file is opened
in the task that has it, and a sheet is parsed row by row."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteval.constants import SITES
from siteval.sources.readers import unpivot_sheet
from siteval.operators.pairing import agree_two_readers, reader_summary

#: rows that a task hands on at once
_BATCH = 1000
# Sheets and headers of the two labellers' workbook.
SHEETS = ("Labels_A", "Labels_B")
HEADERS = {"n": "#", "usable": "Usable?", "framing": "Framing", "side_conf": "Side confidence", "page_url": "Image page URL"}
HEADERS |= {f"{s}_{c}": f"{s} {c}" for s in SITES for c in ("class", "visible")}


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element) -> str:
    """All text runs below an element; phonetic notes are left out."""
    if _tag(element) == "rPh":
        return ""
    return (element.text or "" if _tag(element) == "t" else "") + "".join(_text(e) for e in element)


def _sheet_parts(archive: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> part that holds it."""
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for e in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
        if _tag(e) == "sheet":
            link = next(v for k, v in e.attrib.items() if k.endswith("}id"))
            out[e.get("name")] = posixpath.normpath(posixpath.join("xl", targets[link])) if not targets[link].startswith("/") else targets[link][1:]
    return out


def _column(place: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", place).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _cell(element, shared: list[str]) -> str | None:
    kind = element.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(e) for e in element)
    v = next((e.text for e in element if _tag(e) == "v"), None)
    if v is None:
        return None
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return "true" if v == "1" else "false"
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", v):
        return v.split(".")[0]
    return None if kind == "e" else v


def sheet_rows(content: bytes, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as lists of texts; an absent sheet has none, missing cells are None."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    part = _sheet_parts(archive).get(sheet)
    if part is None:
        return
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(_text(t) for t in e) for e in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if _tag(e) == "si"]
    with archive.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if _tag(e) == "row":
                row: list[str | None] = []
                for i, c in enumerate(x for x in e if _tag(x) == "c"):
                    at = _column(c.get("r")) if c.get("r") else i
                    row += [None] * (at + 1 - len(row))
                    row[at] = _cell(c, shared)
                yield row
                e.clear()


def read_workbook(spark: SparkSession, path, sheet: str, columns: dict[str, str]) -> DataFrame:
    """A sheet of every workbook under ``path``: file, row (1-based, under the header), one text column per (name -> header), problem.

    The first row is the header. A header that is missing gives NULLs; wholly empty rows are left out. A file that is no sound workbook gives
    one row that names the problem, so a damaged upload is seen and does not stop the rest."""
    schema = pa.schema([("file", pa.string()), ("row", pa.int64()), *((c, pa.string()) for c in columns), ("problem", pa.string())])

    def read(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                try:
                    rows = sheet_rows(content, sheet)
                    header = {h: i for i, h in reversed(list(enumerate(next(rows, []))))}
                    at = [header.get(h, -1) for h in columns.values()]
                    for n, row in enumerate(rows, 1):
                        if any(v is not None for v in row):
                            out.append((file, n, *(row[i] if 0 <= i < len(row) else None for i in at), None))
                        if len(out) == _BATCH:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                            out = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as error:
                    out.append((file, None, *(None for _ in columns), f"{type(error).__name__}: {error}"))
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, row long, " + ", ".join(f"`{c}` string" for c in columns) + ", problem string")


def read_labeller(spark: SparkSession, path, sheet: str) -> DataFrame:
    """One labeller's sheet in long form: photo, usable, site, class, visible. Rows without a photo number are left out."""
    rows = read_workbook(spark, path, sheet, HEADERS)
    return unpivot_sheet(rows.withColumn("n", F.col("n").try_cast("int")).filter("n is not null"))


def read_workbook_labels(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Agreed labels (photo, site, class…) of the two labellers of a workbook, and per photo what they keep, dispute and merely exchange."""
    agreed = agree_two_readers(*(read_labeller(spark, path, s) for s in SHEETS))
    return agreed, reader_summary(agreed)


def quarantined(spark: SparkSession, path, sheet: str = SHEETS[0]) -> DataFrame:
    """(file, problem) of the files under ``path`` that are no sound workbooks."""
    return read_workbook(spark, path, sheet, {"n": "#"}).filter("problem is not null").select("file", "problem")


def write_workbooks(rows: DataFrame, path: str, sheets=SHEETS) -> int:
    """Workbooks ``path``/part-NNNNN.xlsx from rows (part, sheet, at, cells): one file per part, the rows of a sheet in the order of ``at``. Returns their number.

    A part is one task's work, so the caller chooses parts of the size of a workbook. A task that is run again replaces its own file."""
    def write(key, table):
        from pyarrow import fs
        got = sorted(zip(table["sheet"].to_pylist(), table["at"].to_pylist(), table["cells"].to_pylist()), key=lambda r: r[:2])
        content = workbook_bytes({s: [c for name, _, c in got if name == s] for s in sheets})
        system, at = fs.FileSystem.from_uri(path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/part-{key[0].as_py():05d}.xlsx") as f:
            f.write(content)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())})

    return rows.select(F.col("part").cast("int").alias("part"), "sheet", "at", "cells").groupBy("part").applyInArrow(write, "part int").count()


def _xml(body: str) -> bytes:
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body).encode()


def _place(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook with the given sheets (rows of texts, numbers and None); texts are shared strings."""
    from xml.sax.saxutils import escape
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: dict[str, int] = {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in enumerate(sheets.values(), 1):
            lines = []
            for n, row in enumerate(rows, 1):
                cells = [f'<c r="{_place(i)}{n}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>' if isinstance(v, str) else f'<c r="{_place(i)}{n}"><v>{v}</v></c>' for i, v in enumerate(row) if v is not None]
                lines.append(f'<row r="{n}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", _xml(f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>'))
        names = "".join(f'<sheet name="{escape(s)}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", _xml(f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>'))
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", _xml(f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'))
        strings = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared)
        z.writestr("xl/sharedStrings.xml", _xml(f'<sst xmlns="{main}">{strings}</sst>'))
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", _xml(f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                                              f'<Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>'))
    return out.getvalue()
