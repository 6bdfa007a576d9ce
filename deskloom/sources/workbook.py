"""Uploaded ticket workbooks (.xlsx), many files in parallel.

A workbook is a zip archive that cannot be split, and its sheet holds at most 1,048,576 rows, so
one task per file is bounded by the format. Rows leave the task in batches.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.operators.schema_ops import header_field

FIELDS = (
    "store_name",
    "contact_number",
    "email",
    "subject",
    "reported_concern",
    "assigned_to",
    "status",
    "service_done",
    "labor_fee",
)
_SCHEMA = "file string, row_num bigint, " + ", ".join(f"{f} string" for f in FIELDS) + ", error string"
_ARROW = pa.schema(
    [("file", pa.string()), ("row_num", pa.int64()), *[(f, pa.string()) for f in FIELDS], ("error", pa.string())]
)
_BATCH = 10_000

# Namespaces of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _text(node: ET.Element) -> str:
    """Text of a plain or rich string, without phonetic runs."""
    parts = [t.text or "" for t in node.findall(f"{_MAIN}t")]
    parts += [t.text or "" for r in node.findall(f"{_MAIN}r") for t in r.findall(f"{_MAIN}t")]
    return "".join(parts)


def _active_sheet(book: zipfile.ZipFile) -> str:
    """Path of the active sheet inside the archive."""
    root = ET.fromstring(book.read("xl/workbook.xml"))
    view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    active = int(view.get("activeTab", "0")) if view is not None else 0
    wanted = root.findall(f"{_MAIN}sheets/{_MAIN}sheet")[active].get(f"{_REL}id")
    for rel in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == wanted:
            target = rel.get("Target", "")
            return target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
    raise ValueError("active sheet not found")


def _column(reference: str) -> int:
    number = 0
    for ch in reference:
        if not ch.isalpha():
            break
        number = number * 26 + ord(ch.upper()) - ord("A") + 1
    return number - 1


def _value(cell: ET.Element, shared: list[str]) -> str | None:
    """The cell as text; numeric zero, false and empty text count as no value."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return (_text(inline) if inline is not None else "") or None
    node = cell.find(f"{_MAIN}v")
    if node is None or node.text is None:
        return None
    if kind == "s":
        return shared[int(node.text)] or None
    if kind == "b":
        return "True" if node.text == "1" else None
    if kind in ("str", "e"):
        return node.text or None
    number = float(node.text)
    if number == 0:
        return None
    return str(int(number)) if number.is_integer() and "e" not in node.text.lower() else str(number)


def _rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """Row number and cell texts of the active sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for _, node in ET.iterparse(part):
                    if node.tag == f"{_MAIN}si":
                        shared.append(_text(node))
                        node.clear()
        with book.open(_active_sheet(book)) as part:
            number = 0
            for _, row in ET.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[str | None] = []
                for cell in row.findall(f"{_MAIN}c"):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at + 1 - len(cells)))
                    cells[at] = _value(cell, shared)
                yield number, cells
                row.clear()


def _decode(file: str, content: bytes) -> Iterator[dict]:
    header: list[str] | None = None
    for number, cells in _rows(content):
        if header is None:
            header = [header_field(c) if c else "" for c in cells] if number == 1 else []
            if number == 1:
                continue
        if not any(cells):
            continue
        record: dict = {"file": file, "row_num": number}
        for name, value in zip(header, cells):
            if name in FIELDS:
                record[name] = value
        yield record


def _decode_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"]):
            path, rows = file.as_py(), []
            try:
                for record in _decode(path, content.as_py()):
                    rows.append(record)
                    if len(rows) >= _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
            except Exception as problem:  # a broken file is refused, the others go on
                rows.append({"file": path, "row_num": 0, "error": f"Error reading Excel file: {problem}"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def decode_workbooks(files: DataFrame) -> DataFrame:
    """Rows of workbooks given as (path, content)."""
    return files.select("path", "content").mapInArrow(_decode_files, _SCHEMA)


def read_ticket_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Data rows of all .xlsx files below ``path``, with the file's error if it cannot be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return decode_workbooks(files.select(F.col("path"), F.col("content")))
