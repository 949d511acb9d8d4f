"""Workbooks (Office Open XML) as a data source: a partition for each sheet, rows as positional cells.

A workbook is a ZIP of XML files. A sheet's file is parsed piece by piece, so a task holds the workbook's shared strings and some rows at a time. Files are opened by Arrow's file systems,
so a path may be a URI of any of them.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, row int, cells array<string>"
ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
ROWS_AT_A_TIME = 1000
#: Rows and columns of a sheet, at most, by the format.
MOST_ROWS, MOST_COLUMNS = 1 << 20, 1 << 14
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PARTS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _ended(source, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end, each forgotten afterwards."""
    for _, element in ElementTree.iterparse(source):
        if _name(element) == name:
            yield element
            element.clear()


def _text(element: ElementTree.Element) -> str:
    """The text of all runs of a string, without its phonetic hints."""
    hints = {t for e in element.iter() if _name(e) == "rPh" for t in e.iter()}
    return "".join(t.text or "" for t in element.iter() if _name(t) == "t" and t not in hints)


def column_of(reference: str) -> int:
    """The place of a cell's column, from 0: A is 0, AA is 26."""
    place = 0
    for c in reference:
        if not c.isalpha():
            break
        place = place * 26 + ord(c.upper()) - 64
    return place - 1


def letters_of(column: int) -> str:
    out, column = "", column + 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


class Sheet(InputPartition):
    def __init__(self, path: str, sheet: str, member: str):
        self.path, self.sheet, self.member = path, sheet, member


def sheets(path: str) -> list[Sheet]:
    """A workbook's sheets, in order."""
    system, inside = _open(path)
    with system.open_input_file(inside) as source, zipfile.ZipFile(source) as book:
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _name(e) == "sheet"]
        members = [targets[e.get(f"{{{PARTS}}}id")] for e in found]
    return [Sheet(path, e.get("name"), m.lstrip("/") if m.startswith("/") else f"xl/{m}") for e, m in zip(found, members, strict=True)]


def _value(cell: ElementTree.Element, shared: Sequence[str]) -> str | None:
    kind, value = cell.get("t"), next((e.text for e in cell if _name(e) == "v"), None)
    if kind == "inlineStr":
        return _text(cell)
    if value is None:
        return None
    return shared[int(value)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}.get(value, value) if kind == "b" else value


def rows_of(sheet: Sheet) -> Iterator[tuple[int, list[str | None]]]:
    """(row, cells) of a sheet from row 1 on; rows that the file leaves out have no cells."""
    system, inside = _open(sheet.path)
    with system.open_input_file(inside) as source, zipfile.ZipFile(source) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as strings:
                shared = [_text(e) for e in _ended(strings, "si")]
        last = 0
        with book.open(sheet.member) as data:
            for row in _ended(data, "row"):
                number, cells = int(row.get("r") or last + 1), []
                for cell in row:
                    at = column_of(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells)) + [_value(cell, shared)]
                yield from ((n, []) for n in range(last + 1, number))
                yield number, cells
                last = number


class WorkbookReader(DataSourceReader):
    def __init__(self, paths: Sequence[str]):
        self.paths = paths

    def partitions(self) -> Sequence[InputPartition]:
        return [s for p in self.paths for s in sheets(p)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        name, held = re.split(r"[/\\]", partition.path)[-1], []

        def batch() -> pa.RecordBatch:
            columns = [[name] * len(held), [partition.sheet] * len(held), [n for n, _ in held], [c for _, c in held]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)

        for row in rows_of(partition):
            held.append(row)
            if len(held) == ROWS_AT_A_TIME:
                yield batch()
                held.clear()
        if held:
            yield batch()


class WorkbookSource(DataSource):
    """``paths``: one workbook in a line."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader([p for p in self.options.get("paths", self.options.get("path", "")).split("\n") if p])


def workbook_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, sheet, row, cells) of all sheets of workbooks. Numbers are as they are stored, and so are dates, as numbers of days."""
    spark.dataSource.register(WorkbookSource)
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format("workbook").option("paths", "\n".join(paths)).load()


def _part(name: str, body: str) -> tuple[str, str]:
    return name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{body}'


def _xml(text: str) -> str:
    """Text without what XML can't hold."""
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text))


def _write(path: str, by_sheet: dict[str, list[tuple[int, list[str | None]]]]) -> None:
    system, inside = _open(path)
    with system.open_output_stream(inside, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = list(by_sheet)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        parts = [
            _part("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>'),
            _part("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{PARTS}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
            _part("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{PARTS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>"),
            _part("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{PARTS}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>"),
        ]
        for name, body in parts:
            book.writestr(name, body)
        for i, name in enumerate(names, 1):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as sheet:
                sheet.write(_part("", f'<worksheet xmlns="{MAIN}"><sheetData>')[1].encode())
                for row, cells in sorted(by_sheet[name]):
                    told = "".join(f'<c r="{letters_of(k)}{row}" t="inlineStr"><is><t xml:space="preserve">{_xml(c)}</t></is></c>' for k, c in enumerate(cells) if c is not None)
                    sheet.write(f'<row r="{row}">{told}</row>'.encode())
                sheet.write(b"</sheetData></worksheet>")


def write_workbooks(rows: DataFrame, folder: str) -> list[str]:
    """Write rows (file, sheet, row, cells) as a workbook for each file, all cells as texts; returns the paths. A workbook is one task's work, and a sheet has MOST_ROWS rows at most.

    Each attempt writes a file of its own, and only what a finished task reports counts."""

    def write(table: pa.Table) -> pa.Table:
        by_sheet: dict[str, list] = {}
        for sheet, row, cells in zip(*(table.column(c).to_pylist() for c in ("sheet", "row", "cells")), strict=True):
            if not 0 < row <= MOST_ROWS or len(cells or []) > MOST_COLUMNS:
                raise ValueError(f"row {row} of {len(cells or [])} cells doesn't fit a sheet")
            by_sheet.setdefault(sheet, []).append((row, cells or []))
        path = f"{folder}/{uuid.uuid4().hex}/{table.column('file')[0].as_py()}"
        system, inside = _open(path)
        system.create_dir(inside.rpartition("/")[0], recursive=True)
        _write(path, dict(sorted(by_sheet.items())))
        return pa.table({"path": pa.array([path], pa.string())})

    return sorted(r.path for r in rows.groupBy("file").applyInArrow(write, "path string").collect())
