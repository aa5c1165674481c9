"""Workbooks as a Spark data source: ``spark.read.format("workbook")`` and ``df.write.format("workbook")`` after :func:`register`.

Reading. A partition is a range of bytes of the unpacked first sheet of one file, and owns the rows that begin in it. Its task unpacks the sheet as a
stream, passes over what lies before, and parses only its own rows, so neither a sheet nor its XML stands in memory; a workbook's shared texts do. All
columns are texts; every file is read by its own heading. Files of a folder, of a pattern in the last part of the path, or one file; names that begin with
``_`` or ``.`` are passed over. A heading cell without text is called ``Unnamed: i``, cells beyond the heading are dropped, missing ones are null. A sheet
without rows gives none.

Writing. Every task streams its rows into workbooks of at most ``ROWS_PER_FILE`` rows under a hidden name; the commit renames them, so retried or lost
tasks leave nothing that is read. Nulls are absent cells, numbers and booleans keep their kind, other values are written as texts. Letters that XML cannot hold are
written as ``_xHHHH_``. An empty table gives one workbook with a heading, if it has a partition.

Files are opened through ``pyarrow.fs`` (local and shared folders, hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

RANGE_BYTES = 32 << 20
ROWS_PER_FILE = 1_000_000
CHUNK_BYTES, BATCH_ROWS = 1 << 20, 2_000

# Names of the parts of a workbook and their namespaces.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
SHEET = "xl/worksheets/sheet1.xml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                           f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/{SHEET}" ContentType="{KIND}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="rows" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}

_ROW = re.compile(rb"<(?:[\w.-]+:)?row(?=[\s/>])")
_END = re.compile(rb"</(?:[\w.-]+:)?sheetData>")
_ROOT = re.compile(rb"<(?:[\w.-]+:)?worksheet[^>]*>")
_CODE = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNSAFE = re.compile("[\x00-\x08\x0b\x0c\r\x0e-\x1f\ud800-\udfff￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


# ---- files


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"[A-Za-z][\w+.-]+:/", path) and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def files_of(path: str) -> list[str]:
    fs, inner = opened(path)
    lead = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    base, _, last = inner.rpartition("/")
    wanted = "*"
    if any(c in last for c in "*?["):
        inner, wanted = base, last
    elif fs.get_file_info(inner).type == pafs.FileType.File:
        return [lead + inner]
    found = [f for f in fs.get_file_info(pafs.FileSelector(inner or "/")) if f.type == pafs.FileType.File]
    return sorted(lead + f.path for f in found if fnmatch.fnmatchcase(f.base_name, wanted) and f.base_name[0] not in "_.")


def first_sheet(book: zipfile.ZipFile) -> zipfile.ZipInfo:
    sheets = [(int(m[1]), n) for n in book.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))]
    if not sheets:
        raise ValueError("a workbook without sheets")
    return book.getinfo(min(sheets)[1])


# ---- rows of a sheet


def decoded(text: str) -> str:
    return _CODE.sub(lambda m: chr(int(m[1], 16)), text)


def row_pieces(stream, begin: int, end: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """(start tag of the sheet, XML of rows) in portions, for rows that begin at begin <= byte < end of the stream; the first row counts as byte 0."""
    held, at, root, rows = b"", 0, None, []  # ``at`` is the place of held[0]
    over = seen = False
    while not over:
        more = stream.read(CHUNK_BYTES)
        held += more
        if root is None:
            found = _ROOT.search(held)
            if not found:
                if not more:
                    return
                continue
            root = found[0]
        starts = [m.start() for m in _ROW.finditer(held)]
        last = _END.search(held)
        stop = last.start() if last else len(held) if not more else None
        if stop is not None:
            starts = [s for s in starts if s < stop] + [stop]
            over = True
        for low, high in zip(starts, starts[1:]):
            place, seen = at + low if seen else 0, True
            if place >= end:
                over = True
                break
            if place >= begin:
                rows.append(held[low:high])
                if len(rows) >= BATCH_ROWS:
                    yield root, rows
                    rows = []
        if starts and seen and at + starts[-1] >= end:
            over = True
        keep = starts[-1] if starts else max(0, len(held) - 256)  # a tag's beginning may stand at the end of the chunk
        held, at = held[keep:], at + keep
    if rows:
        yield root, rows


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def texts_of(cell) -> str:
    """All text of a cell or shared item but its phonetic hints."""
    out = []
    for part in cell:
        name = local(part.tag)
        if name == "t":
            out.append(part.text or "")
        elif name in ("r", "is"):
            out.append(texts_of(part))
    return "".join(out)


def column_of(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        index = index * 26 + ord(letter) - 64
    return index - 1


def cells_of(root: bytes, rows: list[bytes], shared: list[str]) -> Iterator[list[str | None]]:
    name = re.match(rb"<([^\s>/]+)", root)[1]
    for row in ElementTree.fromstring(root + b"".join(rows) + b"</" + name + b">"):
        out: list[str | None] = []
        for cell in row:
            if local(cell.tag) != "c":
                continue
            at = column_of(cell.get("r")) if cell.get("r") else len(out)
            out += [None] * (at + 1 - len(out))
            kind, value = cell.get("t"), next((c.text for c in cell if local(c.tag) == "v"), None)
            if kind == "inlineStr":
                value = decoded(texts_of(cell))
            elif value is not None and kind == "s":
                value = shared[int(value)]
            elif value is not None and kind == "b":
                value = "true" if value == "1" else "false"
            elif value is not None and kind == "str":
                value = decoded(value)
            out[at] = value
        yield out


def shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if local(node.tag) == "si":
                out.append(decoded(texts_of(node)))
                node.clear()
    return out


def heading(path: str) -> tuple[list[str], int] | None:
    """Column names of a file and the size of its unpacked sheet; None without rows."""
    fs, inner = opened(path)
    with fs.open_input_file(inner) as raw, zipfile.ZipFile(raw) as book:
        info = first_sheet(book)
        with book.open(info) as stream:
            for root, rows in row_pieces(stream, 0, info.file_size + 1):
                first = next(cells_of(root, rows[:1], shared_texts(book)))
                return [c if c is not None else f"Unnamed: {i}" for i, c in enumerate(first)], info.file_size
    return None


# ---- the source


@dataclass
class SheetRange(InputPartition):
    path: str
    begin: int
    end: int


class WorkbookReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.names = [f.name for f in schema.fields]
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.paths = json.loads(options["paths"]) if "paths" in options else files_of(options["path"])

    def partitions(self):
        out = []
        for path in self.paths:
            fs, inner = opened(path)
            with fs.open_input_file(inner) as raw, zipfile.ZipFile(raw) as book:  # the directory at the end of the file alone
                size = first_sheet(book).file_size
            out += [SheetRange(path, low, min(low + self.size, size)) for low in range(0, max(size, 1), self.size)]
        return out

    def read(self, partition: SheetRange):
        head = heading(partition.path)
        if head is None:
            return
        if sorted(head[0]) != sorted(self.names):
            raise ValueError(f"{partition.path} has other columns than {self.names}")
        order = [head[0].index(n) for n in self.names]
        fs, inner = opened(partition.path)
        with fs.open_input_file(inner) as raw, zipfile.ZipFile(raw) as book:
            shared, skip = shared_texts(book), partition.begin == 0
            with book.open(first_sheet(book)) as stream:
                for root, pieces in row_pieces(stream, partition.begin, partition.end):
                    rows = list(cells_of(root, pieces, shared))
                    if skip:
                        rows, skip = rows[1:], False
                    columns = [pa.array([r[k] if k < len(r) else None for r in rows], pa.string()) for k in order]
                    yield pa.RecordBatch.from_arrays(columns, self.names)


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list[str]


def cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) or isinstance(value, float) and value - value == 0:
        return f"<c><v>{value!r}</v></c>"
    text = _UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value)).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, rows_per_file: int):
        self.path, self.names, self.overwrite, self.rows = path, [f.name for f in schema.fields], overwrite, rows_per_file

    def write(self, iterator) -> WrittenFiles:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        names: list[str] = []
        rows = (r for batch in iterator for r in zip(*(c.to_pylist() for c in batch.columns)))
        ahead = next(rows, None)
        while ahead is not None or not names:
            name = f"part-{uuid.uuid4().hex}.xlsx"
            names.append(name)
            with fs.open_output_stream(f"{folder}/_{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
                for part, text in PARTS.items():
                    book.writestr(part, HEAD + text)
                with book.open(SHEET, "w", force_zip64=True) as out:
                    out.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{self.row(self.names)}'.encode())
                    written = 0
                    while ahead is not None and written < self.rows:
                        out.write(self.row(ahead).encode())
                        written, ahead = written + 1, next(rows, None)
                    out.write(b"</sheetData></worksheet>")
        return WrittenFiles(names)

    @staticmethod
    def row(values) -> str:
        return f"<row>{''.join(map(cell, values))}</row>"

    def commit(self, messages) -> None:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        fresh = [n for m in messages if m is not None for n in m.names]
        old = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".xlsx") and not f.base_name.startswith("_")] if self.overwrite else []
        for name in fresh:
            fs.move(f"{folder}/_{name}", f"{folder}/{name}")
        for f in old:
            fs.delete_file(f.path)

    def abort(self, messages) -> None:
        fs, folder = opened(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            fs.delete_file(f"{folder}/_{name}")


class WorkbookSource(DataSource):
    """Options: ``path``, or ``paths`` as a JSON list; ``rangeBytes`` of a partition; ``rowsPerFile`` when writing."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        for path in json.loads(self.options["paths"]) if "paths" in self.options else files_of(self.options["path"]):
            if head := heading(path):
                return StructType([StructField(n, StringType()) for n in head[0]])
        raise ValueError("no rows in any workbook")

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], schema, overwrite, int(self.options.get("rowsperfile", ROWS_PER_FILE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
