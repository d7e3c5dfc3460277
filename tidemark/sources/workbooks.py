"""Spreadsheet workbooks as a Spark data source: each task writes workbooks of its own and reads them one row at a time.

A workbook is a zip of XML parts. Rows go to the sheet as they come, with their texts in the cells, so neither side holds a
sheet. A cell holds at most 32,767 UTF-16 units; longer texts go on in continuation rows, which have no key.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from io import TextIOWrapper
from xml.etree import ElementTree
from xml.sax.saxutils import escape
from zipfile import ZIP_DEFLATED, BadZipFile, ZipFile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import scalars as S
from . import store

CELL = 32_767  # UTF-16 units of a cell
ROWS = 900_000  # of a sheet's 1,048,576: the rest is room for the last record's continuation rows
EXACT = 1 << 53  # numbers beyond are written as text
COMMIT = "committed.json"

# Namespaces and content types of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
DATE_STYLES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

_BARE = "\x00-\x08\x0b-\x1f￾￿"
_UNFIT = re.compile(f"_(?=x[0-9A-Fa-f]{{4}}[_{_BARE}])|[{_BARE}]")  # an underscore that would start a code, too
_CODED = re.compile("_x([0-9A-Fa-f]{4})_")


class WorkbookRefused(ValueError):
    """A workbook, or a row of it, that is not as agreed."""


def to_cell(text: str) -> str:
    """A text as the content of a cell: what XML cannot hold, and what looks like such a code, is coded."""
    return escape(_UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def from_cell(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text)


def column_name(at: int) -> str:
    """Letters of a column counted from 0."""
    out = ""
    at += 1
    while at:
        at, r = divmod(at - 1, 26)
        out = chr(65 + r) + out
    return out


def column_at(cell: str) -> int:
    """The column, from 0, of a cell's name like ``AB12``."""
    n = 0
    for ch in cell.rstrip("0123456789"):
        n = n * 26 + ord(ch) - 64
    return n - 1


def serial(day: date) -> int:
    """A day's number; the format counts a 29 February 1900, so only later days have a plain one."""
    return (day - date(1899, 12, 30)).days


def serial_text(value: float, from_1904: bool = False) -> str:
    """A date's number as ISO text: a day, a time of day (below 1), or both."""
    if from_1904:
        base = datetime(1904, 1, 1)
    else:
        base = datetime(1899, 12, 30) if value >= 61 else datetime(1899, 12, 31)
    when = base + timedelta(seconds=round(value * 86400))
    if 0 <= value < 1 and not from_1904:
        return when.time().isoformat()
    return when.date().isoformat() if when.time() == datetime.min.time() else when.isoformat(" ")


def cell_xml(at: int, row: int, value) -> str:
    """One cell; nothing for a null."""
    if value is None:
        return ""
    name = f"{column_name(at)}{row}"
    if isinstance(value, bool):
        return f'<c r="{name}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, date) and not isinstance(value, datetime) and value >= date(1900, 3, 1):
        return f'<c r="{name}" s="1"><v>{serial(value)}</v></c>'
    if (isinstance(value, int) and abs(value) <= EXACT) or (isinstance(value, float) and abs(value) < float("inf")):
        return f'<c r="{name}"><v>{value!r}</v></c>'
    text = value if isinstance(value, str) else value.isoformat(" ") if isinstance(value, datetime) else str(value)
    if len(text) * 2 > CELL and len(text.encode("utf-16-le")) > 2 * CELL:
        raise WorkbookRefused(f"cell {name} is longer than {CELL} units; see split_texts")
    return f'<c r="{name}" t="inlineStr"><is><t xml:space="preserve">{to_cell(text)}</t></is></c>'


class Book:
    """A workbook that is being written, row by row."""

    def __init__(self, path: str, sheet: str, columns: list[str]):
        fs, p = store.opened(path)
        fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
        self.stack, self.rows = ExitStack(), 0
        self.zip = self.stack.enter_context(ZipFile(self.stack.enter_context(fs.open_output_stream(p)), "w", ZIP_DEFLATED))
        name = escape(sheet, {'"': "&quot;"})
        for part, xml in {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KIND}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{LINKS}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
        }.items():
            self.zip.writestr(part, HEAD + xml)
        self.out = self.stack.enter_context(TextIOWrapper(self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True), "utf-8", newline="\n"))
        self.out.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>')
        self.add(columns)

    def add(self, values) -> None:
        self.rows += 1
        self.out.write(f'<row r="{self.rows}">' + "".join(cell_xml(i, self.rows, v) for i, v in enumerate(values)) + "</row>")

    def close(self) -> None:
        self.out.write("</sheetData></worksheet>")
        self.stack.close()


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def _xml(book: ZipFile, part: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(part)) if part in book.namelist() else None


def _date_styles(book: ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    root = _xml(book, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(_tag("numFmt"))}
    dates = DATE_STYLES | {k for k, code in own.items() if re.search("[dmyhs]", code, re.I)}
    found = root.find(_tag("cellXfs"))
    return {i for i, x in enumerate(found if found is not None else ()) if int(x.get("numFmtId", 0)) in dates}


def _string(node: ElementTree.Element) -> str:
    """The text of a string item: its own or that of its runs, without reading aids."""
    return from_cell("".join(t.text or "" for part in node if part.tag in (_tag("t"), _tag("r")) for t in part.iter(_tag("t"))))


def sheet_rows(book: ZipFile, sheet: str | None) -> Iterator[tuple[int, dict[int, str]]]:
    """``(row number, text by column)`` of a sheet (the first, if none is named), as they stand in the file."""
    root = _xml(book, "xl/workbook.xml")
    links = _xml(book, "xl/_rels/workbook.xml.rels")
    if root is None or links is None:
        raise WorkbookRefused("no workbook part")
    sheets = {s.get("name"): s.get(f"{{{LINKS}}}id") for s in root.iter(_tag("sheet"))}
    if not sheets or (sheet is not None and sheet not in sheets):
        raise WorkbookRefused(f"no worksheet {sheet!r} among {list(sheets)}")
    target = {r.get("Id"): r.get("Target") for r in links}[sheets[sheet] if sheet is not None else next(iter(sheets.values()))]
    part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    shared = _xml(book, "xl/sharedStrings.xml")
    strings = [] if shared is None else [_string(x) for x in shared.iter(_tag("si"))]
    dates, settings = _date_styles(book), root.find(_tag("workbookPr"))
    from_1904 = settings is not None and settings.get("date1904") in ("1", "true")

    def text(c: ElementTree.Element) -> str | None:
        kind, v = c.get("t", "n"), c.find(_tag("v"))
        if kind == "inlineStr":
            inline = c.find(_tag("is"))
            return None if inline is None else _string(inline)
        if v is None or v.text is None:
            return None
        if kind == "s":
            return strings[int(v.text)]
        if kind == "b":
            return "true" if v.text == "1" else "false"
        if kind != "n":
            return from_cell(v.text)
        if int(c.get("s", 0)) in dates:
            return serial_text(float(v.text), from_1904)
        return v.text if re.fullmatch(r"-?\d+", v.text) else repr(float(v.text))

    with book.open(part) as f:
        number, holder = 0, None
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                holder = node if node.tag == _tag("sheetData") else holder
            elif node.tag == _tag("row"):
                number, at, cells = int(node.get("r", number + 1)), -1, {}
                for c in node.iter(_tag("c")):
                    at = column_at(c.get("r")) if c.get("r") else at + 1
                    if (value := text(c)) is not None:
                        cells[at] = value
                yield number, cells
                holder.clear()  # read rows are let go


def records(rows: Iterator[tuple[int, dict[int, str]]], columns: list[str], strip: bool, key: str | None, texts: list[str]) -> Iterator[list]:
    """``[row number, values]`` below a header of exactly ``columns``; blank rows are skipped.

    With ``key``, a row without one goes on with the ``texts`` of the record before it; anything else in it is an error.
    """
    n = len(columns)
    clean = lambda cells: {i: v for i, v in ((i, x.strip() if strip else x) for i, x in cells.items()) if v or not strip}
    head = clean(next(rows, (0, {}))[1])
    if [head.get(i, "").strip() for i in range(n)] != columns or any(v for i, v in head.items() if i >= n):
        raise WorkbookRefused(f"row 1 must be {columns}, got {[head[i] for i in sorted(head)]}")
    at = None if key is None else columns.index(key)
    goes_on = {columns.index(c) for c in texts}
    now: list | None = None
    for number, cells in rows:
        cells = clean(cells)
        if not any(cells.values()) and (strip or not cells):
            continue
        if any(v for i, v in cells.items() if i >= n):
            raise WorkbookRefused(f"row {number} has values beyond column {column_name(n - 1)}")
        if at is not None and cells.get(at) is None:
            if now is None or not set(cells) <= goes_on:
                raise WorkbookRefused(f"continuation row {number} follows no record or carries values of its own")
            for i, v in cells.items():
                now[i + 1].append(v)
            continue
        if now is not None:
            yield [now[0], *[None if not v else "".join(v) for v in now[1:]]]
        now = [number, *[[cells[i]] if i in cells else [] for i in range(n)]]
    if now is not None:
        yield [now[0], *[None if not v else "".join(v) for v in now[1:]]]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class File(InputPartition):
    path: str


def committed(path: str) -> list[str]:
    """The workbooks that ``path`` stands for: a file, or what a folder's last commit names, or all in the folder."""
    if path.endswith(".xlsx"):
        return [path]
    note = store.read_bytes(f"{path}/{COMMIT}")
    names = json.loads(note)["files"] if note is not None else [n for n in store.listed(path) if n.endswith(".xlsx")]
    return [f"{path}/{n}" for n in names]


class Workbooks(DataSource):
    """Options: ``path``, ``sheet``; to read also ``columns`` (JSON list), ``strip``, ``key`` and ``texts``."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> T.StructType:
        named = json.loads(self.options["columns"])
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.StringType()) for c in named]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options), schema.names, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.columns = json.loads(options["columns"])

    def partitions(self) -> list[File]:
        return [File(p) for p in committed(self.options["path"].rstrip("/"))]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        types = pa.schema([("path", pa.string()), ("row", pa.int64()), *[(c, pa.string()) for c in self.columns]])
        full = lambda rows: pa.record_batch([pa.array([partition.path] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(zip(*rows), types.types[1:])]], schema=types)
        fs, p = store.opened(partition.path)
        try:
            with fs.open_input_file(p) as f, ZipFile(f) as book:
                rows, size = [], 0
                found = sheet_rows(book, self.options.get("sheet"))
                for r in records(found, self.columns, self.options.get("strip", "true") == "true", self.options.get("key"), json.loads(self.options.get("texts", "[]"))):
                    rows.append(r)
                    size += sum(len(v) for v in r[1:] if v)
                    if len(rows) >= 4096 or size >= 1 << 20:
                        yield full(rows)
                        rows, size = [], 0
                if rows:
                    yield full(rows)
        except (BadZipFile, LookupError, ElementTree.ParseError, ValueError) as e:
            raise WorkbookRefused(f"{partition.path}: {e}") from e


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.sheet, self.overwrite, self.columns = options["path"].rstrip("/"), options.get("sheet", "Sheet1"), overwrite, columns
        self.key = columns.index(options["key"]) if "key" in options else None
        self.run, self.limit = uuid.uuid4().hex, int(options.get("rows", ROWS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Workbooks of at most ``limit`` rows each; a record and its continuation rows stay together."""
        files: list[str] = []
        book = None
        stem = f"{self.run}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        for batch in iterator:
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                if book is not None and book.rows > self.limit and (self.key is None or values[self.key] is not None):
                    book.close()
                    book = None
                if book is None:
                    files.append(f"{stem}-{len(files):04d}.xlsx")
                    book = Book(f"{self.path}/{files[-1]}", self.sheet, self.columns)
                book.add(values)
        if book is not None:
            book.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        if not self.overwrite and store.read_bytes(f"{self.path}/{COMMIT}") is not None:
            self.abort(messages)
            raise FileExistsError(f"{self.path} already holds workbooks")
        store.write_bytes(f"{self.path}/{COMMIT}", json.dumps({"run": self.run, "files": files}).encode())
        for name in store.listed(self.path):
            if name.endswith(".xlsx") and name not in files:
                store.delete(f"{self.path}/{name}")

    def abort(self, messages: list) -> None:
        for name in store.listed(self.path):
            if name.startswith(self.run):
                store.delete(f"{self.path}/{name}")


def write_workbooks(df: DataFrame, path: str, sheet: str = "Sheet1", key: str | None = None, overwrite: bool = False, rows: int = ROWS) -> None:
    """Write ``df`` as workbooks of a header and at most ``rows`` rows, one or more a task, into a folder of their own.

    A folder that already holds committed workbooks is an error unless ``overwrite``, which replaces them once all new ones
    are there. Days from March 1900 on are date cells, numbers number cells (integers beyond 2**53 and earlier days are
    text), everything else is text. Files of failed attempts are not named by the commit and go.
    """
    if not overwrite and store.listed(path):
        raise FileExistsError(f"{path} is not empty")
    df.sparkSession.dataSource.register(Workbooks)
    to = df.write.format("workbooks").mode("overwrite" if overwrite else "append").option("path", path).option("sheet", sheet).option("rows", rows)
    (to.option("key", key) if key else to).save()


def read_workbooks(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None, strip: bool = True, key: str | None = None, texts: tuple[str, ...] = ()) -> DataFrame:
    """``(path, row, *columns)`` as texts, from a workbook or a folder of them; one task a workbook.

    Row 1 must be exactly ``columns``; blank rows are skipped, values beyond the columns are an error. Dates are ISO text.
    ``strip`` trims texts and makes empty ones null. ``key`` and ``texts`` put texts together that ``split_texts`` split. A table without
    columns, or a folder without workbooks, gives no rows.
    """
    if "path" in columns or "row" in columns:
        raise ValueError("columns must not be called path or row")
    spark.dataSource.register(Workbooks)
    given = spark.read.format("workbooks").option("path", path).option("columns", json.dumps(columns)).option("strip", str(strip).lower()).option("texts", json.dumps(list(texts)))
    given = given.option("sheet", sheet) if sheet is not None else given
    return (given.option("key", key) if key else given).load()


def split_texts(df: DataFrame, key: str, texts: tuple[str, ...], limit: int = CELL) -> DataFrame:
    """``df`` with each of ``texts`` cut to cells: further pieces stand in rows of their own, right below, whose other columns
    are null. A null key is an error."""
    pieces = {c: S.utf16_chunks(F.col(c), limit) for c in texts}
    cut = df.select("*", *[p.alias(f"_{c}") for c, p in pieces.items()])
    most = F.greatest(F.lit(1), F.lit(1), *[F.coalesce(F.size(f"_{c}"), F.lit(0)) for c in texts])
    each = cut.select("*", F.explode(F.sequence(F.lit(0), most - 1)).alias("_at"))
    first = F.col("_at") == 0
    known = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is null"))).otherwise(F.col(key))
    return each.select(*[F.get(f"_{c}", "_at").alias(c) if c in texts else F.when(first, known if c == key else F.col(c)).alias(c) for c in df.columns])
