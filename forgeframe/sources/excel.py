"""Excel workbooks, read and written by tasks with what Python has: they are zipped XML.

A workbook is read as Spark reads any file, from any store, by one task a file; a sheet has 1,048,576 rows at most by its format. Written
are as many workbooks as there are tasks, and more where a task's rows exceed a sheet's.
"""

from __future__ import annotations

import datetime
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from .records import Written, _filesystem

#: Rows of a sheet, with its header.
MOST_ROWS = 1_048_576
#: Rows that a reading task hands on at once.
BATCH = 2000
# Fixed values of the format: built-in numbers of formats that show dates or times; day 0 of either calendar.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
DAYS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _texts(element) -> str:
    """The text of a string item, its phonetic hints left out."""
    return "".join(t.text or "" for part in element for t in ([part] if part.tag == f"{_MAIN}t" else part.findall(f"{_MAIN}t") if part.tag == f"{_MAIN}r" else []))


def _column(reference: str) -> int:
    """The column, from 0, of a cell's name such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """Whether each cell style shows a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {}
    for f in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        own[int(f.get("numFmtId"))] = bool(re.search(r"[ymdhs]", code, re.I)) and not re.search(r"general", code, re.I)
    styles = root.find(f"{_MAIN}cellXfs")
    numbers = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
    return [own.get(n, n in DATE_FORMATS) for n in numbers]


def _sheet(book: zipfile.ZipFile, sheet: str | None) -> tuple[str, bool]:
    """(file of the named or first sheet, whether days count from 1904)."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = {s.get("name"): s.get(f"{_REL}id") for s in root.iter(f"{_MAIN}sheet")}
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"no sheet {sheet!r}; there are {', '.join(sheets)}")
    wanted = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    late = any(p.get("date1904") in ("1", "true") for p in root.iter(f"{_MAIN}workbookPr"))
    target = links[wanted]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", late


def read_rows(content: bytes, sheet: str | None = None) -> Iterator[list[tuple[str, str] | None]]:
    """The rows of a sheet that hold anything, a cell as (kind, text), None where it is empty; kinds: number, bool, date, text.

    Formulas count by their stored values, errors as empty.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        dates, (name, late) = _date_styles(book), _sheet(book, sheet)
        with book.open(name) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[tuple[str, str] | None] = []
                for nth, c in enumerate(row.findall(f"{_MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else nth
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
                    text = _texts(c.find(f"{_MAIN}is")) if kind == "inlineStr" and c.find(f"{_MAIN}is") is not None else value.text if value is not None else None
                    if text is None or kind == "e":
                        continue
                    if kind == "s":
                        cells[at] = ("text", shared[int(text)])
                    elif kind in ("str", "inlineStr"):
                        cells[at] = ("text", text)
                    elif kind == "b":
                        cells[at] = ("bool", "true" if text.strip() in ("1", "true") else "false")
                    elif kind == "d":
                        cells[at] = ("date", text.replace("T", " "))
                    elif int(c.get("s", 0)) < len(dates) and dates[int(c.get("s", 0))]:
                        day = DAYS[late] + datetime.timedelta(seconds=round(float(text) * 86400, 3))
                        cells[at] = ("date", day.isoformat(" "))
                    else:
                        cells[at] = ("number", text.strip())
                row.clear()
                cells = [None if c is not None and c[0] == "text" and c[1] == "" else c for c in cells]
                if any(c is not None for c in cells):
                    yield cells


_CELL = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))


def _read(sheet: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, n = [], 0

                def made() -> pa.RecordBatch:
                    cells = [[None if c is None else {"kind": c[0], "text": c[1]} for c in r] for r in rows]
                    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(n - len(rows), n), pa.int64()), pa.array(cells, _CELL)], names=["path", "row", "cells"])  # noqa: B023

                for row in read_rows(content.as_py(), sheet):
                    rows.append(row)
                    n += 1
                    if len(rows) == BATCH:
                        yield made()
                        rows = []
                if rows:
                    yield made()

    return run


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet (the first unless named) of a workbook, or of all workbooks of a folder with one header, as a table.

    The first row that holds anything names the columns (``Unnamed: k`` where it is empty; repeated names get ``.1`` and so on). Kinds follow from all cells: whole numbers, numbers, truth values, dates, else text; empty cells are null. Columns
    beyond the header's come after it. A workbook is parsed by one task, once for the kinds and once for the rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_read(sheet), "path string, row long, cells array<struct<kind: string, text: string>>")
    facts = rows.select("row", F.posexplode("cells").alias("at", "cell")).where("cell is not null")
    number = F.col("cell.kind") == "number"
    whole = number & F.col("cell.text").rlike(r"^-?\d{1,18}$")
    kinds = facts.groupBy("at").agg(F.min_by("cell.text", F.when(F.col("row") == 0, F.lit(0))).alias("name"), F.count_if(F.col("row") > 0).alias("n"), *(F.count_if((F.col("row") > 0) & c).alias(k) for k, c in (("whole", whole), ("number", number), ("bool", F.col("cell.kind") == "bool"), ("date", F.col("cell.kind") == "date"))))
    found = {r["at"]: r for r in kinds.collect()}
    names: list[str] = []
    taken: dict[str, int] = {}
    columns = []
    for at in range(max(found, default=-1) + 1):
        r = found.get(at)
        name = r["name"] if r is not None and r["name"] is not None else f"Unnamed: {at}"
        nth = taken[name] = taken.get(name, -1) + 1
        names.append(f"{name}.{nth}" if nth else name)
        text = F.get("cells", F.lit(at))["text"]
        n = r["n"] if r is not None else 0
        kind = next((t for k, t in (("whole", "long"), ("number", "double"), ("bool", "boolean"), ("date", "timestamp_ntz")) if n and r[k] == n), "string")
        columns.append(text.cast(kind).alias(names[-1]))
    return rows.where("row > 0").select(*columns) if columns else spark.createDataFrame([], T.StructType([]))


def _name(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(value, at: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf") and not (isinstance(value, int) and abs(value) > 1 << 53):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    if isinstance(value, float):
        return ""
    if isinstance(value, datetime.date):
        moment = value if isinstance(value, datetime.datetime) else datetime.datetime(value.year, value.month, value.day)
        if moment.replace(tzinfo=None) >= datetime.datetime(1900, 3, 1):
            return f'<c r="{at}" s="1"><v>{(moment.replace(tzinfo=None) - DAYS[False]) / datetime.timedelta(days=1)!r}</v></c>'
        value = moment.isoformat(" ")
    text = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def workbook(names: list[str], rows: list[list]) -> bytes:
    """A workbook of one sheet with a header."""
    lines = ["".join(_cell(v, f"{_name(k)}{r}") for k, v in enumerate(row)) for r, row in enumerate([names, *rows], 1)]
    kind, package = "http://schemas.openxmlformats.org/", "http://schemas.openxmlformats.org/package/2006/"
    main, office = f"{kind}spreadsheetml/2006/main", f"{kind}officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + "".join(f'<Override PartName="/xl/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{t}+xml"/>' for p, t in (("workbook.xml", "sheet.main"), ("worksheets/sheet1.xml", "worksheet"), ("styles.xml", "styles"))) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r}">{line}</row>' for r, line in enumerate(lines, 1)) + "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{text}')
    return out.getvalue()


class WorkbookWriter(DataSourceArrowWriter):
    """Each task's rows as workbooks, moved to their names when all tasks are done."""

    def __init__(self, names: list[str], path: str):
        self.names, self.path, self.hidden = names, path.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, path = _filesystem(self.path)
        system.create_dir(f"{path}/{self.hidden}", recursive=True)
        made, rows, part = [], [], TaskContext.get().partitionId()

        def close() -> None:
            own = f"{path}/{self.hidden}/{uuid.uuid4().hex}"
            with system.open_output_stream(own) as stream:
                stream.write(workbook(self.names, rows))
            made.append((own, f"part-{part:05}-{len(made):03}.xlsx"))
            rows.clear()

        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(list(row))
                if len(rows) == MOST_ROWS - 1:
                    close()
        if rows or (part == 0 and not made):
            close()
        return Written(made)

    def commit(self, messages) -> None:
        system, path = _filesystem(self.path)
        for message in messages:
            for own, name in message.files if message else []:
                system.move(own, f"{path}/{name}")
        system.delete_dir(f"{path}/{self.hidden}")

    def abort(self, messages) -> None:
        system, path = _filesystem(self.path)
        system.delete_dir(f"{path}/{self.hidden}")


class Workbooks(DataSource):
    """The sink ``workbooks``."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema.names, self.options["path"])


def write_excel(df: DataFrame, path: str) -> None:
    """``df`` as workbooks in the folder ``path``, one a task or more.

    Numbers, truth values, dates from March 1900 on and texts keep their kind; whole numbers beyond 2**53, other dates and nested values are written as text; nulls, NaN and infinities are empty.
    """
    df.sparkSession.dataSource.register(Workbooks)
    plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    kinds = {f.name: F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.to_json(f"`{f.name}`") if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`").cast("string") for f in df.schema}
    df.select(*(c.alias(n) for n, c in kinds.items())).write.format("workbooks").mode("append").save(path)
