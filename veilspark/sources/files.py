"""Files: text, CSV and XLSX in and out, archives, allow lists. Parsing and writing run one file a row, never on the driver;
a file is at most MAX_BYTES."""

from __future__ import annotations

import base64
import csv
import datetime
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TYPES = ("txt", "csv", "xlsx")
MAX_BYTES = 10 << 20
MAX_MEMBERS, MAX_UNPACKED, MAX_ROWS, MAX_COLUMNS = 2000, 100 << 20, 20_000, 500
MAX_ENTRIES, MAX_BUNDLE = 40, 60 << 20
_GLOB = "*.{[tT][xX][tT],[cC][sS][vV],[xX][lL][sS][xX]}"
#: Where Python's splitlines() ends a line.
_LINE = "(?:\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\\u2028\\u2029])"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Characters that XML, hence a workbook, cannot hold.
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_ROWS = "path string, filetype string, encoding string, title string, row long, cells array<string>, header array<string>, error string"


class FileError(ValueError):
    pass


def decode(data: bytes) -> tuple[str, str]:
    """Text and the name of its encoding."""
    for names, shown in ((("utf-8-sig",), "utf-8-sig" if data[:3] == b"\xef\xbb\xbf" else "utf-8"), (("big5", "cp950"), "big5")):
        for name in names:
            try:
                return data.decode(name), shown
            except UnicodeDecodeError:
                continue
    raise FileError("DECODE")


def parse_csv(text: str) -> list[list[str]]:
    try:
        return list(csv.reader(io.StringIO(text, newline=""), strict=True))
    except csv.Error as e:
        raise FileError("CSV") from e


def _cell_text(v: str, kind: str | None) -> str:
    if kind in (None, "n") and v:
        try:
            x = float(v)
        except ValueError:
            return v
        return str(int(x)) if x.is_integer() else str(x)
    return {"1": "True", "0": "False"}.get(v, v) if kind == "b" else v


def parse_xlsx(data: bytes) -> tuple[str, list[list[str]]]:
    """Title and rows of the first sheet; formulas stay text."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        infos = book.infolist()
        if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_UNPACKED:
            raise FileError("XLSX_TOO_LARGE")
        sheet = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets")[0]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = rels[sheet.get(f"{_REL}id")]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        raw = book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    except FileError:
        raise
    except Exception as e:
        raise FileError("XLSX") from e
    rows: list[list[str]] = []
    for _, node in ET.iterparse(io.BytesIO(raw)):
        if node.tag != f"{_NS}row":
            continue
        number = int(node.get("r", len(rows) + 1))
        if number > MAX_ROWS:
            raise FileError("XLSX_TOO_MANY_ROWS")
        rows += [[] for _ in range(number - 1 - len(rows))]
        cells: list[str] = []
        for c in node.findall(f"{_NS}c"):
            at = 0
            for letter in re.match("[A-Z]*", c.get("r", "")).group():
                at = at * 26 + ord(letter) - 64
            at = at - 1 if at else len(cells)
            if at >= MAX_COLUMNS:
                raise FileError("XLSX_TOO_MANY_COLUMNS")
            cells += [""] * (at + 1 - len(cells))
            kind, v, formula = c.get("t"), c.find(f"{_NS}v"), c.find(f"{_NS}f")
            if formula is not None and formula.text:
                cells[at] = "=" + formula.text
            elif kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif v is not None:
                cells[at] = shared[int(v.text)] if kind == "s" else _cell_text(v.text or "", kind)
        rows.append(cells)
        node.clear()
    return sheet.get("name", "Sheet1"), rows


def write_csv(rows: list[list[str]]) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\r\n").writerows(rows)
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def write_xlsx(title: str, rows: list[list[str]]) -> bytes:
    if any(_NOT_XML.search(v) for cells in rows for v in cells if v):
        raise FileError("CELL_NOT_XML")
    root = ET.Element("worksheet", xmlns=_NS[1:-1])
    data = ET.SubElement(root, "sheetData")
    for r, cells in enumerate(rows, 1):
        line = ET.SubElement(data, "row", r=str(r))
        for v in cells:
            c = ET.SubElement(ET.SubElement(ET.SubElement(line, "c", t="inlineStr"), "is"), "t", {"xml:space": "preserve"})
            c.text = v
    book = ET.Element("workbook", {"xmlns": _NS[1:-1], "xmlns:r": _REL[1:-1]})
    ET.SubElement(ET.SubElement(book, "sheets"), "sheet", {"name": title[:31] or "Sheet1", "sheetId": "1", "r:id": "rId1"})
    package, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rel = lambda kind, to: f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/{kind}" Target="{to}"/></Relationships>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (("[Content_Types].xml", types), ("_rels/.rels", rel("officeDocument", "xl/workbook.xml")), ("xl/workbook.xml", ET.tostring(book)), ("xl/_rels/workbook.xml.rels", rel("worksheet", "worksheets/sheet1.xml")), ("xl/worksheets/sheet1.xml", ET.tostring(root).replace(b"\r", b"&#13;"))):
            z.writestr(name, body)
    return buffer.getvalue()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row of each file with the header of its table (a text file is one row of one cell, numbered 1), or one
    row with an error. Unsupported types and files over MAX_BYTES are not opened: one scan lists all files without their
    contents, the other takes the length as a pushed filter and names by a glob. Spark's reader passes over files of no bytes."""
    kind = F.lower(F.regexp_extract("path", "\\.([^.]*)$", 1))
    files, no = spark.read.format("binaryFile").load(path), F.lit(None)
    refused = files.select("path", kind.alias("filetype"), F.when(~kind.isin(*TYPES), "UNSUPPORTED_TYPE").when(F.col("length") > MAX_BYTES, "FILE_TOO_LARGE").alias("error"), no.cast("binary").alias("content")).where("error IS NOT NULL")
    opened = spark.read.format("binaryFile").option("pathGlobFilter", _GLOB).load(path).where(F.col("length") <= MAX_BYTES)
    rows = refused.unionByName(opened.select("path", kind.alias("filetype"), no.cast("string").alias("error"), "content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, filetype, error, content in batch.itertuples(index=False):
                encoding, title, cells = None, None, []
                try:
                    if error is None and filetype == "xlsx":
                        title, cells = parse_xlsx(content)
                    elif error is None:
                        text, encoding = decode(content)
                        cells = [[text]] if filetype == "txt" else parse_csv(text)
                except FileError as e:
                    error, cells = str(e), []
                if filetype != "txt" and cells and (long := [k for k, r in enumerate(cells, 1) if len(r) > len(cells[0])]):
                    error, cells = f"ROW_TOO_LONG {long[0]}", []
                header = cells[0] if cells and filetype != "txt" else None
                rows = [(path, filetype, encoding, title, k, r, header, error) for k, r in enumerate(cells, 1)] or [(path, filetype, encoding, title, None, None, None, error)]
                yield pd.DataFrame(rows, columns=["path", "filetype", "encoding", "title", "row", "cells", "header", "error"]).astype({"row": "Int64"})

    return rows.mapInPandas(run, _ROWS)


def as_table(cells: DataFrame, header: list[str]) -> DataFrame:
    """The data rows of one file as columns; missing cells are null."""
    return cells.where("row > 1 AND error IS NULL").select("row", *(F.get("cells", k).alias(c) for k, c in enumerate(header)))


def preview_files(rows: DataFrame, samples: int = 3) -> DataFrame:
    """rows: of read_files(). For each file its encoding and row_count (of a table without the header, of a text its lines),
    and for each column of a table name and first non-empty samples; col, name and samples are null for texts."""
    lines = F.size(F.split(F.regexp_replace(F.get("cells", 0), _LINE + "\\z", ""), _LINE, -1)) - (F.get("cells", 0) == "").cast("int")
    text = F.col("filetype") == "txt"
    counts = rows.groupBy("path", "filetype").agg(F.max("encoding").alias("encoding"), F.sum(F.when(text, lines).when(F.col("row") > 1, 1).otherwise(0)).cast("long").alias("row_count"), F.max("error").alias("error"))
    heads = rows.where((F.col("row") == 1) & ~text).select("path", F.posexplode("cells").alias("col", "name"))
    values = rows.where((F.col("row") > 1) & ~text).select("path", "row", F.posexplode("cells").alias("col", "value")).where("value <> ''")
    first = values.withColumn("n", F.row_number().over(W.partitionBy("path", "col").orderBy("row"))).where(F.col("n") <= samples)
    first = first.groupBy("path", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("samples"))
    columns = heads.join(first, ["path", "col"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return counts.join(columns, "path", "left").select("path", "filetype", "encoding", "row_count", "col", "name", "samples", "error")


def file_bytes(filetype: str, title: str | None, rows: list[list[str]]) -> bytes:
    """A scrubbed file: text in UTF-8, CSV with byte order mark and CRLF, or a workbook of one sheet."""
    if filetype == "txt":
        return "".join(c for r in rows for c in r).encode()
    return write_csv(rows) if filetype == "csv" else write_xlsx(title or "Sheet", rows)


def save_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's content under its name into folder (a URI that pyarrow opens); rows without content are left out. A
    file appears under its name once it is whole. Returns name and bytes; nothing is written before that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for to, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = f"{base}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(body)
                store.move(part, f"{base}/{to}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())], names=["name", "bytes"])

    return files.where(F.col(content).isNotNull()).select(F.col(name), F.col(content)).mapInArrow(run, "name string, bytes long")


def read_allow_list(spark: SparkSession, path: str) -> list[str]:
    """Terms, one a line, without blank lines and comments. Read anew by every call; no file, no terms."""
    try:
        lines = spark.read.text(path).select(F.trim("value").alias("t")).where("t <> '' AND NOT startswith(t, '#')").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return [r.t for r in lines]


def bundle(entries: list[tuple[str, str]]) -> tuple[str, bytes]:
    """An archive of (name, base64 content): its own name and bytes. Names must be safe and distinct already."""
    if len(entries) > MAX_ENTRIES or sum(len(c) * 3 // 4 for _, c in entries) > MAX_BUNDLE + 3 * len(entries):
        raise FileError("BUNDLE_TOO_LARGE")
    try:
        files = [(n, base64.b64decode(c, validate=True)) for n, c in entries]
    except ValueError as e:
        raise FileError("BASE64") from e
    if sum(len(c) for _, c in files) > MAX_BUNDLE:
        raise FileError("BUNDLE_TOO_LARGE")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(name, content)
    return f"scrubbed-{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%SZ}.zip", buffer.getvalue()
