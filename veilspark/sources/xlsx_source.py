"""Workbooks as a registered data source: spark.read.format("xlsx") and df.write.format("xlsx").

Reading is one task a file. Without a schema each row of each first sheet is a row (path, title, row, cells, error), and a file
that can't be read is one row with its error. With a schema of strings the first row of a sheet names its columns, cells that
are missing are null, and a file that can't be read fails the query. Writing is one or more workbooks a task (at most MAX_ROWS
rows each, the header included); null cells are empty, so they come back as empty strings. Files appear under their names once
all tasks are done. Paths are URIs or absolute paths that pyarrow opens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from . import files

CELLS = StructType().add("path", StringType()).add("title", StringType()).add("row", LongType()).add("cells", ArrayType(StringType())).add("error", StringType())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _listed(store, base: str) -> list:
    """The workbooks of a folder, or the one at base."""
    from pyarrow import fs

    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise files.FileError(f"PATH_NOT_FOUND {base}")
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base))
    return sorted((f for f in found if f.is_file and f.base_name.lower().endswith(".xlsx") and not f.base_name.startswith((".", "~"))), key=lambda f: f.path)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        cells = schema.simpleString() == CELLS.simpleString()
        return XlsxReader(self.options["path"], None if cells else _names(schema))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return XlsxWriter(self.options["path"], self.options.get("title", "Sheet1"), _names(schema), overwrite)


def _names(schema: StructType) -> list[str]:
    if other := [f.name for f in schema.fields if not isinstance(f.dataType, StringType)]:
        raise ValueError(f"columns of workbooks are strings: {', '.join(other)}")
    if not 0 < len(schema.fields) <= files.MAX_COLUMNS:
        raise ValueError(f"a workbook has 1 to {files.MAX_COLUMNS} columns")
    return schema.names


@dataclass
class Workbook(InputPartition):
    path: str
    size: int


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, names: list[str] | None):
        self.path, self.names = path, names

    def partitions(self) -> list[Workbook]:
        store, base = _store(self.path)
        return [Workbook(f.path, f.size) for f in _listed(store, base)]

    def read(self, partition: Workbook | None) -> Iterator[tuple]:
        if partition is None:  # a folder without workbooks
            return
        try:
            title, rows = self._parsed(partition)
        except files.FileError as e:
            if self.names is not None:
                raise files.FileError(f"{e} {partition.path}") from e
            yield partition.path, None, None, None, str(e)
            return
        if self.names is None:
            yield from ((partition.path, title, k, cells, None) for k, cells in enumerate(rows, 1))
        elif rows:
            if lacking := [n for n in self.names if n not in rows[0]]:
                raise files.FileError(f"NO_COLUMN {', '.join(lacking)} {partition.path}")
            at = [rows[0].index(n) for n in self.names]
            yield from (tuple(cells[k] if k < len(cells) else None for k in at) for cells in rows[1:])

    def _parsed(self, partition: Workbook) -> tuple[str, list[list[str]]]:
        if partition.size > files.MAX_BYTES:
            raise files.FileError("FILE_TOO_LARGE")
        store, _ = _store(self.path)
        with store.open_input_stream(partition.path) as f:
            title, rows = files.parse_xlsx(f.read())
        if long := [k for k, r in enumerate(rows, 1) if len(r) > len(rows[0])]:
            raise files.FileError(f"ROW_TOO_LONG {long[0]}")
        return title, rows


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class XlsxWriter(DataSourceWriter):
    def __init__(self, path: str, title: str, header: list[str], overwrite: bool):
        self.path, self.title, self.header, self.overwrite = path, title, header, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        names, rows = [], []
        for row in iterator:
            rows.append(["" if v is None else v for v in row])
            if len(rows) == files.MAX_ROWS - 1:
                names.append(self._put(rows))
                rows = []
        if rows:
            names.append(self._put(rows))
        return Written(names)

    def _put(self, rows: list[list[str]]) -> str:
        store, base = _store(self.path)
        body = files.write_xlsx(self.title, [self.header, *rows])
        # attempts of one task, and tasks that run twice, have names of their own: only those that are committed are moved
        name = f"part-{uuid.uuid4().hex}.xlsx"
        store.create_dir(self._waiting(base), recursive=True)
        with store.open_output_stream(f"{self._waiting(base)}/{name}", compression=None) as out:
            out.write(body)
        return name

    def _waiting(self, base: str) -> str:
        return f"{base}/.{self.job}"

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        before = _listed(store, base) if self.overwrite else []
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(f"{self._waiting(base)}/{name}", f"{base}/{name}")
        for f in before:
            store.delete_file(f.path)
        self._forget(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._forget(*_store(self.path))

    def _forget(self, store, base: str) -> None:
        if store.get_file_info(self._waiting(base)).type.name == "Directory":
            store.delete_dir(self._waiting(base))
