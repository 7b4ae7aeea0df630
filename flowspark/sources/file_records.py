"""A data source for folders of JSON-lines files, by prefix, extension and schema, as a table or a stream.

:func:`register_file_records` makes it known to a session; then

    spark.read.format("file_records").schema("processed_packets long, total_timer double")
        .option("path", root).option("prefix", "worker").load()

and ``spark.readStream`` with the same options give a row per line of every file below ``path`` (at any
depth) whose name starts with ``prefix`` and ends with ``extension`` (``.json``). Besides the fields asked
for, these columns are filled if the schema names them: ``_file`` (path below the root), ``_line`` (from 1)
and ``_bad`` (the text of a line that is no object of the schema; its fields are NULL). Without ``_bad``
such a line is an error that names file and line. Blank lines are left out; a missing field, or one that
is null, is NULL.

Numbers, truth values and texts are taken strictly: a text for a number is no object of the schema, nor is a
fraction for an integer; dates and times (without zone) are ISO texts.

Hidden files (names starting with ``.`` or ``_``, and what lies in such folders) are not read. Tasks open the
files, so ``path`` is a folder that all executors reach: a shared mount or an address Arrow's file systems
know (``s3://``, ``gs://``, ``hdfs://``). Large files are cut at ``block`` bytes (64 MB) and small ones put
together up to it, so that tasks are of like size; a line belongs to the block it starts in. If the schema
names ``_line``, a task also reads what lies before its block, to count lines. The driver sees names and
sizes, never rows.

A stream takes files in the order (time of change, name) and remembers the newest one it took; a batch holds
all that came since. A file has to be moved there whole and must not change; one that comes in with an older
time than the newest taken, or the same time and a smaller name, is not seen.
"""

from __future__ import annotations

import io
import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, InputPartition,
)

_BLOCK = 64 << 20
_ROWS = 8192


@dataclass
class Slice(InputPartition):
    """Parts of files: (name below the root, first byte, byte after the last)."""

    parts: list[tuple[str, int, int]]


@dataclass
class Found:
    changed: int
    name: str
    size: int


class _Files:
    """What both readers share: finding files, cutting them, and turning lines into batches."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.root = options.get("path", "")
        if not self.root:
            raise ValueError("option 'path' is missing")
        self.prefix = options.get("prefix", "")
        self.extension = options.get("extension", ".json")
        self.block = int(options.get("block", _BLOCK))
        if self.block < 1:
            raise ValueError("'block' is a number of bytes above 0")

    def _open_root(self):
        """The file system of the root, and the root in its terms."""
        from pyarrow import fs

        local = self.root.removeprefix("file://").removeprefix("file:")
        if "://" not in local:
            return fs.LocalFileSystem(), os.path.abspath(local)
        return fs.FileSystem.from_uri(self.root)

    def found(self) -> list[Found]:
        """The files, in the order (time of change, name)."""
        from pyarrow import fs

        files, root = self._open_root()
        out = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            name = info.path.removeprefix(root).lstrip("/")
            *_, last = parts = name.split("/")
            wanted = last.startswith(self.prefix) and last.endswith(self.extension)
            if info.type == fs.FileType.File and wanted and not any(p.startswith((".", "_")) for p in parts):
                out.append(Found(info.mtime_ns, name, info.size))
        return sorted(out, key=lambda f: (f.changed, f.name))

    def slices(self, files: list[Found]) -> list[Slice]:
        out, parts, size = [], [], 0
        for f in files:
            for start in range(0, f.size, self.block):
                end = min(start + self.block, f.size)
                if parts and size + end - start > self.block:
                    out.append(Slice(parts))
                    parts, size = [], 0
                parts.append((f.name, start, end))
                size += end - start
        return [*out, Slice(parts)] if parts else out

    def lines(self, name: str, start: int, end: int) -> Iterator[tuple[int | None, bytes]]:
        """Number and text of the lines that start in a part of a file."""
        files, root = self._open_root()
        with io.BufferedReader(files.open_input_file(f"{root.rstrip('/')}/{name}"), 1 << 20) as f:
            number = None
            if "_line" in self.schema.names:
                number = 1
                for at in range(0, start, 1 << 20):
                    number += f.read(min(1 << 20, start - at)).count(b"\n")
            if start:
                f.seek(start - 1)
                if f.read(1) != b"\n":  # the first line belongs to the part before
                    f.readline()
                    number = number and number + 1
            while f.tell() < end and (line := f.readline()):
                yield number, line
                number = number and number + 1

    def batches(self, part: Slice):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(self.schema)
        made = {"_file", "_line", "_bad"}
        fields = [(f.name, f.dataType) for f in self.schema.fields if f.name not in made]
        keep_bad = "_bad" in self.schema.names
        rows: list[dict] = []
        for name, start, end in part.parts:
            for number, line in self.lines(name, start, end):
                if not line.strip():
                    continue
                row = {"_file": name, "_line": number, "_bad": None}
                try:
                    record = json.loads(line)
                    if not isinstance(record, dict):
                        raise ValueError("not an object")
                    row |= {key: as_type(record.get(key), kind, key) for key, kind in fields}
                except (ValueError, ArithmeticError, RecursionError) as error:
                    if not keep_bad:
                        at = f"line {number}" if number else f"a line after byte {start}"
                        raise ValueError(f"{name}, {at}: {error}") from None
                    row["_bad"] = line.decode("utf-8", "replace").rstrip("\r\n")
                rows.append(row)
                if len(rows) == _ROWS:
                    yield pa.RecordBatch.from_pylist(rows, shape)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)


_WHOLE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def as_type(value, kind: T.DataType, place: str):
    """A JSON value as a value of a Spark type; one that does not fit is an error that names its place."""
    if value is None:
        return None
    whole = isinstance(value, int) and not isinstance(value, bool)
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return {f.name: as_type(value.get(f.name), f.dataType, f"{place}.{f.name}") for f in kind.fields}
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [as_type(v, kind.elementType, f"{place}[{i}]") for i, v in enumerate(value)]
    if isinstance(kind, T.MapType) and isinstance(value, dict) and isinstance(kind.keyType, T.StringType):
        return [(k, as_type(v, kind.valueType, f"{place}.{k}")) for k, v in value.items()]
    if isinstance(kind, T.StringType) and isinstance(value, str):
        value.encode()  # half of a surrogate pair is no text
        return value
    if isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return value
    if type(kind) in _WHOLE and whole and -(1 << _WHOLE[type(kind)]) <= value < 1 << _WHOLE[type(kind)]:
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)) and (whole or isinstance(value, float)):
        return float(value)
    if isinstance(kind, T.DecimalType) and (whole or isinstance(value, float)):
        number = Decimal(str(value))
        if number == round(number, kind.scale) and abs(number) < 10 ** (kind.precision - kind.scale):
            return round(number, kind.scale)
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return date.fromisoformat(value)
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, str):
        return datetime.fromisoformat(value).replace(tzinfo=None)
    raise ValueError(f"{place} is no {kind.simpleString()}")


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[Slice]:
        return self.slices(self.found()) or [Slice([])]

    def read(self, partition: Slice):
        return self.batches(partition)


class _StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1, "name": ""}

    def latestOffset(self) -> dict:
        found = self.found()
        return {"changed": found[-1].changed, "name": found[-1].name} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        first, last = ((o["changed"], o["name"]) for o in (start, end))
        return self.slices([f for f in self.found() if first < (f.changed, f.name) <= last])

    def read(self, partition: Slice):
        return self.batches(partition)


class FileRecords(DataSource):
    """See the module; the schema is always given by the reader."""

    @classmethod
    def name(cls) -> str:
        return "file_records"

    def schema(self):
        raise ValueError("file_records needs a schema: .schema(...)")

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> _StreamReader:
        return _StreamReader(schema, self.options)


def register_file_records(spark: SparkSession) -> None:
    """Make the format known to a session.

    The processes that plan a read do not see files added to the session, so the code goes with the class.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FileRecords)
