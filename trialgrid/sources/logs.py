"""Log files as a data source (S3, S4): many small JSON files, or few huge ones, in evenly sized tasks.

`spark.read.format("json_logs")` reads files that hold JSON objects: one per
file, one per line, or an array of them. Tasks are planned from the listing:
small files are packed together, a large one is cut into byte ranges. A range
begins at the first record that starts inside it and ends where the next
range's first record starts, so every record is read once.

Where a record starts can be told from any place in a file: it is an object
whose first key is the first key of the file's first record. (Inside a text
the quote before the key would have to be escaped.) If such an object turns up
inside another record, the text around it doesn't fit, and the read fails with
the file's name rather than give wrong rows; so does a file that isn't JSON.

Each row holds the record's fields by the given schema, the `path` of its file
and the `offset` of its first byte. Numbers come as text where the schema says
text; fields that aren't in the schema are skipped; an empty file has no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "json_logs"
RANGE_BYTES = 32 << 20
FILES_PER_TASK = 500
CHUNK = 1 << 20
HEAD_BYTES = 1 << 16
ROWS_PER_BATCH = 1000


class BadLog(ValueError):
    """A file that doesn't hold the JSON objects it should."""


# --- listing ------------------------------------------------------------------

def list_files(pattern: str) -> list[tuple[str, int]]:
    """(path, length) of every file that matches, empty ones included. `*`, `?` and
    `[..]` may stand in any part of the path; a folder stands for all files in it."""
    whole = pattern if "://" in pattern or pattern.startswith("file:") else f"file:{pattern}"
    scheme, _, rest = whole.partition(":")
    fixed = re.split(r"[*?\[]", whole, maxsplit=1)[0]
    has_glob = fixed != whole
    base = fixed.rsplit("/", 1)[0] if has_glob else whole.rstrip("/")
    fs, root = pafs.FileSystem.from_uri(base.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", base) else base)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        found = [info]
    elif info.type == pafs.FileType.NotFound:
        return []
    else:
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    tail = whole[len(base):].strip("/")
    prefix = base.rstrip("/")
    out = []
    for f in found:
        if f.type != pafs.FileType.File or any(part.startswith(("_", ".")) for part in f.path[len(root):].split("/") if part):
            continue
        below = f.path[len(root):].strip("/")
        if has_glob and not _matches(below, tail):
            continue
        out.append((f"{prefix}/{below}" if below else prefix, f.size))
    return sorted(out)


def _matches(path: str, pattern: str) -> bool:
    parts, wanted = path.split("/"), pattern.split("/")
    return len(parts) == len(wanted) and all(map(fnmatchcase, parts, wanted))


def open_file(path: str) -> pa.NativeFile:
    uri = re.sub(r"^file:/(?!/)", "file:///", path if ":" in path.split("/", 1)[0] else f"file:{path}")
    fs, where = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(where)


# --- records ------------------------------------------------------------------

_DECODER = json.JSONDecoder()
_BETWEEN = re.compile(r"[\s,]*")
_FIRST_KEY = re.compile(rb'\{\s*("(?:[^"\\]|\\.)*")\s*:')
_OPENING = re.compile(rb"\s*\[?\s*")


def _boundary(head: bytes) -> re.Pattern | None:
    """What a record of the file begins with; None for a first record without keys."""
    at = _OPENING.match(head).end()
    found = _FIRST_KEY.match(head, at)
    return re.compile(rb"\{\s*" + re.escape(found.group(1)) + rb"\s*:") if found else None


def records(file: pa.NativeFile, path: str, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records that belong to the bytes start..end of the file."""
    size = file.size()
    head = file.read_at(min(HEAD_BYTES, size), 0)
    begins = _boundary(head)
    if begins is None and start > 0:
        return  # records can't be told apart: the first range reads them all
    if begins is None:
        end = size
    text, origin, upto = "", start, start  # latin-1: a character is a byte; text stands for origin..upto

    def more() -> bool:
        nonlocal text, upto
        piece = file.read_at(min(CHUNK, size - upto), upto)
        text, upto = text + piece.decode("latin-1"), upto + len(piece)
        return bool(piece)

    def starts_here(at: int) -> bool:
        while len(text) - at < HEAD_BYTES and more():
            pass
        return begins is not None and begins.match(text[at:at + HEAD_BYTES].encode("latin-1")) is not None

    at = 0
    if start > 0:
        while True:  # the first record that starts in this range
            found = begins.search(text.encode("latin-1"))
            if found:
                at = found.start()
                break
            if origin + len(text) >= end + HEAD_BYTES or not more():
                return
        if origin + at >= end:
            return
    else:
        more()
        opening = _OPENING.match(text.encode("latin-1"))
        at = opening.end()
        if size == 0 or (at == size and "[" not in text):
            return
    while True:
        while True:
            at = _BETWEEN.match(text, at).end()
            if at < len(text) or not more():
                break
        if at >= len(text):
            if head.lstrip().startswith(b"["):
                raise BadLog(f"{path}: the array has no end")
            return
        if text[at] == "]":
            rest = text[at + 1:].strip() if upto >= size else None
            while rest is None:
                rest = text[at + 1:].strip() if not more() else None
            if rest:
                raise BadLog(f"{path}: something follows the array's end")
            return
        if origin + at >= end and starts_here(at):
            return  # the next range's first record
        if text[at] != "{":
            raise BadLog(f"{path}: no record at byte {origin + at}")
        while True:
            try:
                value, stop = _DECODER.raw_decode(text, at)
                break
            except json.JSONDecodeError as wrong:
                if not more():
                    raise BadLog(f"{path}: {wrong.msg} in the record at byte {origin + at}") from wrong
        raw = text[at:stop]
        yield origin + at, value if raw.isascii() else json.loads(raw.encode("latin-1"))
        at = stop
        if at > CHUNK:
            text, origin, at = text[at:], origin + at, 0


def _fit(value, kind: T.DataType):
    """A JSON value as the schema has it; numbers and flags as their text where text is wanted."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _fit(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    return int(value)


# --- the source -----------------------------------------------------------------

@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: (path, start, end)."""

    ranges: list[tuple[str, int, int]]


def plan(listing: list[tuple[str, int]], range_bytes: int = RANGE_BYTES, files_per_task: int = FILES_PER_TASK) -> list[Ranges]:
    """Tasks of at most about `range_bytes` bytes and `files_per_task` files."""
    out, open_task, held = [], [], 0
    for path, size in listing:
        if size > range_bytes:
            cuts = -(-size // range_bytes)
            out += [Ranges([(path, size * i // cuts, size * (i + 1) // cuts)]) for i in range(cuts)]
            continue
        if open_task and (held + size > range_bytes or len(open_task) >= files_per_task):
            out.append(Ranges(open_task))
            open_task, held = [], 0
        open_task.append((path, 0, size))
        held += size
    return out + ([Ranges(open_task)] if open_task else [])


class LogReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.wanted, self.pattern = schema, options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.files_per_task = int(options.get("filesPerTask", FILES_PER_TASK))

    def partitions(self) -> list[Ranges]:
        return plan(list_files(self.pattern), self.range_bytes, self.files_per_task) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fields, schema = self.wanted.fields, to_arrow_schema(self.wanted)
        out = []
        for path, start, end in partition.ranges:
            with open_file(path) as file:
                for offset, record in records(file, path, start, end):
                    row = {f.name: _fit(record.get(f.name), f.dataType) for f in fields}
                    out.append({**row, "path": path, "offset": offset})
                    if len(out) >= ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


class LogSource(DataSource):
    """`json_logs`: options path, rangeBytes, filesPerTask; the schema must be given."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(schema, self.options)


def read_logs(spark: SparkSession, pattern: str, schema: T.StructType, range_bytes: int = RANGE_BYTES,
              files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """Rows of `schema` with the `path` of their file and the `offset` they start at."""
    spark.dataSource.register(LogSource)
    with_place = T.StructType([*schema.fields, T.StructField("path", T.StringType()), T.StructField("offset", T.LongType())])
    return (spark.read.format(FORMAT).schema(with_place).option("rangeBytes", range_bytes)
            .option("filesPerTask", files_per_task).load(pattern))
