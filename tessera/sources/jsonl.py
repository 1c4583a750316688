"""Lines of JSON as a data source of Spark: files of any size are read in ranges of bytes, and written in batches that are there as a whole or not at all.

Reading. A line belongs to the range in which it begins, so ranges are read by themselves, wherever they end. A line's number is its place in its range and the number of
lines in the ranges before, which are counted by the same source; no file is copied. Lines end with a line feed, a carriage return, or both, and count as the language of the records takes them: white space around
them is left off, of a repeated key the last one counts, NaN and Infinity are numbers.

Writing. Each task writes a file of its own; when all have, a manifest of the batch names them, which is written last. Readers take the files that manifests name, so what a lost task or a killed run has written is not
seen; a batch that is repeated is written once.

Files are opened where the tasks run, by Arrow: local folders, HDFS, S3 and others that it knows.

Defined cases: a file without a line break at its end has a last line all the same; an empty file has none; a line that is not UTF-8 is no JSON; a folder in which no batch was written is read file by file, without those whose names
begin with a point or an underscore."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.session import ship

FORMAT = "tessera_jsonl"
#: Bytes of a range, of a read, and of the lines of a batch of rows.
RANGE, BLOCK, BATCH = 64 << 20, 1 << 20, 4 << 20

_LINES = "file string, start long, at long, value string, keys array<string>, error string, reason string, last string"
_COUNTS = "file string, start long, n long"
_BREAK = re.compile(rb"\r\n|\n|\r")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if re.match(r"file:/[^/]", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _manifests(system: fs.FileSystem, folder: str) -> list[dict] | None:
    """What the manifests under a folder say, by batch; none if there is no folder of manifests."""
    found = system.get_file_info(fs.FileSelector(f"{folder}/_batches", allow_not_found=True))
    whole = sorted(x.path for x in found if x.path.endswith(".json"))
    if not found and system.get_file_info(f"{folder}/_batches").type == fs.FileType.NotFound:
        return None
    return [json.loads(system.open_input_stream(p).read()) for p in whole]


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files to be read under a path."""
    system, place = opened(path)
    if (info := system.get_file_info(place)).type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    manifests = _manifests(system, place)
    prefix = path.rstrip("/")
    if manifests is not None:
        return [(f"{prefix}/{name}", size) for m in manifests for name, size in m["files"]]
    files = (x for x in system.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.base_name[0] not in "._")
    return sorted((f"{prefix}/{x.base_name}", x.size) for x in files)


def lines_from(stream: pa.NativeFile, start: int, end: int, block: int = BLOCK) -> Iterator[bytes]:
    """The lines, without their ends, that begin in the bytes start:end of a file."""
    # the byte before tells whether a line begins at ``start``
    at = max(start - 1, 0)
    stream.seek(at)
    data, more = b"", True
    begin = 0 if start == 0 else None  # of the line in ``data``
    scanned = 0
    while True:
        found = _BREAK.search(data, scanned)
        if found and (found.end() < len(data) or found[0] != b"\r" or not more):
            if begin is not None:
                yield data[begin : found.start()]
            if at + found.end() >= start:
                begin = found.end()
                if at + begin >= end:
                    return
            scanned = found.end()
            continue
        if not more:
            break
        # a line feed may follow a carriage return, and a line may be longer than a block
        keep = begin if begin is not None else scanned
        scanned = (found.start() if found else len(data)) - keep
        data, at = data[keep:], at + keep
        begin = 0 if begin is not None else None
        piece = stream.read(block)
        more, data = len(piece) > 0, data + piece
    if begin is not None and begin < len(data):
        yield data[begin:]


def parsed(line: bytes) -> tuple[str, list[str] | None, str | None, str | None, str | None]:
    """(text, keys, error, reason, last) of a line: keys of an object, in order, or why it is none; where keys are repeated, ``last`` is the text with the last of each."""
    try:
        text = line.decode()
    except UnicodeDecodeError as bad:
        return line.decode(errors="replace").strip(), None, "Invalid JSON", str(bad), None
    text, repeated = text.strip(), False
    if not text:
        return text, None, "Empty line", "Empty line", None

    def last(pairs: list[tuple]) -> dict:
        nonlocal repeated
        own = dict(pairs)
        repeated |= len(own) < len(pairs)
        return own

    try:
        found = json.loads(text, object_pairs_hook=last)
        again = json.dumps(found, ensure_ascii=False) if repeated else None
    except (ValueError, RecursionError) as bad:
        return text, None, "Invalid JSON", str(bad), None
    return (text, list(found), None, None, again) if isinstance(found, dict) else (text, None, "Invalid JSON", f"a {type(found).__name__} is no record", None)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.count, self.range = options["path"], options.get("count", "").lower() == "true", int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        cuts = [Range(file, a, min(a + self.range, size)) for file, size in listed(self.path) for a in range(0, size, self.range)]
        return cuts or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        system, place = opened(part.file)
        with system.open_input_file(place) as stream:
            own = lines_from(stream, part.start, part.end)
            if self.count:
                yield pa.RecordBatch.from_arrays([pa.array([part.file]), pa.array([part.start], pa.int64()), pa.array([sum(1 for _ in own)], pa.int64())], names=["file", "start", "n"])
                return
            held, size = [], 0
            for at, line in enumerate(own):
                held.append((part.file, part.start, at, *parsed(line)))
                size += len(line) + 100
                if size >= BATCH:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"file": pa.string(), "start": pa.int64(), "at": pa.int64(), "value": pa.string(), "keys": pa.list_(pa.string()), "error": pa.string(), "reason": pa.string(), "last": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.batch = options["path"].rstrip("/"), options.get("batch") or uuid.uuid4().hex
        if overwrite or not re.fullmatch(r"[A-Za-z0-9_-]+", self.batch):
            raise ValueError("batches are appended, and named by letters, digits, _ and -")
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        name, rows = f"part-{self.batch}-{self.job}-{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    out.write(line.encode() + b"\n")
                    rows += 1
        return Written(name, system.get_file_info(f"{folder}/{name}").size, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        system.create_dir(f"{folder}/_batches", recursive=True)
        whole = f"{folder}/_batches/{self.batch}.json"
        known = system.get_file_info(whole).type != fs.FileType.NotFound
        files = [[m.name, m.size] for m in messages if m and m.rows]
        if not known:
            with system.open_output_stream(f"{folder}/_batches/.{self.job}") as out:
                out.write(json.dumps({"batch": self.batch, "rows": sum(m.rows for m in messages if m), "files": files}).encode())
            system.move(f"{folder}/_batches/.{self.job}", whole)
        # what other runs of this batch, or this one if it came too late, have left
        stay = {name for m in _manifests(system, folder) or [] if m["batch"] == self.batch for name, _ in m["files"]}
        for x in system.get_file_info(fs.FileSelector(folder)):
            if x.base_name.startswith(f"part-{self.batch}-") and x.base_name not in stay:
                system.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.base_name.startswith(f"part-{self.batch}-{self.job}-"):
                system.delete_file(x.path)


class JsonLines(DataSource):
    """Options: ``path``; to read, ``range`` (bytes) and ``count`` (a row for each range, with its number of lines); to write, ``batch``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _COUNTS if self.options.get("count", "").lower() == "true" else _LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def source(spark: SparkSession) -> str:
    """Make the source known to a session; its name."""
    ship(spark)
    spark.dataSource.register(JsonLines)
    return FORMAT


def json_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(file, line, value, keys, error, reason, last): every line of the files under a path with its number from 1. error: null, 'Empty line' or 'Invalid JSON', and ``reason`` says why; last: the line with the last
    of each repeated key, where there are such, else null."""
    own = spark.read.format(source(spark)).option("path", path).option("range", range_bytes)
    counts = own.option("count", True).load()
    # a row for each range of a file
    before = counts.select("file", "start", (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("before"))
    lines = own.option("count", False).load()
    # a source of Python's own has no size for Spark to go by; all lines would be shuffled and sorted to meet a row for each range
    return lines.join(F.broadcast(before), ["file", "start"]).select("file", (F.col("before") + F.col("at") + 1).alias("line"), "value", "keys", "error", "reason", "last")


def batches_of(path: str) -> dict[str, int]:
    """The batches that are whole under a path, and their numbers of rows."""
    system, place = opened(path)
    return {m["batch"]: m["rows"] for m in _manifests(system, place.rstrip("/")) or []}


def append_jsonl(rows: DataFrame, path: str, batch: str) -> bool:
    """Append rows as a batch: all of them or none. Whether they were written; a batch that is there is not computed again."""
    if batch in batches_of(path):
        return False
    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format(source(rows.sparkSession)).option("path", path).option("batch", batch).mode("append").save()
    return True
