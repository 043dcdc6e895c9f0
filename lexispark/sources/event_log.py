"""A log of lines as a data source of its own: read in byte ranges, followed as a stream, appended to once for each commit.

Below a folder lie files of lines and, for each append, a mark with its number that names its files. Readers see what is
marked, whole appends only. A task that is tried again writes another file; only the files of the tasks that succeeded
are marked, so no line is there twice.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
)

#: Bytes of a range.
RANGE = 8 << 20
LINES = "append bigint, file string, start bigint, value string"


def _open(path: str) -> tuple[files.FileSystem, str]:
    fs, root = files.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs, root.rstrip("/")


def marks(path: str) -> list[int]:
    """The numbers of the log's appends, in order."""
    fs, root = _open(path)
    found = fs.get_file_info(files.FileSelector(f"{root}/marks", allow_not_found=True))
    return sorted(int(f.base_name) for f in found if f.base_name.isdigit())


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in a range of bytes."""

    append: int
    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: a file, and how many lines."""

    file: str
    lines: int


def ranges(path: str, after: int, until: int, size: int = RANGE) -> list[Range]:
    """The ranges of the appends after one and up to another."""
    fs, root = _open(path)
    out = []
    for n in (n for n in marks(path) if after < n <= until):
        with fs.open_input_stream(f"{root}/marks/{n}") as f:
            named = json.loads(f.read())
        for file, length in named:
            out += [Range(n, file, at, min(at + size, length)) for at in range(0, length, size)]
    return out


def read_range(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin in the range; the last one is read to its end, beyond the range if need be."""
    fs, root = _open(path)
    starts, lines = [], []
    with io.BufferedReader(fs.open_input_file(f"{root}/lines/{part.file}")) as f:
        at = part.start
        if at:  # a line that begins before the range isn't ours
            f.seek(at - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(0)
        while at < part.end:
            line = f.readline()
            starts.append(at)
            lines.append(line.rstrip(b"\n").decode("utf-8", "replace"))
            at += len(line)
            if len(lines) == 4096:
                yield _batch(part, starts, lines)
                starts, lines = [], []
    if lines:
        yield _batch(part, starts, lines)


def _batch(part: Range, starts: list[int], lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([part.append] * n, pa.int64()), pa.array([part.file] * n), pa.array(starts, pa.int64()), pa.array(lines)],
        [f.split()[0] for f in LINES.split(", ")]
    )


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return ranges(self.path, -1, max(marks(self.path), default=-1), self.size) or [Range(-1, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from read_range(self.path, partition)


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of appends."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"append": -1}

    def latestOffset(self) -> dict:
        return {"append": max(marks(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self.path, start["append"], end["append"], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(self.path, partition)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        """A task's lines, in a file of its own; line ends inside a value become spaces, as a line is one."""
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/lines")
        file, n = f"{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{root}/lines/{file}") as out:
            for row in iterator:
                if row[0] is not None:
                    out.write(row[0].replace("\r", " ").replace("\n", " ").encode() + b"\n")
                    n += 1
        return Written(file, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        own = [m.file for m in messages if m and m.lines]
        named = [(file, fs.get_file_info(f"{root}/lines/{file}").size) for file in own]
        fs.create_dir(f"{root}/marks")
        n = max(marks(self.path), default=-1) + 1
        with fs.open_output_stream(f"{root}/marks/.{n}") as out:
            out.write(json.dumps(named).encode())
        fs.move(f"{root}/marks/.{n}", f"{root}/marks/{n}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/lines/{m.file}")


class EventLog(DataSource):
    """``format("event_log")``, with the options path and, for reading, rangeBytes. Written is one column of texts."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return LINES

    def _of(self, make):
        return make(self.options["path"], int(self.options.get("rangeBytes", self.options.get("rangebytes", RANGE))))

    def reader(self, schema) -> DataSourceReader:
        return self._of(_Reader)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return self._of(_Stream)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is appended to")
        return _Writer(self.options["path"])


def use_event_log(spark: SparkSession) -> None:
    """Make ``format("event_log")`` known to a session."""
    spark.dataSource.register(EventLog)
