"""Append-only line files read by byte ranges: a Spark data source, for streams and for tables, that reads only what is new.

An offset says of each file how far its complete lines have been read, with the hash of its first line and of the bytes before
the offset. A file that is shorter than its offset, or whose hashes are others, starts anew. Only the driver's listing
and these few bytes are looked at to plan; ranges of `rangeBytes` are then read by tasks, so a file of any size is spread.

    spark.dataSource.register(TranscriptLines)
    spark.readStream.format("transcript_lines").option("path", folder).load()
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD, EDGE, STEP, RANGE = 1 << 16, 1 << 10, 1 << 20, 32 << 20
SCHEMA = "path string, at long, line string"
BATCH_LINES = 10_000


def opened(path: str):
    system, own = fs.FileSystem.from_uri(path)
    return system.open_input_file(own)


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _bytes(file, begin: int, end: int) -> bytes:
    file.seek(begin)
    return file.read(max(0, end - begin))


def line_end(file, low: int, high: int) -> int:
    """The end of the last complete line within [low, high); `low` where there is none."""
    at = high
    while at > low:
        begin = max(low, at - STEP // 16)
        if (found := _bytes(file, begin, at).rfind(b"\n")) >= 0:
            return begin + found + 1
        at = begin
    return low


def entry(path: str, size: int, low: int = 0, most: int | None = None) -> list | None:
    """[offset, hash of the first line, hash of the bytes before the offset], from `low` on at most `most` bytes; None without a complete line."""
    with opened(path) as file:
        end = line_end(file, low, size if most is None else min(size, low + most))
        if not end:
            return None
        first = _bytes(file, 0, min(HEAD, end)).split(b"\n", 1)[0]
        return [end, _sha(first), _sha(_bytes(file, max(0, end - EDGE), end))]


def listed(folder: str, suffix: str) -> list[tuple[str, int, int]]:
    """(path, size, time) of the files below a folder."""
    system, own = fs.FileSystem.from_uri(folder)
    scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
    files = system.get_file_info(fs.FileSelector(own, recursive=True, allow_not_found=True))
    return sorted((scheme + f.path, f.size, f.mtime_ns or 0) for f in files if f.type == fs.FileType.File and f.path.endswith(suffix))


def resumed(path: str, size: int, old: list | None) -> tuple[int, bool]:
    """Where to go on in a file, and whether that is its beginning although it was read before."""
    if old is None:
        return 0, False
    offset, head, edge = old
    if offset > size:
        return 0, True
    with opened(path) as file:
        same = _sha(_bytes(file, 0, min(HEAD, offset)).split(b"\n", 1)[0]) == head and _sha(_bytes(file, max(0, offset - EDGE), offset)) == edge
    return (offset, False) if same else (0, True)


@dataclass
class Span(InputPartition):
    """Lines that begin in [begin, stop) of a file; the range of the file that is read ends at `high`, a line's end."""

    path: str
    begin: int
    stop: int
    low: int
    high: int


def spans(path: str, low: int, high: int, size: int) -> list[Span]:
    return [Span(path, a, min(high, a + size), low, high) for a in range(low, high, size)]


def lines_of(span: Span) -> Iterator[tuple[int, bytes]]:
    """(at, line without its end) of a span, read in steps."""
    with opened(span.path) as file:
        at = span.begin
        if at > span.low:  # the line that begins here, if one does; else the next one
            at -= 1
        held, asked = b"", at
        skip = at < span.begin
        while True:
            cut = held.find(b"\n")
            if cut < 0:
                more = _bytes(file, asked, min(span.high, asked + STEP))
                if not more:
                    return
                asked += len(more)
                held += more
                continue
            lines = held.split(b"\n")
            held = lines.pop()
            for line in lines:
                if skip:
                    skip = False
                elif at >= span.stop:
                    return
                else:
                    yield at, line
                at += len(line) + 1
            if at >= span.stop and not skip:
                return


def _batches(span: Span) -> Iterator[pa.RecordBatch]:
    places: list[int] = []
    texts: list[str] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([span.path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["path", "at", "line"])
        places.clear()
        texts.clear()
        return out

    size = 0
    for at, line in lines_of(span):
        if line.strip():
            places.append(at)
            texts.append(line.decode("utf-8", "replace"))
            size += len(line)
        if len(places) >= BATCH_LINES or size >= STEP * 8:
            yield batch()
            size = 0
    if places:
        yield batch()


class _Planner:
    def __init__(self, options):
        self.folder, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.size, self.header = int(options.get("rangeBytes", RANGE)), options.get("header", "true") == "true"
        self.known: dict[str, tuple] = {}

    def latest(self) -> dict:
        """The entry of each file; a file whose size and time are as before is not opened again."""
        out = {}
        for path, size, time in listed(self.folder, self.suffix):
            if self.known.get(path, ())[:2] != (size, time):
                self.known[path] = size, time, entry(path, size)
            if found := self.known[path][2]:
                out[path] = found
        return out

    def plan(self, old: dict, new: dict) -> list[Span]:
        out = []
        for path, found in new.items():
            if old.get(path) == found:
                continue
            low, _ = resumed(path, found[0], old.get(path))
            if self.header and low:
                with opened(path) as file:
                    first = _bytes(file, 0, min(HEAD, low)).find(b"\n") + 1
                out += spans(path, 0, first, max(1, first))
            out += spans(path, low, found[0], self.size)
        return out


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.planner, self.options = _Planner(options), options

    def partitions(self):
        given = json.loads(self.options.get("ranges", "null"))
        if given is not None:
            return [s for path, low, high in given for s in spans(path, low, high, self.planner.size)] or [Span("", 0, 0, 0, 0)]
        return self.planner.plan({}, self.planner.latest()) or [Span("", 0, 0, 0, 0)]

    def read(self, partition):
        return _batches(partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.planner = _Planner(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.planner.latest()

    def partitions(self, start: dict, end: dict):
        return self.planner.plan(start, end)

    def read(self, partition):
        return _batches(partition)

    def commit(self, end: dict) -> None:
        pass


class TranscriptLines(DataSource):
    """(path, at, line): complete lines that are not blank, `at` being the byte where a line begins.

    Options: `path`, a folder that driver and executors see, local or by a URI that pyarrow knows; `suffix` (.jsonl);
    `rangeBytes` (32 MB); `header` (true: the first line comes along with the new lines of a file that was read before).
    An offset of a stream has one entry a file. A last line without its end waits; bytes that are no UTF-8 are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TranscriptLines)
