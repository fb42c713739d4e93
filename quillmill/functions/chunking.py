"""Chunks and blocks of texts: bounded windows with exact offsets in code points."""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BYTES, MAX_OVERLAP, BLOCK_CHARS = 1200, 100, 1200
#: Characters of bodies that a task gathers before it gives them away, and those that a part's other columns count for.
OUT_CHARS, PART_CHARS = 1 << 20, 256


def split_text(text: str, max_bytes: int = MAX_BYTES) -> Iterator[tuple[int, int, int]]:
    """(part, start, end): the longest prefix within the bytes, cut back to a line end in its second half; parts overlap."""
    start, part, n = 0, 0, len(text)
    while start < n:
        piece = text[start : start + max_bytes].encode("utf-8", "surrogatepass")[:max_bytes]
        end = start + max(1, len(piece.decode("utf-8", "ignore")))
        if end < n:
            line = text.rfind("\n", start + (end - start) // 2, end)
            if line >= start:
                end = line + 1
        if text[start:end].strip():
            yield part, start, end
        part += 1
        if end >= n:
            return
        start = max(start + 1, end - min(MAX_OVERLAP, (end - start) // 5))


_NEWLINE = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
# What opens a fence and what is a heading.
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\r\n]*)")
_HEADING = re.compile(r" {0,3}#{1,6}\s+(.+?)(?:\r?\n)?$")
_LABEL = 80


def _lines(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _NEWLINE.finditer(text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _begins(text: str) -> Iterator[tuple[int, int, str, str]]:
    yield 0, 1, "section", "Text"
    fence = ""
    for number, (a, b) in enumerate(_lines(text), 1):
        line = text[a:b]
        if fence:
            mark = line.rstrip("\r\n").rstrip(" \t")
            bare = mark.lstrip(" ")
            if len(mark) - len(bare) <= 3 and len(bare) >= len(fence) and not bare.strip(fence[0]):
                fence = ""
                yield b, number + 1, "section", "Text"
        elif m := _FENCE.match(line):
            fence = m[1]
            yield a, number, "fenced_code", f"Code {m[2].strip()}"[:_LABEL]
        elif h := _HEADING.match(line):
            yield a, number, "section", h[1].strip()[:_LABEL]


def _units(text: str) -> Iterator[tuple[int, int, int, str, str]]:
    """(start, end, first line, kind, label): sections between headings, and fenced code up to the fence that closes it."""
    for (a, number, kind, label), (b, *_) in pairwise(chain(_begins(text), [(len(text),)])):
        if a < b:
            yield a, b, number, kind, label


def _blocks(text: str) -> Iterator[tuple[int, int, str, str, int, int]]:
    """The blocks of `split_blocks` one by one; of the whole text only its line ends are held beside it, four bytes each.

    Cuts are looked up in the list of all line ends: a window ends at the last of them within `BLOCK_CHARS`, or there where
    it has none, but never between a carriage return and its line feed. Lines are numbered by the ends before a place.
    """
    ends = array("i", (b for _, b in _lines(text)))

    def cut(a: int, end: int) -> int:
        most = a + BLOCK_CHARS
        if most >= end:
            return end
        k = bisect_right(ends, most) - 1
        if k >= 0 and ends[k] > a:
            return ends[k]
        return most - (text[most - 1 : most + 1] == "\r\n")

    for begin, end, _, kind, label in _units(text):
        cuts = [begin, end]
        if kind != "fenced_code":
            while cuts[-2] < (at := cut(cuts[-2], end)) < end:
                cuts.insert(-1, at)
        windowed = kind if len(cuts) == 2 else f"{kind}_window"
        for a, b in pairwise(cuts):
            yield a, b, windowed, label, bisect_right(ends, a) + 1, bisect_left(ends, b) + 1


def split_blocks(text: str) -> list[tuple[int, int, str, str, int, int]]:
    """(start, end, kind, label, first line, last line), without gaps: fenced code stays whole, long sections go in windows."""
    return list(_blocks(text))


def block_id(revision: str, start: int, end: int) -> str:
    return "b" + hashlib.sha256(f"{revision}:{start}:{end}".encode()).hexdigest()[:20]


def _written(batch: pa.RecordBatch, parts: Callable[[str], Iterator[tuple]], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The parts of a batch's texts, the last of each its body. Texts are taken one by one and the parts given away when their
    bodies, and `PART_CHARS` for each, have `OUT_CHARS`, so that no more of a batch than that is held beside it."""
    ids, texts = batch.columns
    at, rows, held = [], [[] for _ in types], 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *map(pa.array, rows, types)], names)

    for i in range(batch.num_rows):
        for part in parts(texts[i].as_py() or ""):
            at.append(i)
            for column, x in zip(rows, part, strict=True):
                column.append(x)
            held += len(part[-1]) + PART_CHARS
            if held >= OUT_CHARS:
                yield given()
                at, rows, held = [], [[] for _ in types], 0
    if at:
        yield given()


def chunks(df: DataFrame, id_col: str, text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, part, start, end, body) of every text; none for a null or blank one."""

    def parts(text: str) -> Iterator[tuple]:
        return ((part, a, b, text[a:b]) for part, a, b in split_text(text, max_bytes))

    def run(batches):
        for batch in batches:
            yield from _written(batch, parts, [*[pa.int32()] * 3, pa.string()], [id_col, "part", "start", "end", "body"])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, part int, start int, end int, body string")


def blocks(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, start, end, kind, label, first_line, last_line, block_id, body) of every text, without gaps."""

    def parts(text: str) -> Iterator[tuple]:
        revision = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return ((a, b, first, last, kind, label, block_id(revision, a, b), text[a:b]) for a, b, kind, label, first, last in _blocks(text))

    def run(batches):
        for batch in batches:
            yield from _written(batch, parts, [*[pa.int32()] * 4, *[pa.string()] * 4], [id_col, "start", "end", "first_line", "last_line", "kind", "label", "block_id", "body"])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, start int, end int, first_line int, last_line int, kind string, label string, block_id string, body string")
