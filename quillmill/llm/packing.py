"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds the lengths over C/(k+1) and up to C/k, and a bin of class k
takes k pieces whatever they are. A document may be cut, so it is cut where classes are exact: whole sequences, then powers
of two down to `least`, whose k pieces fill a bin without padding; only the end, shorter than `least`, stays in a class in
which k pieces leave less than C/(k+1) open. A bin depends on nothing but its class and count, so every task fills its
own, without a shuffle. What is in open bins when a task ends is laid end to end and cut into whole sequences and powers of two,
which need no padding.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import WordBpe

#: Words in each of the two generations that a task remembers.
REMEMBERED_WORDS = 500_000
#: Code points of a word that needs no queue.
SHORT = 24
_NEVER = 1 << 62
_NOT = "\t-\r \x85\xa00-9a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe"
#: The words of a lower-case text of Latin-1 code points; the same as the vocabulary's own pattern, which this one replaces there.
_latin_words = re.compile(f"[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^{_NOT}]+").findall
#: The pattern that `_latin_words` stands for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Known(dict):
    """Word to its packed ids, in two generations: when the young one is full, the old one is forgotten."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.old = bpe, {}
        self.inner = [bpe.vocab[s] for s in bpe.symbols]
        self.final = [bpe.vocab[s + bpe.suffix] for s in bpe.symbols]
        #: Both ids in one number, to rank and merged id in one number, which sorts as the rank does.
        self.merges = {a << 20 | b: rank << 20 | merged for (a, b), (rank, merged) in bpe.merges.items()}

    def short(self, word: str) -> list[int]:
        """The ids of a short word: the lowest of its ranks is sought anew after each merge, which takes less than a queue."""
        raw = word.encode("utf-8", "surrogatepass")
        inner, rank = self.inner, self.merges.get
        ids = [inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        ranks = [rank(a << 20 | b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            merged = ids[i] = least & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(merged << 20 | ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | merged, _NEVER)
        return ids

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            ids = [self.bpe.added[word]] if word in self.bpe.added else self.short(word) if len(word) <= SHORT else self.bpe.encode_word(word)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= REMEMBERED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = packed
        return packed


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Token ids of whole texts as packed little-endian unsigned 32-bit integers."""

    def __init__(self, spec: dict):
        self.bpe = WordBpe(spec)
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.latin = pattern == _PATTERN
        self.known = _Known(self.bpe)

    def words(self, text: str) -> list[str]:
        if self.latin and "<|" not in text and _is_latin(text):
            return _latin_words(text.lower())  # Latin-1 is composed, and has no capital sigma
        return list(self.bpe.parts(text))

    def encode(self, text: str) -> bytes:
        known = self.known
        return b"".join([known[w] for w in self.words(text)])


_encoders: dict[str, Encoder] = {}


def _encoder(spec: dict, digest: str) -> Encoder:
    """The encoder of a vocabulary; the tasks that one Python process runs share it and the words it knows."""
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(spec)
    return _encoders[digest]


def piece_lengths(n: int, capacity: int, least: int) -> list[int]:
    """The lengths that a document of n tokens is cut into."""
    out = [capacity] * (n // capacity)
    rest, bit = n % capacity, capacity // 2
    while bit >= least:
        if rest & bit:
            out.append(bit)
        bit //= 2
    end = rest % least
    return [*out, end] if end else out


class Bins:
    """The open bins of one task. A piece is (document, first token, packed ids, tokens of the document)."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least = capacity, least
        self.open: dict[int, list[tuple]] = {}

    def add(self, document, packed: bytes) -> Iterator[list[tuple]]:
        """Take a document; the sequences that it fills."""
        total, at = len(packed) // 4, 0
        for n in piece_lengths(total, self.capacity, self.least):
            piece = (document, at, packed[4 * at : 4 * (at + n)], total)
            at += n
            k = self.capacity // n
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                del self.open[k]
                yield held

    def close(self) -> Iterator[list[tuple]]:
        """The sequences of what is left: pieces end to end, cut at the capacity and then at powers of two."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) // 4 for p in rest)
        i, used = 0, 0
        while left:
            size = min(self.capacity, 1 << left.bit_length() - 1)
            left -= size
            out = []
            while size:
                document, at, packed, total = rest[i]
                n = min(size, len(packed) // 4 - used)
                out.append((document, at + used, packed[4 * used : 4 * (used + n)], total))
                size -= n
                used += n
                if 4 * used == len(packed):
                    i, used = i + 1, 0
            yield out


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, least: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of at most `capacity` tokens.

    A document's tokens are those of its whole text by the vocabulary file at `path`, then `end_id`; a null or empty text is
    that id alone. Every token is in one piece. A sequence that is not filled and whose length is no power of two is to be
    padded by its reader; of a bin with k short ends that is less than capacity / (k + 1), k >= capacity / least. Rows that
    repeat, null ids and columns of any other name make no difference: each row is a document of its own. An empty table
    gives no rows. A task writes only its own sequences, whole, so one that is run again repeats its result; of pieces it
    holds at most one open bin a class.

    Columns: id, start (tokens of the document before the piece), length, ids_crc32 (unsigned, of the ids as little-endian
    unsigned 32-bit integers), doc_tokens (with `end_id`), sequence_id, offset (in the sequence, gapless from 0).
    """
    if capacity < 1 or capacity & (capacity - 1) or least < 1 or least & (least - 1) or least > capacity:
        raise ValueError("capacity and least must be powers of two, least at most capacity")
    rows = docs.select(id_col, text_col)
    with open(path, "rb") as f:
        raw = f.read()
    spec, digest = docs.sparkSession.sparkContext.broadcast(json.loads(raw)), hashlib.sha256(raw).hexdigest()  # the vocabulary: the same size for any input
    kind = rows.schema[id_col].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        encoder, bins, n_sequences = _encoder(spec.value, digest), Bins(capacity, least), 0

        def table(sequences: list[list[tuple]], id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal n_sequences
            columns: list[list] = [[] for _ in range(7)]
            for pieces in sequences:
                offset = 0
                for document, at, packed, total in pieces:
                    n = len(packed) // 4
                    for column, x in zip(columns, (document, at, n, zlib.crc32(packed), total, first + n_sequences, offset), strict=True):
                        column.append(x)
                    offset += n
                n_sequences += 1
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        id_type = pa.null()
        for batch in batches:
            id_type, done = batch.schema.field(0).type, []
            for i in range(batch.num_rows):
                done += bins.add(batch.column(0)[i].as_py(), encoder.encode(batch.column(1)[i].as_py() or "") + end)
                if len(done) > 1000:
                    yield table(done, id_type)
                    done = []
            yield table(done, id_type)
        if bins.open:
            yield table(list(bins.close()), id_type)

    return rows.mapInArrow(run, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
