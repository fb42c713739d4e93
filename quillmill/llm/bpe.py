"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked symbol list, and its decoding.

The vocabulary file of a public tokenizer is read once on the driver and sent to the executors; its size does not depend
on the data. Each task keeps a bounded table of words it has already encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Words whose codes a task remembers before it starts anew.
REMEMBERED_WORDS = 300_000

# Fixed values from the Unicode data: what the library's tables, older or newer than Python's, see otherwise.
#: Combining marks assigned after Unicode 9, and the parts of the one pair composed since: they neither reorder nor compose.
LATE_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF "
    "10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 "
    "11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Letters and numbers assigned after Unicode 16: not yet letters or numbers.
LATE_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Capitals assigned after Unicode 15: ranges and how far on their small letters stand.
LATE_CAPITALS = (("1C89 A7CC A7CE A7D2 A7D4 A7DA", 1), ("A7CB", 0x264 - 0xA7CB), ("A7DC", 0x19B - 0xA7DC), ("10D50-10D65", 0x20), ("16EA0-16EB8", 0x1B))


def code_points(ranges: str) -> list[int]:
    """The code points of ranges such as `07FD 0898-089F`."""
    return [i for part in ranges.split() for a, _, b in [part.partition("-")] for i in range(int(a, 16), int(b or a, 16) + 1)]


def _one_of(ranges: str) -> str:
    return "[" + "".join(f"\\U{a:0>8}-\\U{b or a:0>8}" for part in ranges.split() for a, _, b in [part.partition("-")]) + "]"


_SMALL = {i: i + step for ranges, step in LATE_CAPITALS for i in code_points(ranges)}
_late_marks = re.compile(f"({_one_of(LATE_MARKS)})")
_LATE = frozenset(map(chr, code_points(f"{LATE_MARKS} {LATE_LETTERS} {' '.join(r for r, _ in LATE_CAPITALS)}")))
_beyond = re.compile(f"[{min(_LATE)}-\U0010ffff]").search


def _late(text: str) -> bool:
    """Whether any of these code points stands in the text."""
    return not text.isascii() and _beyond(text) is not None and not _LATE.isdisjoint(text)



def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary with an end-of-word suffix, as its JSON file describes it."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in (*self.vocab.items(), *self.added.items())}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern, regex.V1).findall
        new = _one_of(LATE_LETTERS)
        for kind in "LN":
            pattern = pattern.replace(f"[\\p{{{kind}}}]", f"(?:(?!{new})\\p{{{kind}}})")
        #: For texts with code points that the library's tables do not know: those are neither letters nor numbers.
        self.late_words = regex.compile(pattern.replace("[^\\s\\p{L}\\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{new})"), regex.V1).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.symbols = byte_symbols()

    @classmethod
    def from_file(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def normalize(self, text: str) -> str:
        """NFC and lower case one character at a time (a final sigma is no exception)."""
        if text.isascii():
            return text.lower()
        if _late(text):
            parts = _late_marks.split(text)
            parts[::2] = (unicodedata.normalize("NFC", x) for x in parts[::2])
            text = "".join(parts).translate(_SMALL)
        else:
            text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def split(self, text: str) -> list[str]:
        """The words of a text, normalised; white space parts them, of whatever kind it is."""
        return (self.late_words if _late(text) else self.words)(self.normalize(text))

    def encode_word(self, word: str) -> list[int]:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges.get
        queue = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of the two has merged since
            ids[i], ids[j] = self.merges[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges((ids[i], ids[k])):
                    heapq.heappush(queue, (m[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (m := merges((ids[h], ids[i]))):
                heapq.heappush(queue, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def parts(self, text: str) -> Iterable[str]:
        """The words of a text and, as they stand, the special strings in it."""
        if self.specials is None:
            return self.split(text)
        pieces = self.specials(text)
        if len(pieces) == 1:
            return self.split(text)
        out: list[str] = []
        for k, piece in enumerate(pieces):
            out += [piece] if k % 2 else self.split(piece)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.parts(text) for i in ([self.added[w]] if w in self.added else self.encode_word(w))]

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary's strings one after another, with a blank between, as no decoder is set."""
        return " ".join(self.strings[i] for i in ids)


class _Known(dict):
    """Word to its packed ids and decoded string; starts anew when full."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = [self.bpe.added[word]] if word in self.bpe.added else self.bpe.encode_word(word)
        found = struct.pack(f"<{len(ids)}I", *ids), self.bpe.decode(ids)
        self[word] = found
        return found


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """Token ids of every whole text and the text decoded from them.

    A null or empty text has no tokens and decodes to the empty string. Columns: id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of UTF-8), and where asked for `ids` and `decoded` themselves.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(json.load(f))  # the vocabulary: the same size for any input
    known: list = []

    def each(batch: pa.RecordBatch):
        if not known:
            known.append(_Known(WordBpe(spec.value)))
        table = known[0]
        bpe = table.bpe
        out: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            if len(table) > REMEMBERED_WORDS:
                table.clear()
            pieces = [table[w] for w in bpe.parts(text)]
            packed = b"".join([p[0] for p in pieces])
            said = " ".join([p[1] for p in pieces if p[0]])
            out[0].append(len(packed) // 4)
            out[1].append(hashlib.sha256(packed).hexdigest())
            out[2].append(hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest())
            if ids:
                out[3].append(list(struct.unpack(f"<{len(packed) // 4}I", packed)))
            if decoded:
                out[4].append(said)
        columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            columns.append(pa.array(out[3], pa.list_(pa.int64())))
            names.append("ids")
        if decoded:
            columns.append(pa.array(out[4], pa.string()))
            names.append("decoded")
        yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(id_col, text_col)
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(rows, each, schema + ", ids array<long>" * ids + ", decoded string" * decoded)
