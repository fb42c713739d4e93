"""Grouping of spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, so that there are about 2^REDUCED_BITS reduced words of each length: many symbols for
short words, few for long ones. Words at most one edit apart have reduced words at most one edit apart. Each word generates
the one-edit neighbourhood of its reduced word as 64-bit keys, which are joined with the reduced vocabulary. Rows of keys carry
the number of their word only, so that a run of any length costs in proportion; candidates get their words back and are
verified on these. Of the neighbourhood one of two halves is
enough: for a replaced symbol the larger one, for an insertion the deletion from the longer word; the link's other end then
comes from turning it round.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Reduced words of each length, as a power of two.
REDUCED_BITS = 24
#: Least number of symbols.
LEAST_SYMBOLS = 4
#: Letters are dealt to the symbols in turn, by how often they are used; those with accents by code point.
FREQUENT = "etaoinshrdlucmfwypvbgkjqxz"
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 400_000
#: Letters whose neighbourhoods are made in one step.
STEP_LETTERS = 300_000
_runs = re.compile(rb"[a-z\xc0-\xff]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def symbols(length: int) -> int:
    """The size of the reduced alphabet for words of a length; no alphabet has more than the 256 letters of Latin-1."""
    return max(LEAST_SYMBOLS, int(np.ceil(2 ** min(8, REDUCED_BITS / length))))


@lru_cache(maxsize=64)
def reduction(n: int) -> np.ndarray:
    """The symbol, of n, of each Latin-1 letter."""
    table = np.arange(256, dtype=np.uint64) % np.uint64(n)
    for k, letter in enumerate(FREQUENT):
        table[ord(letter)] = k % n
    return table


def variants(doc_id, text: str, edited: int) -> Counter:
    """The words of one text and how often they occur, runs whose checksum `edited` divides being one code point short."""
    out: Counter = Counter()
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_runs(text.encode("latin-1", "replace").lower())).items():  # lowers A-Z alone; one byte a code point
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
        if h % edited == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least_length: int, least_count: int, edited: int) -> DataFrame:
    """(word, n): counted for each document, then for a task's documents, then by word."""

    def run(batches):
        held: Counter = Counter()

        def table() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                for word, n in variants(batch.column(0)[i].as_py(), text, edited).items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield table()
                    held.clear()
        yield table()

    counted = docs.select(id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _values(digits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of n, and each row of digits as a number to the base n, first digit lowest, modulo 2^64."""
    powers = np.cumprod(np.concatenate([[1], np.full(digits.shape[1], n)]).astype(np.uint64), dtype=np.uint64)
    return powers, (digits * powers[:-1]).sum(1, dtype=np.uint64)


def _key(values: np.ndarray, length: int) -> np.ndarray:
    return ((values * _MIX) ^ np.uint64(length * 0xD6E8FEB86659FD93 & 2**64 - 1)).view(np.int64)


def own_keys(codes: np.ndarray) -> np.ndarray:
    """The key of the reduced word of each row of Latin-1 codes."""
    length = codes.shape[1]
    return _key(_values(reduction(symbols(length))[codes], symbols(length))[1], length)


def neighbour_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the reduced word, of those with one symbol replaced by a larger one, and of those one symbol shorter."""
    count, length = codes.shape
    n = symbols(length)
    digits = reduction(n)[codes]
    powers, whole = _values(digits, n)
    rows, keys = [np.arange(count)], [_key(whole, length)]
    for step in range(1, n):
        at = np.nonzero(digits + np.uint64(step) < n)
        rows.append(at[0])
        keys.append(_key(whole[at[0]] + np.uint64(step) * powers[at[1]], length))
    if length > 1:
        n = symbols(length - 1)
        digits = reduction(n)[codes]
        powers, _ = _values(digits, n)
        before = np.zeros(count, np.uint64)
        after = np.zeros((count, length + 1), np.uint64)
        for i in range(length - 1, 0, -1):
            after[:, i] = after[:, i + 1] + digits[:, i] * powers[i - 1]
        for i in range(length):
            once = np.flatnonzero(digits[:, i] != digits[:, i + 1]) if i + 1 < length else np.arange(count)  # equal ones in a row give one word
            rows.append(once)
            keys.append(_key((before + after[:, i + 1])[once], length - 1))
            before = before + digits[:, i] * powers[i]
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(words: DataFrame, every: bool) -> DataFrame:
    """(key, id): the key of each reduced word, or all keys of its neighbourhood."""

    def run(batches):
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), [w.encode("latin-1") for w in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            for length in np.unique(sizes):
                same = np.flatnonzero(sizes == length)
                step = max(1, STEP_LETTERS // int(length))
                for begin in range(0, len(same), step):
                    at = same[begin : begin + step]
                    codes = np.frombuffer(b"".join([raw[i] for i in at]), np.uint8).reshape(len(at), length)
                    rows, keys = neighbour_keys(codes) if every else (np.arange(len(at)), own_keys(codes))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[at[rows]])], ["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def near_words(words: DataFrame) -> DataFrame:
    """(id, near, near_n) for (id, word, n): every two words that differ by exactly one edit, both ways round, once each."""
    own, around = _keyed(words, False).withColumnRenamed("id", "a"), _keyed(words, True).withColumnRenamed("id", "b")
    candidates = around.join(own, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (words.select(F.col("id").alias(k), F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n")) for k in "ab")
    links = candidates.join(a, "a").join(b, "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    ways = [F.struct(F.col(x).alias("id"), F.col(f"{y}_word").alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]
    return links.select(F.explode(F.array(*ways)).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that the forms lead to, by pointer jumping.

    A form is at least twice as frequent as its word, so chains have no ring and are at most log2 of the largest count long.
    """
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, edited: int = 97) -> DataFrame:
    """Words of all whole texts with the more frequent word that each is a variant of.

    Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case; where `edited` divides the
    checksum of `<id>:<run>` the code point at the checksum modulo the length is left out. Words count from `least_length`
    code points and `least_count` occurrences. A word's form is the near word (one code point inserted, deleted or
    replaced) that occurs most, ties by code points, if it occurs at least twice as often.

    Null texts hold no words; a null id stands as nothing before the colon. Rows that repeat count each time; rows with one
    id and different texts are documents of their own. An empty table, or one without such words, gives no rows. Other
    columns are not looked at.
    Columns: word, form, root, n, n_near, form_n.
    """
    words = stored(vocabulary(docs, id_col, text_col, least_length, least_count, edited).withColumn("id", F.monotonically_increasing_id()))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "id", "left")
    leads = F.col("best.less") <= -2 * F.col("n")
    said = stored(joined.select("word", F.when(leads, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, -F.col("best.less")).alias("form_n")))
    last = roots(said.where("form is not null").select("word", "form"))
    return said.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
