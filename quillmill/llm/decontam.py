"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over consecutive words ignore some positions; the hashes of the words at the others are the seeds of a text.
Spark joins the seeds of the benchmark with those of the documents; three bits for each seed of the benchmark, in tables of
fixed size, keep seeds that cannot join, and documents without any other, out of the shuffle. Around the hits the two texts
are aligned on the hits' diagonals and compared word for word, so that substituted words are tolerated.

One rule holds for items of every length: an aligned window of 20 of the item's words (all, if it has fewer) must agree in
at least 0.8 of them. The masks for each length find every such window, also one that hangs over an end of the document;
a test goes through all placements of the substitutions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_lists, in_steps, map_rows, stored
from .tokens import Words, mix

WINDOW = 20
#: The share of a window that must agree, as a fraction: 0.8.
MATCHED = (4, 5)
#: Masks for items of at least so many words; an item takes those of the greatest number that it reaches.
MASKS: dict[int, tuple[str, ...]] = {
    15: ("11111", "110111"),
    5: ("1111", "10111", "11011", "11101"),
    4: ("1111",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}
#: Each of three tables has 2 to the power of so many bits: 6 MB in all, whatever the size of the benchmark.
FILTER_BITS = 24
#: Words that are compared at once.
CELLS = 1_000_000

_COEFFICIENTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def tier_of(n: np.ndarray) -> np.ndarray:
    """For word counts of 1 or more, the key of their masks."""
    out = np.zeros(len(n), np.int64)
    for least in sorted(MASKS):
        out[n >= least] = least
    return out


def seeds_of(words: Words, room: np.ndarray, tier: int) -> tuple[np.ndarray, np.ndarray]:
    """Words from which a mask of the tier fits, and the hash of the words that it looks at; `room` is what is left of the text."""
    places, found = [], []
    for k, mask in enumerate(MASKS[tier]):
        at = np.flatnonzero(room >= len(mask))
        out = np.full(len(at), tier * 8 + k, np.uint64)
        for j, seen in enumerate(mask):
            if seen == "1":
                out += words.hash[at + j] * _COEFFICIENTS[j]
        places.append(at)
        found.append(mix(out))
    return np.concatenate(places), np.concatenate(found)


def _room(words: Words) -> np.ndarray:
    return np.repeat(words.first + words.counts, words.counts) - np.arange(len(words.hash))


def diagonals(hits: list[tuple[np.ndarray, np.ndarray]], n_doc: int, n_item: int) -> np.ndarray:
    """Where the item may begin in the document, from the places of each shared seed in both: at most all ways to lay one on the other."""
    if sum(len(p) * len(q) for p, q in hits) > n_doc + n_item:
        return np.arange(1 - n_item, n_doc)
    return np.unique(np.concatenate([np.subtract.outer(p, q).ravel() for p, q in hits]))


def best_match(item: np.ndarray, doc: np.ndarray, begins: np.ndarray) -> tuple[int, float, int] | None:
    """(words that agree on the diagonal, best share over its windows, begin) of the best diagonal with a sufficient window."""
    n, size = len(item), min(len(item), WINDOW)
    best = None
    step = max(1, CELLS // n)
    for k in range(0, len(begins), step):
        part = begins[k : k + step]
        at = part[:, None] + np.arange(n)[None, :]
        same = (at >= 0) & (at < len(doc))
        same &= doc[np.clip(at, 0, len(doc) - 1)] == item[None, :]
        sums = np.zeros((len(part), n + 1), np.int32)
        np.cumsum(same, axis=1, out=sums[:, 1:])
        window = (sums[:, size:] - sums[:, :-size]).max(axis=1)
        for i in np.flatnonzero(MATCHED[1] * window >= MATCHED[0] * size):
            own = (int(sums[i, -1]), float(window[i] / size), -int(part[i]))
            best = own if best is None else max(best, own)
    return best and (best[0], best[1], -best[2])


def _item_seeds(items: DataFrame) -> DataFrame:
    """(seed, tier, item key, offset) of each seed of (i1, i2, text)."""

    def each(batch: pa.RecordBatch):
        for first, texts in in_steps(batch.column(2).to_pylist()):
            words = Words(texts)
            tier = tier_of(words.counts)
            room = _room(words)
            for own in np.unique(tier[tier > 0]).tolist():
                at, found = seeds_of(words, np.where(tier[words.doc] == own, room, 0), own)
                doc = words.doc[at]
                keys = [batch.column(k).take(pa.array(first + doc)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(at), own)), *keys, pa.array((at - words.first[doc]).astype(np.int32))], ["seed", "tier", "i1", "i2", "offset"])

    return map_rows(items, each, "seed long, tier long, i1 long, i2 long, offset int")


def _hit_documents(docs: DataFrame, tiers: list[int], bits: np.ndarray) -> DataFrame:
    """(doc, d1, d2, seeds, places, hashes) of the rows (doc, d1, d2, text) with seeds that the benchmark may have; hashes are those of all words."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # 6 MB

    def each(batch: pa.RecordBatch):
        tables = sent.value
        for first, part in in_steps(batch.column(3).to_pylist()):
            words = Words(part)
            room = _room(words)
            places, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]  # there may be no tier
            for tier in tiers:
                at, found = seeds_of(words, room, tier)
                for table, probe in zip(tables, _PROBES, strict=True):
                    bit = probe(found)
                    near = np.flatnonzero(table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
                    at, found = at[near], found[near]
                places.append(at)
                seeds.append(found)
            places, seeds = np.concatenate(places), np.concatenate(seeds)
            order = np.argsort(words.doc[places], kind="stable")
            places, seeds = places[order], seeds[order]
            own, counts = np.unique(words.doc[places], return_counts=True)
            keys = [batch.column(k).take(pa.array(first + own)) for k in range(3)]
            hashes = [words.hash[words.first[d] : words.first[d] + words.counts[d]].tobytes() for d in own.tolist()]
            columns = [*keys, as_lists(seeds.view(np.int64), counts, pa.int64()), as_lists((places - words.first[words.doc[places]]).astype(np.int32), counts, pa.int32()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "d1", "d2", "seeds", "places", "hashes"])

    return map_rows(docs.select("doc", "d1", "d2", "text"), each, f"doc {docs.schema['doc'].dataType.simpleString()}, d1 long, d2 long, seeds array<long>, places array<int>, hashes binary")


_LOW = np.uint64((1 << FILTER_BITS) - 1)
_PROBES = (lambda h: h >> np.uint64(64 - FILTER_BITS), lambda h: h >> np.uint64(16) & _LOW, lambda h: (h ^ h >> np.uint64(24)) & _LOW)
_PROBES_SQL = (f"shiftrightunsigned(seed, {64 - FILTER_BITS})", f"shiftrightunsigned(seed, 16) & {_LOW}", f"(seed ^ shiftrightunsigned(seed, 24)) & {_LOW}")


def _filter_bits(seeds: DataFrame) -> np.ndarray:
    """Three bits for each seed, one in each table; at most 3 times 2^18 words of 64 bits come to the driver."""
    bits = seeds.selectExpr(f"posexplode(array({', '.join(_PROBES_SQL)})) as (which, b)").selectExpr("which", "shiftright(b, 6) as word", "shiftleft(1L, cast(b & 63 as int)) as bit")
    found = bits.groupBy("which", "word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros((len(_PROBES), 1 << FILTER_BITS - 6), np.int64)
    out[found.which.to_numpy(np.int64), found.word.to_numpy(np.int64)] = found.bits.to_numpy(np.int64)
    return out.view(np.uint64)


def _verified(pairs: DataFrame) -> DataFrame:
    """(d1, d2, i1, i2, n_words, n_matched, overlap, word_start) of the pairs with both texts and hits that hold."""

    def each(batch: pa.RecordBatch):
        kept: list[int] = []
        out: list[list] = [[], [], [], []]
        last, doc = None, None
        for r in range(batch.num_rows):
            key = (batch.column(0)[r].as_py(), batch.column(1)[r].as_py())
            if key != last:
                last, doc = key, np.frombuffer(batch.column(4)[r].as_py(), np.uint64)
            item = Words([batch.column(5)[r].as_py()]).hash
            hits = [(np.asarray(h["places"], np.int64), np.asarray(h["offsets"], np.int64)) for h in batch.column(6)[r].as_py()]
            if found := best_match(item, doc, diagonals(hits, len(doc), len(item))):
                kept.append(r)
                for column, x in zip(out, (len(item), *found), strict=True):
                    column.append(x)
        keys = [batch.column(k).take(pa.array(kept, pa.int64())) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], ["d1", "d2", "i1", "i2", "n_words", "n_matched", "overlap", "word_start"])

    return map_rows(pairs, each, "d1 long, d2 long, i1 long, i2 long, n_words long, n_matched long, overlap double, word_start long")


def _keyed(rows: DataFrame, id_col: str, text_col: str, name: str, letter: str) -> DataFrame:
    """(id under `name`, two hashes that stand for the text, text) of the rows with a text."""
    text = F.col(text_col)
    return rows.where(text.isNotNull()).select(F.col(id_col).alias(name), F.xxhash64(text).alias(f"{letter}1"), F.xxhash64(F.lit(7), text).alias(f"{letter}2"), text.alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it.

    An item is found where an aligned window of 20 of its words (all, if it has fewer) agrees in at least 0.8 of them; an
    item of fewer than five words thus only whole. Null texts and texts without words hold nothing and are not sought;
    repeated items each count; equal documents each get their rows, and so do rows without an id. Equal texts are compared
    once; the documents are read once. Columns: id, item id, n_words of the item, n_matched on the best diagonal, overlap (best window's share), word_start.
    """
    all_docs, all_items = _keyed(docs, id_col, text_col, "doc", "d"), _keyed(benchmark, item_col, item_text, "item", "i")
    items = stored(all_items.select("i1", "i2", "text").dropDuplicates(["i1", "i2"]))
    seeds = stored(_item_seeds(items))
    tiers = [r.tier for r in seeds.select("tier").distinct().collect()]  # at most as many as MASKS has
    known = stored(_hit_documents(all_docs, sorted(tiers), _filter_bits(seeds)))
    hits = known.select("d1", "d2", F.explode(F.arrays_zip("seeds", "places")).alias("x")).groupBy("d1", "d2", F.col("x.seeds").alias("seed")).agg(F.collect_set("x.places").alias("places"))
    placed = seeds.groupBy("seed", "i1", "i2").agg(F.collect_set("offset").alias("offsets"))
    shared = stored(hits.join(placed, "seed").groupBy("d1", "d2", "i1", "i2").agg(F.collect_list(F.struct("places", "offsets")).alias("hits")))
    texts = known.select("d1", "d2", "hashes").dropDuplicates(["d1", "d2"])
    pairs = shared.join(texts, ["d1", "d2"]).join(items.withColumnRenamed("text", "item_text"), ["i1", "i2"])
    found = stored(_verified(pairs.select("d1", "d2", "i1", "i2", "hashes", "item_text", "hits")))
    rows = found.join(all_items.select("item", "i1", "i2"), ["i1", "i2"]).join(known.select("doc", "d1", "d2"), ["d1", "d2"])
    return rows.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_words", "n_matched", "overlap", "word_start")
