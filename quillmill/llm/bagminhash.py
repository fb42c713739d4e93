"""Near-duplicate documents by BagMinHash over multisets of word shingles.

Each shingle with its count as weight runs hierarchical Poisson processes over the discretised weight axis: one for the
first unit and one for each doubling (1, 2], (2, 4], ...; the points of a layer that the weight covers only in part are
thinned by their place. The earliest point that falls on each register is the signature, whose agreement rate is the
weighted Jaccard similarity without bias. Bands of registers are joined, and each candidate pair's multisets are compared.

Documents with equal multisets are one class from the start. Within a band's bucket each text is first compared with the
bucket's smallest, not with all others. Buckets whose texts are still in different classes after that are compared whole,
in pairs of tiles of bounded size that emit a spanning forest of their links; so no link is lost, and no list of pairs is
ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_lists, cut_lineage, in_steps, map_rows, stored
from .graph import connected_components, forest
from .tokens import Words, mix, window_hash

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
TILE_SHINGLES, TILE_ROWS = 150_000, 400
#: Partners of one text that are compared in one place.
PARTNERS = 256
_SALT = np.uint64(0x8CB92BA72F3D8DD7)


def multisets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and count of each distinct shingle, by text and then hash."""
    shingles, doc = window_hash(Words(texts), size)
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], shingles[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The earliest points, one row of registers for each document; the largest number where it has no shingles.

    Times are whole multiples of 2^-36, so that their sums are the same however the points are dealt into blocks.
    """
    out = np.full(n_docs * registers, np.iinfo(np.int64).max)
    layers = [(doc, element, weight, 0, 1)]
    low = 1
    while (more := weight > low).any():
        layers.append((doc[more], element[more], weight[more], low, 2 * low))
        low *= 2
    doc, element, weight, low, high = (np.concatenate([np.broadcast_to(np.asarray(x[k]), x[0].shape) for x in layers]) for k in range(5))
    seed = mix(element ^ (low.astype(np.uint64) * _SALT))
    rate = (high - low).astype(float)
    time, made = np.zeros(len(doc), np.int64), 0
    while len(doc):
        block = int(np.clip(2048 // len(doc), 1, 64))
        steps = (np.arange(made, made + block, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        draw = mix(seed[:, None] + steps[None, :])
        gap = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        when = np.cumsum(np.rint(gap * 2.0**36).astype(np.int64), axis=1) + time[:, None]
        other = mix(draw ^ _SALT)
        register = (other >> np.uint64(40)) % np.uint64(registers)
        place = low[:, None] + np.floor((other & np.uint64(0xFFFFFF)).astype(float) * 2.0**-24 * rate[:, None])
        inside = (place < weight[:, None]).ravel()
        slot = (np.repeat(doc, block) * registers + register.ravel().astype(np.int64))[inside]
        np.minimum.at(out, slot, when.ravel()[inside])
        time = when[:, -1]
        latest = out.reshape(n_docs, registers).max(axis=1)
        going = time < latest[doc]
        doc, weight, low, seed, rate, time = doc[going], weight[going], low[going], seed[going], rate[going], time[going]
        made += block
    return out.reshape(n_docs, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(-1, bands, rows)
    out = np.full(bits.shape[:2], 1, np.uint64) * (np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for r in range(rows):
        out = mix(out * _SALT + bits[:, :, r])
    return out


def _signed(df: DataFrame) -> DataFrame:
    """(id, digest of the multiset, shingles, band hashes) of each document."""

    def each(batch: pa.RecordBatch):
        for first, texts in in_steps(batch.column(1).to_pylist()):
            doc, element, weight = multisets(texts)
            n = len(texts)
            hashes = band_hashes(signatures(doc, element, weight, n, BANDS * ROWS), BANDS, ROWS)
            total = np.bincount(doc, weight, n).astype(np.int64)
            digests = []
            for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
                sums = np.zeros(n, np.uint64)
                np.add.at(sums, doc, mix(element ^ salt) * weight.astype(np.uint64))
                digests.append(sums.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[first : first + n], *map(pa.array, digests), pa.array(total), as_lists(hashes.view(np.int64).ravel(), np.full(n, BANDS), pa.int64())],
                ["id", "k1", "k2", "n", "bands"],
            )

    kind = df.schema["id"].dataType.simpleString()
    return map_rows(df, each, f"id {kind}, k1 long, k2 long, n long, bands array<long>")


def _similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets of shingles have a weighted Jaccard similarity of THRESHOLD or more.

    A text `a` with many partners is copied once for every `PARTNERS` of them, so that its pairs go to several tasks.
    """
    often = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS).select(F.col("a").alias("hot"), F.ceil(F.col("n") / PARTNERS).cast("int").alias("salts")))
    dealt = pairs.join(often, F.col("a") == F.col("hot"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    kept = stored(docs.select("id", "text"))
    copies = kept.join(often, F.col("id") == F.col("hot"), "left").select(F.col("id").alias("a"), F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    joined = dealt.join(copies, ["a", "salt"]).join(kept.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def each(batch: pa.RecordBatch):
        n = batch.num_rows
        keep = np.zeros(n, bool)
        both = [x for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) for x in pair]
        at = 0
        for start in _even_steps(both):
            texts = both[at:start]
            doc, element, weight = multisets(texts)
            pair = doc >> 1
            order = np.lexsort((doc, element, pair))
            pair, element, weight = pair[order], element[order], weight[order]
            twin = (pair[1:] == pair[:-1]) & (element[1:] == element[:-1])
            shared = np.bincount(pair[1:][twin], np.minimum(weight[1:], weight[:-1])[twin], len(texts) // 2)
            total = np.bincount(pair, weight, len(texts) // 2)
            keep[at // 2 : start // 2] = shared >= THRESHOLD * (total - shared) - 1e-9
            at = start
        at = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["a", "b"])

    kind = joined.schema["a"].dataType.simpleString()
    return map_rows(joined, each, f"a {kind}, b {kind}")


def unary(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each multiset as a set: a shingle's n-th occurrence is an element of its own. Elements, and how many each text has."""
    doc, element, weight = multisets(texts)
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    own = np.repeat(doc, weight)
    return np.repeat(element, weight) + mix(nth.astype(np.uint64)), np.bincount(own, minlength=len(texts))


def shared_counts(a: np.ndarray, rows_a: np.ndarray, b: np.ndarray, rows_b: np.ndarray, shape: tuple[int, int], width: int = 4096) -> np.ndarray:
    """How many elements each row of one tile shares with each of another: products of 0/1 matrices, some columns at a time."""
    names = np.intersect1d(a, b)
    out = np.zeros(shape, np.float32)
    sides = []
    for elements, rows in ((a, rows_a), (b, rows_b)):
        at = np.minimum(np.searchsorted(names, elements), max(0, len(names) - 1))
        there = names[at] == elements if len(names) else np.zeros(len(elements), bool)
        order = np.argsort(at[there], kind="stable")
        sides.append((at[there][order], rows[there][order]))
    for low in range(0, len(names), width):
        parts = []
        for (at, rows), n in zip(sides, shape, strict=True):
            i, j = np.searchsorted(at, [low, low + width])
            m = np.zeros((n, min(width, len(names) - low)), np.float32)
            m[rows[i:j], at[i:j] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _links_within(groups: DataFrame, sizes: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links in each group of (node, component), all pairs of it being compared.

    A group is dealt into tiles of a bounded number of shingles and rows; each pair of tiles is one row of work.
    """
    member = groups.join(sizes, groups.node == sizes.id).select("id", F.col("component").alias("group"), "n")
    tiles = member.groupBy("group").agg(F.greatest(F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_ROWS)).cast("int").alias("tiles"))
    dealt = cut_lineage(member.join(tiles, "group").select("id", "group", "tiles", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile")))
    rows = docs.join(dealt, "id").dropDuplicates(["id"]).select("id", "group", "tile", "text")

    def pack(pdf):
        import pandas as pd

        elements, counts = [], []
        for _, texts in in_steps(pdf.text.tolist()):
            own, n = unary(texts)
            elements.append(own)
            counts.append(n)
        return pd.DataFrame([{"group": pdf["group"].iloc[0], "tile": pdf.tile.iloc[0], "ids": pdf.id.tolist(), "counts": np.concatenate(counts).tolist(), "elements": np.concatenate(elements).tobytes()}])

    kind = docs.schema["id"].dataType.simpleString()
    packed = cut_lineage(rows.groupBy("group", "tile").applyInPandas(pack, f"group {kind}, tile int, ids array<{kind}>, counts array<long>, elements binary"))
    a, b = (packed.select("group", F.col("tile").alias(f"tile_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("ids", "counts", "elements"))) for k in "ab")
    pairs = dealt.select("group", "tiles").distinct().select("group", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile_a"), "tiles").select("group", "tile_a", F.explode(F.sequence("tile_a", F.col("tiles") - 1)).alias("tile_b"))
    joined = pairs.join(a, ["group", "tile_a"]).join(b, ["group", "tile_b"]).select((F.col("tile_a") == F.col("tile_b")).alias("same"), *(f"{c}_{k}" for k in "ab" for c in ("ids", "counts", "elements")))

    def each(batch: pa.RecordBatch):
        for r in range(batch.num_rows):
            ids, counts, elements, owner = [], [], [], []
            for k in (1, 4):
                ids.append(batch.column(k)[r].as_py())
                counts.append(np.asarray(batch.column(k + 1)[r].as_py()))
                elements.append(np.frombuffer(batch.column(k + 2)[r].as_py(), np.uint64))
                owner.append(np.repeat(np.arange(len(counts[-1])), counts[-1]))
            both = shared_counts(elements[0], owner[0], elements[1], owner[1], (len(ids[0]), len(ids[1])))
            total = counts[0][:, None] + counts[1][None, :]
            i, j = np.nonzero(both >= THRESHOLD * (total - both) - 1e-6)
            if not batch.column(0)[r].as_py():
                j = j + len(ids[0])
                names = ids[0] + ids[1]
            else:
                names = ids[0]
            root = forest(i, j, len(names))
            at = np.flatnonzero(root != np.arange(len(names)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([names[root[x]] for x in at]), pa.array([names[x] for x in at])], ["a", "b"])

    return map_rows(joined, each, f"a {kind}, b {kind}")


def _even_steps(texts: list[str], limit: int = 600_000):
    """Ends of runs of whole pairs of texts, each of about `limit` code points at most."""
    size = 0
    for i in range(0, len(texts), 2):
        own = len(texts[i]) + len(texts[i + 1])
        if size and size + own > limit:
            yield i
            size = 0
        size += own
    yield len(texts)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's class: documents linked, directly or through others, by a weighted Jaccard similarity of 0.8 or more.

    Shingles are five consecutive words (all words of a shorter text). A null text, or one without words, is alone in its
    class. Rows with the same id are one document to the classes but each stay a row; a null id is alone. Columns: id,
    class_id (the smallest id of the class), kept (whether it is that document), n_shingles.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = cut_lineage(_signed(source))
    some = signed.where("n > 0 and id is not null")
    # aggregates are cut before they are joined back, so that the join has exchanges of its own, which Spark can split
    firsts = cut_lineage(some.groupBy("k1", "k2").agg(F.min("id").alias("rep")))
    member = some.select("id", "k1", "k2").join(firsts, ["k1", "k2"]).select("id", "rep")
    reps = some.join(firsts.select("rep"), F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id"])
    banded = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    centers = cut_lineage(banded.groupBy("band", "bucket").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n"))
    shared = cut_lineage(banded.join(centers, ["band", "bucket"]).select("id", "band", "bucket", "center"))
    involved = shared.select("id").distinct()
    texts = source.join(involved, "id", "left_semi")
    first = shared.where("id != center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    links = cut_lineage(_similar(first, texts))
    classes = cut_lineage(connected_components(links))
    # what the centers left apart: buckets that hold several classes, compared whole, tile by tile
    placed = shared.join(classes, shared.id == classes.node, "left").select("id", "band", "bucket", F.coalesce("component", "id").alias("class"))
    torn = placed.groupBy("band", "bucket").agg((F.min("class") != F.max("class")).alias("torn"), F.min("id").alias("center")).where("torn").drop("torn")
    star = placed.join(torn, ["band", "bucket"]).select(F.col("center").alias("a"), F.col("id").alias("b"))
    more = cut_lineage(_links_within(connected_components(star), reps.select("id", "n"), source))
    classes = connected_components(classes.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    found = member.join(classes, member.rep == classes.node, "left").select("id", F.coalesce("component", "rep").alias("class_id")).distinct()
    out = signed.select("id", "n").join(found, "id", "left")
    own = F.coalesce("class_id", "id")
    return out.select(F.col("id").alias(id_col), own.alias("class_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"), F.col("n").alias("n_shingles"))
