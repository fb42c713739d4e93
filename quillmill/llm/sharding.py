"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group; groups stand in the order of a 63-bit hash of their text. The smallest
capacity that lets `shards` contiguous runs hold all groups is found by binary search, each capacity being checked
greedily. The search runs on a summary of bounded size: sums over hash prefixes. Prefixes in which a cut may fall are
divided again, in one Spark aggregation a round, until the capacity is exact; no round brings more than `summary_rows`
rows to the driver, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, text_or_empty

KEY_BITS = 63


@dataclass
class Blocks:
    """Consecutive runs of groups: prefix of so many bits, bytes in all, and whether it is one group."""

    prefix: np.ndarray
    bits: np.ndarray
    weight: np.ndarray
    single: np.ndarray

    @property
    def low(self) -> np.ndarray:
        return self.prefix << (KEY_BITS - self.bits)

    def take(self, index) -> Blocks:
        return Blocks(self.prefix[index], self.bits[index], self.weight[index], self.single[index])

    def plus(self, other: Blocks) -> Blocks:
        both = Blocks(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("prefix", "bits", "weight", "single")))
        return both.take(np.argsort(both.low, kind="stable"))


def greedy_cuts(ends: np.ndarray, capacity: int, shards: int, divisible: np.ndarray | None = None) -> list[int] | None:
    """Byte positions where runs of at most `capacity` end if each takes all it can; None if `shards` don't hold all.

    `ends` are the prefix sums of the blocks. A block marked divisible may be cut anywhere.
    """
    total, at, cuts = int(ends[-1]), 0, []
    for _ in range(shards):
        if at + capacity >= total:
            return [*cuts, total]
        i = int(np.searchsorted(ends, at + capacity, side="right"))
        reach = at + capacity if divisible is not None and divisible[i] else int(ends[i - 1]) if i else 0
        if reach <= at:
            return None
        at = reach
        cuts.append(at)
    return None


def smallest_capacity(ends: np.ndarray, shards: int, low: int, high: int, divisible: np.ndarray | None = None) -> int:
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Block indices where the shards begin: none holds over `capacity`, each as near an equal share of the rest as may be."""
    total, n = int(ends[-1]), len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    latest = [n] * (shards + 1)  # the first block from which the remaining shards still hold the rest
    for left in range(1, shards + 1):
        floor = int(ends[latest[left - 1] - 1]) - capacity if latest[left - 1] else 0
        latest[left] = int(np.searchsorted(starts, floor, side="left")) if floor > 0 else 0
    cuts, at = [0], 0
    for k in range(shards - 1):
        left = shards - k
        begun = int(starts[at]) if at < n else total
        share = begun + (total - begun) / left
        i = int(np.searchsorted(ends, share))
        if i < n and i > at and share - int(starts[i]) < int(ends[i]) - share:
            i -= 1
        most = int(np.searchsorted(ends, begun + capacity, side="right"))
        at = min(max(i + 1, latest[left - 1], at), most, n)
        cuts.append(at)
    return cuts


def _summary(groups: DataFrame, bits: int) -> DataFrame:
    prefix = F.shiftright("key", KEY_BITS - bits)
    return groups.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("weight"), (F.min("key") == F.max("key")).alias("single"))


def _collected(df: DataFrame, bits: int) -> Blocks:
    rows = df.toPandas()
    return Blocks(rows.prefix.to_numpy(np.int64), np.full(len(rows), bits, np.int64), rows.weight.to_numpy(np.int64), rows.single.to_numpy(bool))


def minimax_starts(groups: DataFrame, shards: int, summary_rows: int = 1 << 15) -> tuple[list[int], int]:
    """The first keys of the shards, and the smallest capacity, for rows (key, size)."""
    spark = groups.sparkSession
    first_bits = summary_rows.bit_length() - 1
    blocks = _collected(_summary(groups, first_bits), first_bits)
    if not len(blocks.weight):
        return [0] + [1 << 62] * (shards - 1), 0
    blocks = blocks.take(np.argsort(blocks.low, kind="stable"))
    while True:
        ends = np.cumsum(blocks.weight)
        total = int(ends[-1])
        least = max(-(-total // shards), int(blocks.weight[blocks.single].max(initial=0)))
        low = smallest_capacity(ends, shards, least, total, ~blocks.single)
        high = smallest_capacity(ends, shards, low, total)
        if low == high:
            break
        near, far = [0], [0]
        for capacity, divisible, out in ((low, None, near), (high, ~blocks.single, far)):
            at = 0
            for _ in range(shards):
                i = int(np.searchsorted(ends, at + capacity, side="right"))
                at = total if i >= len(ends) else at + capacity if divisible is not None and divisible[i] else int(ends[i - 1]) if i else 0
                out.append(at)
        starts = ends - blocks.weight
        unsure = np.zeros(len(ends), bool)
        for a, b in zip(near, far, strict=True):
            unsure |= (starts < max(a, b)) & (ends > min(a, b)) | (starts < b) & (ends > b) | (starts <= a) & (ends > a)
        unsure &= ~blocks.single
        if not unsure.any():  # every cut is known to fall between groups
            unsure = ~blocks.single & (blocks.weight > low)
        if not unsure.any():
            unsure = ~blocks.single
        split = np.flatnonzero(unsure)
        split = split[np.argsort(-blocks.weight[split], kind="stable")][: summary_rows // 2]
        finer = max(1, (summary_rows // len(split)).bit_length() - 1)
        kept = blocks.take(np.setdiff1d(np.arange(len(ends)), split))
        for bits in np.unique(blocks.bits[split]):
            own = blocks.prefix[split][blocks.bits[split] == bits]
            deeper = min(KEY_BITS, int(bits) + finer)
            chosen = F.broadcast(spark.createDataFrame([(int(x),) for x in own], "open long"))  # at most summary_rows / 2 rows
            inside = groups.join(chosen, F.shiftright("key", KEY_BITS - int(bits)) == F.col("open"), "left_semi")
            kept = kept.plus(_collected(_summary(inside, deeper), deeper))
        blocks = kept
    cuts = even_cuts(ends, low, shards)
    lows = blocks.low
    return [int(lows[c]) if c < len(lows) else (1 << 62) + (1 << 61) + (1 << 60) for c in cuts], low


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 2000) -> DataFrame:
    """Each document's shard by the law `bytes`, and its place there.

    Size is the UTF-8 length of the text plus 8; a null text counts as empty, its checksum as that of no bytes. Equal
    texts share a shard. Rows repeated whole each get a slot of their own. An empty table gives no rows.
    Columns: id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law).
    """
    text = text_or_empty(text_col)
    thin = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("key"),
        )
    )
    n = thin.count()
    starts, _ = minimax_starts(thin.select("key", "size"), shards)
    shard = sum((F.when(F.col("key") >= F.lit(s), 1).otherwise(0) for s in starts[1:]), F.lit(0)).cast("int")
    cells = max(1, -(-n // (shards * cell_rows)))
    placed = thin.select("id", "size", "text_crc32", shard.alias("shard"), F.pmod(F.xxhash64("id", F.lit(17)), F.lit(cells)).alias("cell"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "text_crc32", "size"))
    return (
        placed.withColumn("within", within)
        .join(offsets, ["shard", "cell"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
