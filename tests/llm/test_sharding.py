"""Minimax shards against an exact search over all groups, and the pipeline's stages."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import docs_frame
from pyspark.sql import functions as F

from quillmill.llm import sharding


@pytest.mark.parametrize("hot", [0, 300])
def test_shards(spark, words, hot):
    rng = random.Random(hot)
    rows = [(i, words(rng.randint(1, 60), i % 500)) for i in range(700)] + [(1000 + i, "the same text again") for i in range(hot)]
    rows += [(5000, None), (5001, ""), (5002, "é日"), (None, "no id"), (7, rows[7][1])]
    got = sharding.shard_documents(docs_frame(spark, rows), shards=24, cell_rows=10).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    sizes, slots, of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and 0 <= r.shard < 24
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of[raw].add(r.shard)
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = docs_frame(spark, rows).select((F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("key"))
    exact = groups.groupBy("key").agg(F.sum("size").alias("size")).orderBy("key").toPandas()
    ends = np.cumsum(exact["size"].to_numpy())
    least = sharding.smallest_capacity(ends, 24, max(-(-int(ends[-1]) // 24), int(exact["size"].max())), int(ends[-1]))
    for rows_kept in (64, 1 << 15):
        assert sharding.minimax_starts(groups, 24, rows_kept)[1] == least
    assert max(sizes.values()) <= least


def test_no_documents(spark):
    assert sharding.shard_documents(docs_frame(spark, [])).count() == 0


def test_greedy_and_search():
    ends = np.cumsum([5, 1, 9, 2, 2, 6])
    assert sharding.smallest_capacity(ends, 3, 9, 25) == 10 and sharding.greedy_cuts(ends, 9, 3) is None and sharding.greedy_cuts(ends, 10, 3) == [6, 15, 25]
