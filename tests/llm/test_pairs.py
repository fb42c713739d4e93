"""Embedding and MinHash near-duplicates, components, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import docs_frame

from quillmill.llm import bagminhash, embed_dedup
from quillmill.llm.graph import connected_components, forest


def closure(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(500, 540)] + [(7, 7)]
    want = closure({x for e in edges for x in e}, edges)
    for size in (500_000, 60):
        found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), task_edges=size).collect()}
        assert found == {k: v for k, v in want.items() if k in {x for e in edges if e[0] != e[1] for x in e}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    assert forest(np.array([0, 1, 4]), np.array([1, 2, 5]), 7).tolist() == [0, 0, 0, 3, 4, 4, 6]


EMBEDDINGS = "vec_id long, embedding array<float>, label int, id long, v string, rep long"


@pytest.mark.parametrize("d", [3072, 8])
def test_tiles_of_tied_rows(spark, d):
    """Rows without an axis, or alike on it, are dealt over tiles of the planned size all the same."""
    from pyspark.sql import functions as F

    flat = spark.range(20_000).select(F.lit(1).alias("label"), F.col("id").alias("rep"), F.lit(1).alias("copies"), F.lit(d).alias("d"), F.when(F.lit(d) > 2000, 0.0).otherwise((F.col("id") % 3).cast("double")).alias("p"), F.array(F.lit(0.0)).alias("v"))
    planned = 128 if d == 3072 else 1000
    sizes = [r["count"] for r in embed_dedup.tiled(flat, None if d == 3072 else planned).groupBy("tile").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * planned and len(sizes) >= 0.8 * 20_000 / planned


def test_long_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4, 2100))
    rows = [(i, (base[i % 4] + rng.normal(size=2100) * (0.1 if i % 5 else 0.6)).tolist(), 0, 1, "x", 2) for i in range(60)]
    got = {r.vec_id: r.n_links for r in embed_dedup.embedding_classes(spark.createDataFrame(rows, EMBEDDINGS), tile_rows=10).collect()}
    v = np.asarray([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert got == dict(enumerate(((v @ v.T >= 0.93).sum(axis=1) - 1).tolist())) and sum(got.values()) > 100


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 24))
    rows = []
    for i in range(300):
        v = base[i % 12] + rng.normal(size=24) * rng.choice([0.02, 0.25, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], None), (302, None, 0), (303, [0.0] * 24, 0), (304, [math.nan] * 24, 0), (305, [None] * 24, 0), (306, [], 0), (307, rows[0][1][:5], 0), (308, [math.inf] + [0.0] * 23, 0)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], EMBEDDINGS)
    got = {r.vec_id: r for r in embed_dedup.embedding_classes(df, tile_rows=20).collect()}
    links = [(a[0], b[0]) for k, a in enumerate(rows[:301]) for b in rows[:k] if a[2] == b[2] and np.dot(a[1], b[1]) / math.sqrt(np.dot(a[1], a[1]) * np.dot(b[1], b[1])) >= 0.93]
    degree = Counter(x for e in links for x in e)
    want = closure([r[0] for r in rows], links)
    assert len(links) > 300 and len(got) == len(rows)
    for i in want:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], want[i], want[i] == i)


def test_embeddings_just_below_the_threshold_and_of_any_size(spark):
    near = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(1, [1.0, 0.0], 0), (2, near(0.9299999995), 0), (3, near(0.9300000005), 1), (4, [1.0, 0.0], 1)]
    rows += [(5, [1e-200, 0.0], 2), (6, [1e200, 1e199], 2), (7, [5e-324, 0.0], 2), (8, [-0.0, 1.0], 3), (9, [0.0, 2.0], 3), (10, [0.0, 1.0], 3)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (2, 8), 9: (2, 8), 10: (2, 8)}


def test_tiles_of_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(9, 16))
    x, y = (base[rng.integers(0, 9, n)] + rng.normal(size=(n, 16)) * 0.15 for n in (150, 90))
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 32)
    axes = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    exact = lambda a, b: (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)) >= 0.93
    for a, b, same in ((x, y, False), (x, x, True)):
        want = {(i, j) for i, j in zip(*np.nonzero(exact(a, b)), strict=True) if not same or i < j}
        for turned in (axes, None):
            i, j = embed_dedup.tile_links(a, b, turned, 0.93, same)
            assert len(want) > 100 and set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_embeddings_empty(spark):
    assert embed_dedup.embedding_classes(spark.createDataFrame([], EMBEDDINGS)).count() == 0


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    a = Counter({i: int(rng.integers(1, 9)) for i in range(300)})
    b = Counter({i: int(rng.integers(0, 9)) if i < 120 else a[i] for i in a})
    b = +b
    doc = np.array([0] * len(a) + [1] * len(b))
    element = bagminhash.mix(np.array([*a, *b]).astype(np.uint64) + np.uint64(1))
    s = bagminhash.signatures(doc, element, np.array([*a.values(), *b.values()]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - jaccard(a, b)) < 0.03


@pytest.fixture
def near_rows(words):
    rng = random.Random(9)
    rows = [(i, words(rng.randint(3, 120), i)) for i in range(60)]
    text = words(150, 999).split()  # a chain of edits: neighbours are alike, far ones are not
    for i in range(60, 160):
        text = list(text)
        text[rng.randrange(len(text))] = f"edit{i}"
        rows.append((i, " ".join(text)))
    rows += [(200, rows[0][1]), (201, rows[0][1].upper()), (202, None), (203, ""), (204, "!!"), (205, rows[70][1]), (206, "a b a b a b a b a b a b"), (207, "a b a b a b a b a b a b a b a b a b a b")]
    return rows


def test_near_duplicates(spark, near_rows):
    bags = {i: bag(t) for i, t in near_rows}
    links = [(i, j) for i in bags for j in bags if i < j and bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8]
    want = closure(bags, links)
    got = {r.doc_id: r for r in bagminhash.near_duplicates(docs_frame(spark, near_rows)).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items()) and len(set(want.values())) < len(want) - 90


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (2, None)]
    got = sorted((r.doc_id or -1, r.class_id or -1, r.kept) for r in bagminhash.near_duplicates(docs_frame(spark, rows)).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert bagminhash.near_duplicates(docs_frame(spark, [])).count() == 0
