"""Every registered query against its SQL, and the cases that fix the operators' meaning."""

import functools
import hashlib
import math
import os
import tracemalloc
from unittest import mock

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quillmill.functions import chunking
from quillmill.functions import text as X
from quillmill.operators import lexical, records, relational, vector
from quillmill.plans import registry
from quillmill.streaming import capture

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, x)) + "]"
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (float, np.floating)):
        return f"{x + 0.0:.6f}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name not in registry.oracle_sql():
        assert len(got)
        return
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted("|".join(map(shown, r)) for r in f[columns].itertuples(index=False)) for f in (got, want)]
    assert rows[0] == rows[1]


def test_query_plan():
    assert X.query_plan('What is the "cost of living" in Paris') == (["cost", "living", "paris"], [["cost", "of", "living"], ["cost", "living", "paris"]])
    assert X.query_plan("*** the of") == ([], []) and X.query_plan("Café_x café") == (["cafe", "x"], [["cafe", "x"]])
    assert len(X.query_plan(" ".join(f"w{i}" for i in range(50)))[0]) == 32


def test_search_cases(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick quick fox"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in lexical.bm25(docs, "quick brown").orderBy("score").collect()] == [2, 1]
    assert [r.doc_id for r in lexical.bm25(docs, "quick brown", every=True).collect()] == [1]
    assert lexical.bm25(docs, "***").count() == lexical.bm25(docs, "").count() == lexical.bm25(docs.where("false"), "fox").count() == 0
    assert {r.doc_id: r.n for r in lexical.phrase(docs, ["quick"]).collect()} == {1: 1, 2: 2}
    assert [(r.doc_id, r.tier) for r in lexical.tiered(docs, "quick brown fox", 10).collect()] == [(1, 1), (2, 3)]


def test_postings_give_the_same_scores(spark, tmp_path):
    rows = [(1, "the quick brown fox"), (2, "quick quick fox"), (2, "quick quick fox"), (3, None), (4, ""), (5, "Füchse QUICK, über-brown"), (6, "slow")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = lexical.Postings.build(docs, f"{tmp_path}/p")
    for query in ("quick brown", "fuchse slow", "the of", "nowhere"):
        assert sorted(map(tuple, p.scored(query).collect())) == sorted(map(tuple, lexical.scored(docs, query).collect()))
    assert len(p.scored("quick").collect()) == 4


def test_postings_are_lists_of_a_run_of_texts(spark, tmp_path, monkeypatch):
    """A row for each word of a run of texts: what is shuffled has no row for each word of each text."""
    texts = [f"mill wheel {'mill ' * (i % 3)} w{i % 7}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    p = lexical.Postings.build(docs, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p/terms").count() <= 9 * spark.sparkContext.defaultParallelism
    for query in ("mill w3", "wheel w5 nowhere"):
        assert sorted(map(tuple, p.scored(query).collect())) == sorted(map(tuple, lexical.scored(docs, query).collect()))
    monkeypatch.setattr(lexical.counts, "SLICE_WORDS", 6)
    lists = [["b", "a", "b"], [], ["a"] * 9, ["c"], ["a", "c"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(70, 76)), pa.array(list("uvwxyz")), pa.array([len(x) for x in lists]), pa.array(lists, pa.list_(pa.string()))], ["row", "id", "dl", "t"])
    found = [r for out in lexical._inverted([batch, batch.slice(0, 0)]) for r in out.to_pylist()]
    flat = sorted((r["base"] + at, i, r["term"], tf, dl) for r in found for at, i, tf, dl in zip(r["at"], r["id"], r["tf"], r["dl"], strict=True))
    assert flat == sorted((70 + k, "uvwxyz"[k], w, x.count(w), len(x)) for k, x in enumerate(lists) for w in set(x)) and len({r["base"] for r in found}) > 1


def test_search_of_titles_and_ids(spark):
    docs = spark.createDataFrame([("a", "mill wheel of the river", "x"), ("b", "the mill", "Mill"), ("mill", "nothing", "y"), ("c", "mill mill mill", "z")], "id string, text string, title string")
    assert [r.id for r in lexical.tiered(docs, "mill", 9, "id", "text", "title").collect()][:2] == ["mill", "b"]


def test_cosine_cases(spark):
    rows = spark.createDataFrame([("opposite", [-1.0, 0.0]), ("side", [0.0, 2.0]), ("first", [10.0, 0.0]), ("second", [1.0, 0.0]), ("zero", [0.0, 0.0])], "vec_id string, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vector.top_k(rows, [2.0, 0.0], 3).collect()] == [("first", 1.0), ("second", 1.0), ("side", 0.0)]
    for bad in ([0.0, 0.0], [math.nan, 1.0]):
        with pytest.raises(ValueError):
            vector.top_k(rows, bad, 3)


def test_search_of_many_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)).round(1)
    rows = [(i, i // 3, x.tolist()) for i, x in enumerate(v)] + [(900, 900, None), (901, 901, [0.0] * 6), (902, 902, [float("nan")] + [1.0] * 5), (903, 903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, None, [1.0] * 6), (905, 905, [1.0] * 4), (906, 7, v[0].tolist())]
    q = rng.normal(size=(23, 6))
    asked = [(i, x.tolist()) for i, x in enumerate(q)] + [(50, None), (51, [0.0] * 6), (52, [2.0] * 4), (53, [1.0] * 9)]
    frames = spark.createDataFrame(rows, "vec_id long, record long, embedding array<double>"), spark.createDataFrame(asked, "query long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(np.vstack([v, v[:1]])).T, 6)
    want = []
    for i in range(len(q)):
        best = {}
        for j, (vec, record, _) in enumerate([*rows[:300], rows[-1]]):
            if scores[i, j] >= 0.35:
                best[record] = min(best.get(record, (9, 0)), (-scores[i, j], vec))
        want += [(i, r, vec, -s, n + 1) for n, (s, r, vec) in enumerate(sorted((s, r, vec) for r, (s, vec) in best.items())[:4])]
    want.append((52, 905, 905, 1.0, 1))
    for size in (1 << 20, 200):
        got = sorted(map(tuple, vector.search_many(*frames, 4, "record", wave_bytes=size).collect()))
        assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])
    assert vector.search_many(frames[0], frames[1].where("query = 50"), 4).count() == 0


def test_listing_is_complete(spark):
    ids = spark.createDataFrame([(i,) for i in range(257, 0, -1)], "id long")
    after, seen = None, []
    while page := [r.id for r in relational.keyset_page(ids, "id", after, 50).collect()]:
        seen += page
        after = page[-1]
    assert seen == list(range(1, 258))


def test_fingerprint_of_many_ids(spark):
    got = relational.membership_fingerprint(spark.range(200_000), "id").first()
    want = [int(hashlib.sha256(str(i).encode()).hexdigest()[:12], 16) for i in range(200_000)]
    assert (got.n, got.digest, got.total) == (200_000, functools.reduce(int.__xor__, want), str(sum(want))) and sum(want) > 1 << 63


@pytest.mark.parametrize("text", ["", "a\n" * 2000, "α" * 4000, "# H\r\ntext\r\n```py\n# no heading\n```\nend", "~~~\n" + "x\n" * 900 + "~~~~\nafter", "é🌊" * 1500 + "\n" + "y" * 30])
def test_chunks_and_blocks(text):
    blocks = chunking.split_blocks(text)
    assert "".join(text[a:b] for a, b, *_ in blocks) == text
    assert all(b - a <= chunking.BLOCK_CHARS or kind == "fenced_code" for a, b, kind, *_ in blocks)
    assert all(first == 1 + len(chunking._NEWLINE.findall(text[:a])) for a, _, _, _, first, _ in blocks)
    reach = 0
    for _, a, b in chunking.split_text(text):
        assert a <= reach and len(text[a:b].encode()) <= chunking.MAX_BYTES
        reach = b
    assert reach == len(text) or not text[reach:].strip()


@pytest.mark.parametrize("split", [chunking.chunks, chunking.blocks])
def test_parts_are_given_away_by_size(split):
    """Of a batch of 40 MB no more than a few MB are held in Python at once; a text of many parts is given away in pieces."""
    frame = mock.MagicMock()
    split(frame, "id")
    run = frame.select.return_value.mapInArrow.call_args[0][0]
    texts = [("line of words\n" * 100 + str(i)) * 3 for i in range(8000)] + [None, "", "x y " * 1_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    bodies, largest, before = 0, 0, tracemalloc.get_traced_memory()[0]
    for out in run([batch]):
        size = out.column(out.schema.get_field_index("body")).nbytes
        bodies, largest = bodies + size, max(largest, size)
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert bodies > 30 << 20 and largest < 2 << 20 and most < 16 << 20


def test_blocks_of_one_text_are_not_gathered():
    """A text of 50,000 sections takes a few times its own size, not hundreds of bytes for each section."""
    frame = mock.MagicMock()
    chunking.blocks(frame, "id")
    run = frame.select.return_value.mapInArrow.call_args[0][0]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["# a\n" * 50_000])], ["id", "text"])
    tracemalloc.start()
    rows, before = 0, tracemalloc.get_traced_memory()[0]
    for out in run([batch]):
        assert out.column(6)[-1].as_py() == "a" and out.column(3)[0].as_py() == rows + 1 and out.column(8)[-1].as_py() == "# a\n"
        rows += out.num_rows
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert rows == 50_000 and most < 6 << 20


def test_blocks_have_labels_and_lines():
    text = "intro\n# One\nline\n```py\n# no heading\n~~~\n``` x\n````  \nafter\n ## Two ##\n" + "y" * 30
    assert [(text[a:b].split("\n")[0], kind, label, first, last) for a, b, kind, label, first, last in chunking.split_blocks(text)] == [
        ("intro", "section", "Text", 1, 1),
        ("# One", "section", "One", 2, 3),
        ("```py", "fenced_code", "Code py", 4, 8),
        ("after", "section", "Text", 9, 9),
        (" ## Two ##", "section", "Two ##", 10, 11),
    ]
    long = "a" * 1198 + "\r\n" + "b" * 10 + "\u2028" + "c" * 1300
    assert [(b - a, kind, first, last) for a, b, kind, _, first, last in chunking.split_blocks(long)] == [(1200, "section_window", 1, 1), (11, "section_window", 2, 2), (1200, "section_window", 3, 3), (100, "section_window", 3, 3)]
    assert [b - a for a, b, *_ in chunking.split_blocks("a" * 1199 + "\r\n" + "b" * 5)] == [1199, 7]
    assert [(kind, label) for _, _, kind, label, *_ in chunking.split_blocks("~~~~\ncode\n~~~\n")] == [("fenced_code", "Code ")]


def test_alignment(spark):
    lists = "c string, p int, k string"
    long = spark.createDataFrame([("u", i, t) for i, t in enumerate("abcd")] + [("v", i, t) for i, t in enumerate("abab")], lists)
    short = spark.createDataFrame([("u", 0, "b"), ("u", 1, "c"), ("v", 0, "a"), ("v", 1, "b")], lists)
    assert [(r.c, r.offset) for r in records.align(short, long, "c", "k", "p").collect()] == [("u", 1)]


def test_pairs_of_one_key_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "TASK_PAIRS", 1000, raising=False)
    monkeypatch.setattr(records, "TILE_ROWS", 30, raising=False)
    rng = np.random.default_rng(5)
    odd = [None, -0.0, 0.0, -1.0, 10.0, math.inf, math.nan, 1e300, 15.999, 16.0, 5.999]
    c = [(i, None if i == 20 else 7, v) for i, v in enumerate([*odd, *(float(x) for x in rng.uniform(-40, 300, 300).round(2))])] + [(900, 8, 5.0)]
    s = [(i, None if i == 20 else 7, v) for i, v in enumerate([*odd, *(float(x) for x in rng.uniform(-40, 300, 200).round(2))])] + [(900, 9, 5.0)]
    for name, rows, p in (("customer", c, "c_custkey long, c_nationkey int, c_acctbal double"), ("supplier", s, "s_suppkey long, s_nationkey int, s_acctbal double")):
        spark.createDataFrame(rows, p).write.parquet(f"{tmp_path}/{name}.parquet")
    found = registry.queries()["compatible_pairs"](spark, str(tmp_path))
    near = lambda a, b: a is not None and a < 0 or b is not None and b < 0 or a is not None and b is not None and abs(a - b) < 10
    want = sorted((i, k, j) for i, k, a in c for j, n, b in s if k is not None and k == n and near(a, b))
    assert sorted(map(tuple, found.collect())) == want
    most = found.groupBy(X.F.spark_partition_id()).count().agg(X.F.max("count")).first()[0]
    assert most < len(want) / 4


def test_pause_lasts_over_batches(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "click"), (2, "2024-01-01 00:01:00", 7, "purchase"), (3, "2024-01-01 00:02:00", 7, "click"), (4, "2024-01-01 00:03:00", 7, "view"), (5, "2024-01-01 00:04:00", 7, "click")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", X.F.col("ts").cast("timestamp_ntz"))
    events.where("event_id < 3").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    toggle = X.F.when(X.F.col("event_type") == "purchase", True).when(X.F.col("event_type") == "view", False)
    sink = capture.privacy_sink(f"{tmp_path}/kept", events.schema, "user_id", ["ts", "event_id"], toggle)
    flow = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/*").writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(sink).start()
    flow.processAllAvailable()
    events.where("event_id >= 3").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    flow.processAllAvailable()
    events.where("event_id = 3").withColumn("event_id", X.F.lit(6).cast("long")).coalesce(1).write.parquet(f"{tmp_path}/in/c")
    flow.processAllAvailable()
    flow.stop()
    out = spark.read.parquet(f"{tmp_path}/kept/out").collect()
    assert sorted((r.event_id, r.paused, r.late) for r in out) == [(1, False, False), (2, False, False), (3, True, False), (4, True, False), (5, False, False), (6, False, True)]
    texts = spark.createDataFrame([("off the record, please",), ("/memory on",), ("we went off the record then",), (None,)], "t string")
    assert [r[0] for r in texts.select(capture.privacy_toggle(X.F.col("t"))).collect()] == [True, False, None, None]


def test_works_without_the_optional_part():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(registry.queries())
