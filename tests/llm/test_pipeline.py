"""The pipeline on a small folder of tables, against what its stages must keep."""

import random

import pytest
from pyspark.sql import functions as F
from helpers import DOCS

import corpus_pipeline


@pytest.fixture
def folder(spark, words, tmp_path):
    rng = random.Random(2)
    clean = [(i, "\n".join(words(25, 900 + 10 * i + k) for k in range(6)), "aa") for i in range(40)]
    near = clean[0][1].split("\n")
    near = [" ".join([*line.split()[:-1], f"z{k}"]) if k == 2 else line for k, line in enumerate(near)]
    item = words(30, 77)
    rows = clean + [(100, "\n".join(" ".join([*line.split(), f"w{k}"]) for k, line in enumerate(clean[1][1].split("\n"))), "aa"), (101, clean[2][1], "aa"), (102, words(40, 5) + " " + item + " " + words(30, 6), "aa"), (103, "12 34", "aa"), (104, None, "aa"), (None, words(60, 8), None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(r[0], r[1], r[2], "s", len(r[1] or ""), 1, "a", "b", 2, 3, 4, 5) for r in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_stages(spark, folder):
    at, docs = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "encode"]
    now, left = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, at)
        if name != "encode":
            assert out.columns == docs.columns
        out.write.parquet(f"{at}/{name}")
        now = spark.read.parquet(f"{at}/{name}")
        left.append({r.doc_id for r in now.select("doc_id").collect()})
    everything = {r.doc_id for r in docs.collect()}
    assert everything - left[0] == {103, 104}
    assert left[0] - left[1] == {101}
    assert left[1] - left[2] <= {100} and left[2] - left[3] == {102} and left[3] == left[4]
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, at).collect()) == sorted(r.ids_sha256 for r in now.collect())


@pytest.mark.parametrize("copies", [0, 2])
def test_stages_on_odd_tables(spark, words, tmp_path, copies):
    """No n_chars, columns of the operators' own names, repeated rows, a long text; and no rows at all."""
    rows = [(i, words(40 if i else 4000, i), 7, True, 5) for i in range(12) for _ in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, __keep boolean, __id int")
    spark.createDataFrame([(1, words(30, 3))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs.withColumn("lang", F.lit("aa"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encode":
            assert now.columns == [*docs.columns, "lang"] and {tuple(r)[2:] for r in now.collect()} <= {(7, True, 5, "aa")}
    assert sorted(r.doc_id for r in now.collect()) == sorted(i for i in range(12) if i != 3 for _ in range(copies))
