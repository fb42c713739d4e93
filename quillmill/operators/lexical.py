"""Lexical retrieval: BM25, phrases and tiers over the texts as they stand, or over a postings table.

A query has few terms. One pass over the texts folds and matches each once, counts rows and words on the way, and writes the
rows that hold any term with their counts; scores, tiers and phrases are worked out from that small table. Texts that are
searched often get a postings table, of which a query reads the buckets of its terms only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import counts
from ..functions.text import fold, query_plan, tokens
from ..sources.tables import spread, stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Buckets of a postings table.
BUCKETS = 256
_CHARACTER = r"[\p{L}\p{N}]"
_BEGIN, _END, _GAP = rf"(?<!{_CHARACTER})", rf"(?!{_CHARACTER})", r"[^\p{L}\p{N}]+"


@dataclass
class Matches:
    """Rows (id, dl, tf, of_phrases, exact) that hold a term or phrase, or are named by the query itself; number of all rows and of their words."""

    rows: DataFrame
    terms: list[str]
    phrases: list[list[str]]
    n: int
    words: int

    def idf(self) -> list[float]:
        counts = self.rows.agg(F.count("*").alias("any"), *(F.count(F.when(F.col("tf")[i] > 0, 1)).alias(f"n{i}") for i in range(len(self.terms)))).first()
        return [max(math.log((self.n - counts[f"n{i}"] + 0.5) / (counts[f"n{i}"] + 0.5)), LEAST_IDF) for i in range(len(self.terms))]

    def scored(self) -> DataFrame:
        """(id, score, whole, of_phrases, exact): BM25, larger is better; `whole` if the row holds all terms."""
        average = self.words / self.n if self.n else 0.0
        if not self.terms or not average:
            return self.rows.select("id", F.lit(0.0).alias("score"), F.lit(False).alias("whole"), "of_phrases", "exact")
        parts = (_score(F.col("tf")[i], F.col("dl"), idf, average) for i, idf in enumerate(self.idf()))
        return self.rows.select("id", F.round(reduce(lambda a, b: a + b, parts), 6).alias("score"), F.forall("tf", lambda x: x > 0).alias("whole"), "of_phrases", "exact")


def _score(tf: Column, dl: Column, idf: float, average: float) -> Column:
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


def matches(df: DataFrame, terms: list[str], phrases: list[list[str]], id_col: str = "doc_id", text_col: str = "text", exact: str | None = None) -> Matches:
    """One pass over the texts: each is folded once; its words, the terms in it and the phrases are counted in that form."""
    folded = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", F.coalesce(fold(F.col("text")), F.lit("")).alias("k"))
    found = F.regexp_extract_all("k", F.lit(f"{_BEGIN}({'|'.join(terms)}){_END}"), F.lit(1)) if terms else F.array().cast("array<string>")
    of_phrases = F.array(*(F.regexp_count("k", F.lit(_BEGIN + _GAP.join(p) + _END)).cast("long") for p in phrases)).cast("array<bigint>")
    named = F.col("id").cast("string") == exact if exact is not None else F.lit(False)
    hits = folded.select("id", F.regexp_count("k", F.lit(f"{_CHARACTER}+")).cast("long").alias("dl"), found.alias("h"), of_phrases.alias("of_phrases"), F.coalesce(named, F.lit(False)).alias("exact"))
    seen = Observation()
    counted = hits.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
    tf = F.array(*(F.size(F.filter("h", _is(w))).cast("long") for w in terms)).cast("array<bigint>")
    kept = counted.where("exact OR size(h) > 0 OR exists(of_phrases, x -> x > 0)")
    rows = stored(kept.select("id", "dl", tf.alias("tf"), "of_phrases", "exact"))
    return Matches(rows, terms, phrases, int(seen.get["n"]), int(seen.get["words"]))


def _is(word: str):
    return lambda x: x == word


def scored(df: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, whole) of the rows that hold any term of the query; `whole` if they hold all. Larger scores are better."""
    terms, _ = query_plan(query)
    nothing = df.select(F.col(id_col), F.lit(0.0).alias("score"), F.lit(False).alias("whole")).where(F.lit(False))
    if not terms:
        return nothing
    return matches(df, terms, [], id_col, text_col).scored().select(F.col("id").alias(id_col), "score", "whole")


def bm25(df: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """(id, score) of the rows that hold any term of the query, or with `every` all of them."""
    rows = scored(df, query, id_col, text_col)
    return (rows.where("whole") if every else rows).drop("whole")


def phrase(df: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n): rows where the words stand next to each other, and how often, occurrences not sharing a word."""
    folded = spread(df.select(id_col, text_col)).select(id_col, fold(F.col(text_col)).alias("k"))
    return folded.select(id_col, F.regexp_count("k", F.lit(_BEGIN + _GAP.join(words) + _END)).cast("long").alias("n")).where("n > 0")


def tiered(df: DataFrame, query: str, limit: int, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(id, tier, score): exact id, phrases, all terms, any term; a row keeps its first tier; `limit` is the top-k.

    With `title_col`, rows whose title is the query itself, letter case apart, come first within their tier.
    """
    terms, phrases = query_plan(query)
    found = matches(df, terms, phrases, id_col, text_col, exact=query)
    rows = found.scored()
    tier, score = F.when(F.col("exact"), 0), F.when(F.col("exact"), 0.0)
    for k in range(len(phrases)):
        tier, score = tier.when(F.col("of_phrases")[k] > 0, k + 1), score.when(F.col("of_phrases")[k] > 0, F.col("of_phrases")[k].cast("double"))
    tier = tier.when(F.col("whole"), len(phrases) + 1).otherwise(len(phrases) + 2)
    placed = rows.select(F.col("id").alias(id_col), tier.cast("long").alias("tier"), score.otherwise(F.col("score")).alias("score"))
    order = ["tier", F.desc("score"), F.col(id_col)]
    if title_col is not None:
        titled = df.where(F.lower(title_col) == query.strip().lower()).select(F.col(id_col).alias("titled"))
        placed = placed.join(titled.distinct(), F.col(id_col) == F.col("titled"), "left").withColumn("titled", F.col("titled").isNotNull())
        order.insert(1, F.desc("titled"))
    return placed.orderBy(*order).limit(limit).select(id_col, "tier", "score")


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, base, at, id, tf, dl) of runs of rows (row, id, dl, t), whose row numbers follow each other."""
    for batch in batches:
        row, ids, dl, lists = batch.columns
        for a, b in counts.slices(lists.value_lengths().to_numpy(zero_copy_only=False)):
            owner, code, n, words = counts.counted(lists[a:b])
            if not len(owner):
                continue
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            place, base = pa.array(owner + a), row[a].as_py()
            columns = (pa.array(row.to_numpy()[owner + a] - base, pa.int32()), ids.take(place), pa.array(n[order], pa.int32()), dl.take(place).cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(code[starts])), pa.array(np.full(len(starts), base)), *(counts.grouped(starts, x) for x in columns)], ["term", "base", "at", "id", "tf", "dl"])


class Postings:
    """A table (bucket, term, base, at, id, tf, dl) under one folder, in buckets of the terms' hashes, and one of the totals.

    A row has what a run of texts says of a term: `base` + `at` number them, and `at`, `id`, `tf` and `dl` are lists of equal length.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Postings:
        """One pass over the texts, which inverts runs of them within the tasks, and one shuffle of the lists to the buckets."""
        own = cls(df.sparkSession, path)
        split = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
        seen = Observation()
        sized = split.select(F.monotonically_increasing_id().alias("row"), "id", F.size("t").cast("long").alias("dl"), "t").observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
        kind = sized.schema["id"].dataType.simpleString()
        lists = sized.mapInArrow(_inverted, f"term string, base long, at array<int>, id array<{kind}>, tf array<int>, dl array<int>")
        rows = lists.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        rows.repartition("bucket", F.pmod(F.xxhash64("base"), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{own.path}/terms")
        df.sparkSession.createDataFrame([(int(seen.get["n"]), int(seen.get["words"]))], "n long, words long").write.parquet(f"{own.path}/totals")
        return own

    def scored(self, query: str, id_col: str = "doc_id") -> DataFrame:
        """As `scored` of the texts themselves, from the buckets of the query's terms."""
        terms, _ = query_plan(query)
        totals = self.spark.read.parquet(f"{self.path}/totals").first()
        wanted = self.spark.createDataFrame([(w,) for w in terms], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")).collect()
        lists = self.spark.read.parquet(f"{self.path}/terms").where(F.col("bucket").isin(sorted({r.bucket for r in wanted})) & F.col("term").isin(terms))
        df_of = {r.term: r.n for r in lists.groupBy("term").agg(F.sum(F.size("at")).alias("n")).collect()}  # at most 32 terms
        each = lists.select("term", "base", F.explode(F.arrays_zip("at", "id", "tf", "dl")).alias("x"))
        rows = each.select("term", (F.col("base") + F.col("x.at")).alias("row"), "x.id", "x.tf", "x.dl")
        value = F.lit(0.0)
        for w in terms:
            n = df_of.get(w, 0)
            value = F.when(F.col("term") == w, _score(F.col("tf"), F.col("dl"), max(math.log((totals.n - n + 0.5) / (n + 0.5)), LEAST_IDF), totals.words / max(1, totals.n))).otherwise(value)
        by_row = rows.select("row", "id", value.alias("part")).groupBy("row", "id").agg(F.sum("part").alias("s"), F.count("*").alias("k"))
        return by_row.select(F.col("id").alias(id_col), F.round("s", 6).alias("score"), (F.col("k") == len(terms)).alias("whole"))
