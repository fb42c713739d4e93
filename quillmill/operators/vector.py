"""Exact cosine retrieval over array columns: for one query in expressions that stay in the JVM, for many in blocks."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Least cosine of a hit; bytes of query vectors that one scan of the rows takes along; scores that a task holds at once.
FLOOR, WAVE_BYTES, STEP_SCORES = 0.35, 64 << 20, 1 << 21


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length 1; null if it is zero or holds something that is not finite."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(v) > 0)
    return F.when(sound, F.transform(v, lambda x: x.cast("double") / norm(v)))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine with a given vector, held to [-1, 1]; null for a zero vector."""
    size = math.sqrt(sum(x * x for x in query))
    if not size or not all(map(math.isfinite, query)):
        raise ValueError("the query vector must be finite and not zero")
    dot = F.aggregate(F.zip_with(v, F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    raw = F.try_divide(dot, norm(v) * size)
    return F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))  # greatest and least pass over nulls


def top_k(df: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    scored = df.select(F.col(id_col), F.round(cosine(F.col(vector_col), query), 6).alias("score"))
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc("score"), id_col).limit(k)


def best_per_group(df: DataFrame, query: list[float], group_col: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The best row of each group, ties to the smaller id; partial aggregation, no window."""
    scored = df.select(F.col(group_col), F.col(id_col), F.round(cosine(F.col(vector_col), query), 6).alias("score"))
    best = scored.groupBy(group_col).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"))).alias("b"))
    return best.select(group_col, F.col("b.i").alias(id_col), (-F.col("b.s")).alias("score"))


def fuse(channels: list[tuple[DataFrame, float]], id_col: str, rank_base: int = 40) -> DataFrame:
    """Rank fusion of (id, score) lists: weight / (rank_base + rank from 0), the best of an id in a channel, summed."""
    parts = []
    for hits, weight in channels:
        rank = F.row_number().over(Window.orderBy(F.desc("score"), id_col)) - 1  # over the few rows of a candidate list
        parts.append(hits.select(id_col, (F.lit(weight) / (rank_base + rank)).alias("part")).groupBy(id_col).agg(F.max("part").alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_col).agg(F.round(F.sum("part"), 9).alias("score"))


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of length d that are finite and not zero, and these vectors at length 1."""
    at = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d)
    taken = column.take(pa.array(at)).flatten()
    m = np.asarray(taken.to_numpy(zero_copy_only=False), float).reshape(len(at), d)  # a null becomes nan
    size = np.sqrt(np.einsum("ij,ij->i", m, m))
    sound = np.isfinite(m).all(axis=1) & (size > 0) & np.isfinite(size)
    return at[sound], m[sound] / size[sound, None]


def _wave(rows: DataFrame, numbers: list, queries: np.ndarray, k: int, floor: float, query_type: str) -> DataFrame:
    """(query, record, vec, score): each task's best `k` records of each query, held as one bounded table."""
    shared = rows.sparkSession.sparkContext.broadcast((numbers, queries))  # WAVE_BYTES at most
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        own, q = shared.value
        held = pd.DataFrame({"q": np.zeros(0, np.int64), "score": np.zeros(0), "record": [], "vec": []})
        types = None
        step = max(1, STEP_SCORES // max(1, len(q)))
        for batch in batches:
            types = batch.schema
            at, m = _matrix(batch.column(2), q.shape[1])
            for begin in range(0, len(at), step):
                scores = np.round(np.clip(m[begin : begin + step] @ q.T, -1, 1), 6)
                i, j = np.nonzero(scores >= floor)
                places = pa.array(at[begin + i])
                new = pd.DataFrame({"q": j, "score": scores[i, j], "record": batch.column(0).take(places).to_pandas(), "vec": batch.column(1).take(places).to_pandas()})
                held = pd.concat([held, new]) if len(held) else new
                held = held.sort_values(["q", "score", "record", "vec"], ascending=[True, False, True, True]).drop_duplicates(["q", "record"]).groupby("q").head(k)
        if types is not None and len(held):
            columns = [pa.array([own[x] for x in held.q]), pa.array(held.record, types.field(0).type), pa.array(held.vec, types.field(1).type), pa.array(held.score)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "record", "vec", "score"])

    return rows.mapInArrow(run, f"query {query_type}, record {kinds['record']}, vec {kinds['vec']}, score double")


def search_many(df: DataFrame, queries: DataFrame, k: int, record_col: str = "vec_id", id_col: str = "vec_id", vector_col: str = "embedding", query_col: str = "query", query_vector: str = "vector", floor: float = FLOOR, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(query, record, vec, score, rank): for each query the `k` records whose best vector has the largest cosine, from `floor` on.

    Queries go along in waves of bounded size; a wave is one scan of the rows in which blocks of vectors are multiplied with all
    its queries, and each task keeps `k` records a query. What is shuffled is `k` rows a query and task, never
    rows times queries. Ties go to the smaller record, then vector. Vectors that are null, zero or not finite, and those of
    another length than the query's, have no score; scores are rounded to six places.
    """
    rows = df.where(F.col(record_col).isNotNull()).select(F.col(record_col).alias("record"), F.col(id_col).alias("vec"), F.col(vector_col).alias("v"))
    given = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("q"), F.col(query_vector).alias("v")).where("size(v) > 0")
    kind = given.schema["q"].dataType.simpleString()
    parts: list[DataFrame] = []
    for r in given.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        waves = max(1, -(-r["count"] * r.d * 8 // wave_bytes))
        for w in range(waves):
            table = given.where((F.size("v") == r.d) & (F.pmod(F.xxhash64("q"), F.lit(waves)) == w)).toArrow()
            at, m = _matrix(table.column(1).combine_chunks(), r.d) if table.num_rows else ([], np.zeros((0, r.d)))
            if len(at):
                parts.append(_wave(rows, table.column(0).take(pa.array(at)).to_pylist(), m, k, floor, kind))
    if not parts:
        return rows.select(F.lit(None).cast(kind).alias("query"), "record", "vec", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    found = functools.reduce(DataFrame.union, parts)
    best = found.groupBy("query", "record").agg(F.min(F.struct((-F.col("score")).alias("s"), "vec")).alias("b")).select("query", "record", F.col("b.vec").alias("vec"), (-F.col("b.s")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "record"))
    return best.withColumn("rank", place).where(F.col("rank") <= k)
