"""A training-data pipeline: each stage is one operator of quillmill.llm over all that the stage before it kept.

`run` applies the stages in order; each result is written as Parquet in the shared folder that the cluster names for
checkpoints, and read again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bagminhash, bpe, decontam, langid, line_dedup
from quillmill.llm.common import fresh, read, shared_folder, spread
from quillmill.llm.queries import tokenizer_path

#: A document goes if its language has a smaller share of its words than this, or none can be told.
LEAST_SHARE = 0.4


def _keyed(docs: DataFrame, verdict: DataFrame, keep) -> DataFrame:
    """The documents whose verdict (by doc_id) is to be kept; those without id or verdict stay."""
    own, kept = fresh(docs, "id", "keep")
    marked = verdict.select(F.col("doc_id").alias(own), keep.alias(kept)).groupBy(own).agg(F.max(kept).alias(kept))
    return docs.join(marked, docs.doc_id == F.col(own), "left").where(F.coalesce(F.col(kept), F.lit(True))).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    found = langid.identify(docs, langid.train(docs))
    return _keyed(docs, found, (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a document of which nothing is left goes, one that was empty stays."""
    names = fresh(docs, "n_lines", "n_removed", "removed")
    out = line_dedup.dedup_lines(docs, outputs=tuple(names))
    cut = F.col(names[1]) > 0
    emptied = cut & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    kept = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return _keyed(docs, bagminhash.near_duplicates(docs), F.col("kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    (own,) = fresh(docs, "id")
    found = decontam.contaminated(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, docs.doc_id == F.col(own), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and digests of them and of the text decoded from them."""
    return bpe.encode_documents(docs, tokenizer_path(), ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: No stage but the last could be said in SQL: a trained model, hashed word windows and classes of linked texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spread(read(spark, sf_dir, "documents"))
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
