"""An index of the blocks of records, kept by revision: which places of each record answer a query best.

Postings are keyed by (record, revision, block) and carry the record's own statistics, so a block is scored among the blocks of
its record by one scan of the query's terms, without other tables. A row has a record's postings of one bucket as lists. A run of `update` writes a new generation of those
records alone whose revision has changed; what an older generation says of them is passed over until `compact`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import chunking, counts
from ..functions.text import query_plan, revision, tokens
from ..sources.tables import stored
from .lexical import K1, LEAST_IDF, B

BUCKETS = 64
_MAPS = "id string, revision string, generation int"
_LISTS = "id string, n_blocks long, words long, term array<string>, tf array<int>, block_id array<string>, start array<int>, end array<int>, dl array<int>, bucket int"
_POSTINGS = f"{_LISTS}, generation int"


def blocks_of(records: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, block_id, start, end, body): sections, windows of long ones and fenced code."""
    return chunking.blocks(records, id_col, text_col).select(F.col(id_col).alias("id"), "block_id", "start", "end", "body")


def _bucket_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_LISTS` for records (id, b), b being an array of (block_id, start, end, t)."""
    for batch in batches:
        ids, all_blocks = batch.columns
        n_blocks = all_blocks.value_lengths().to_numpy(zero_copy_only=False)
        first = np.cumsum(n_blocks) - n_blocks
        sizes = np.add.reduceat(np.append(all_blocks.flatten().flatten()[3].value_lengths().to_numpy(zero_copy_only=False), 0), first) if len(first) else first
        for a, b in counts.slices(sizes):
            block_id, start, end, lists = all_blocks[a:b].flatten().flatten()
            block, code, tf, words = counts.counted(lists)
            if not len(block):
                continue
            bucket = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words.to_pylist()), np.int64, len(words))[code]
            record = np.repeat(np.arange(b - a), n_blocks[a:b])[block]
            order = np.argsort(record * BUCKETS + bucket, kind="stable")
            block, code, tf, bucket, record = (x[order] for x in (block, code, tf, bucket, record))
            starts = np.flatnonzero(np.diff(record * BUCKETS + bucket, prepend=-1))
            of, place = record[starts] + a, pa.array(block)
            postings = (words.take(pa.array(code)), pa.array(tf, pa.int32()), block_id.take(place), start.take(place), end.take(place), pa.array(lists.value_lengths()).take(place))
            columns = [ids.take(pa.array(of)), pa.array(n_blocks[of], pa.int64()), pa.array(sizes[of], pa.int64()), *(counts.grouped(starts, x) for x in postings), pa.array(bucket[starts], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_blocks", "words", "term", "tf", "block_id", "start", "end", "dl", "bucket"])


class BlockIndex:
    """Tables `maps` and `postings` under one folder; postings lie in buckets of their terms."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def maps(self) -> DataFrame:
        """(id, revision, generation) of each record that is indexed, as its last generation has it."""
        last = self._read("maps", _MAPS).groupBy("id").agg(F.max_by("revision", "generation").alias("revision"), F.max("generation").alias("generation"))
        return last.where("revision is not null")

    def update(self, records: DataFrame, id_col: str = "id", text_col: str = "text", blocks=blocks_of, complete: bool = False) -> int:
        """Index the records that are new or whose text is another by now; with `complete`, forget those that are not given.

        `blocks` makes (id, block_id, start, end, body) of the changed records (id, text). Postings are written before maps: a run
        that breaks off is done again under its own number and replaces what it has written. Only the texts are shuffled, to the
        tasks of their ids; a task writes the postings of its records to all buckets. Returns the number of the generation.
        """
        seen = self._read("maps", _MAPS).agg(F.max("generation")).first()[0]
        generation = 0 if seen is None else seen + 1
        now = records.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("revision", revision(F.col("text")))
        old = self.maps().select(F.col("id").alias("of"), F.col("revision").alias("known"))
        ids = now.groupBy("id").agg(F.min("revision").alias("new"))  # of several rows of an id, the least revision holds
        changed = stored(ids.join(old, F.col("id") == F.col("of"), "left").where("known is null or known <> new").select("id", "new"))
        dealt = now.repartition(max(1, 4 * now.rdd.getNumPartitions()), "id")  # small tasks, which sort their postings in memory
        fresh = dealt.join(changed, "id").where("revision <= new").select("id", "text").dropDuplicates(["id"])
        whole = blocks(fresh).groupBy("id").agg(F.collect_list(F.struct("block_id", "start", "end", "body")).alias("b"))
        words = whole.select("id", F.transform("b", lambda x: F.struct(x["block_id"].alias("block_id"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), F.coalesce(tokens(x["body"]), F.array().cast("array<string>")).alias("t"))).alias("b"))
        rows = words.mapInArrow(_bucket_lists, _LISTS)
        at = f"{self.path}/postings/generation={generation}"
        rows.sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(at)
        changed = changed.withColumnRenamed("new", "revision")
        if complete:
            gone = old.join(ids, F.col("of") == F.col("id"), "left_anti").select(F.col("of").alias("id"), F.lit(None).cast("string").alias("revision"))
            changed = changed.union(gone)
        changed.withColumn("generation", F.lit(generation)).write.mode("append").parquet(f"{self.path}/maps")
        return generation

    def _current(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.maps().select("id", "generation"), ["id", "generation"])

    def best(self, query: str, k: int = 2, within: DataFrame | None = None) -> DataFrame:
        """(id, block_id, start, end, score, place): the `k` best blocks of each record that holds a term of the query.

        BM25 with the record's own statistics: its blocks, their mean length, and in how many of them a term stands. Ties go to
        the earlier block. `within` has the ids of the records to look at, such as the hits of a search.
        """
        terms = query_plan(query)[0]
        wanted = self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.crc32("t"), F.lit(BUCKETS)).cast("int").alias("b")).collect()  # at most 32 terms
        found = self._read("postings", _POSTINGS).where(F.col("bucket").isin(sorted({r.b for r in wanted})))
        hits = F.filter(F.arrays_zip("term", "tf", "block_id", "start", "end", "dl"), lambda x: x["term"].isin(terms))
        found = found.select("id", "generation", "n_blocks", "words", F.inline(hits))
        if within is not None:
            found = found.join(within.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        known = self._current(found)
        df = F.count("*").over(Window.partitionBy("id", "term"))
        idf = F.greatest(F.ln((F.col("n_blocks") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        mean = F.col("words") / F.col("n_blocks")
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
        scored = known.withColumn("part", part).groupBy("id", "block_id", "start", "end").agg(F.round(F.sum("part"), 12).alias("score"))  # twelve places, as the least weight is a millionth
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "start"))
        return scored.withColumn("place", place).where(F.col("place") <= k)

    def compact(self, path: str) -> BlockIndex:
        """A copy under another folder, with what is current alone and one generation."""
        out = BlockIndex(self.spark, path)
        rows = self._current(self._read("postings", _POSTINGS)).drop("generation")
        rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{out.path}/postings/generation=0")
        self.maps().select("id", "revision", F.lit(0).alias("generation")).write.parquet(f"{out.path}/maps")
        return out
