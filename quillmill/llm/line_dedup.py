"""Line deduplication over a suffix array of line-ID sequences, built by distributed prefix doubling.

Every line that is not blank becomes an id; lines that occur once end a run and leave at once. The suffixes that start at
the other lines are ranked by their first 1, 2, 4, ... lines: a round pairs the rank at a line with the rank at the line
2^k further on, keeps pairs that occur more than once, and ranks them by a global sort. Rounds end when no pair repeats, so
the last rank of a suffix is its place in the suffix array, and the ranks of a round name the intervals of suffixes that
share 2^k lines.

From these ranks each suffix gets the length of the longest prefix that it shares with an earlier suffix: the levels are
walked down from the deepest, and at each the members of a longest-common-prefix interval are split by the rank of what
follows, the interval's earliest suffix among them. All but the earliest of a part move on into it, as their prefix has an
earlier copy; the earliest stays and stands for its part at the levels below. That prefix, if it has `min_words` words at least, is a later copy of a repeated run; the
union of all such prefixes is deleted.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, map_rows, stored

#: Words of a run from which its later copies go. Shorter ones are common phrases: see the README for what each size deletes.
MIN_WORDS = 50
_WORD = re.compile(r"\w+")


def line_ids(docs: DataFrame) -> DataFrame:
    """(id, tk, seq, line, h1, h2, words) for each line of (id, tk, text) that is not blank; seq counts these lines, line all."""

    def each(batch: pa.RecordBatch):
        at: list[int] = []
        columns: list[list] = [[], [], []]
        digests: list[bytes] = []
        for i, text in enumerate(batch.column(2).to_pylist()):
            seq = 0
            for n, line in enumerate(text.split("\n")):
                line = line.strip()
                if line:
                    at.append(i)
                    digests.append(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    for column, x in zip(columns, (seq, n, len(_WORD.findall(line))), strict=True):
                        column.append(x)
                    seq += 1
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        ids = [batch.column(k).take(pa.array(at, pa.int64())) for k in (0, 1)]
        seq, line, words = (pa.array(c, pa.int32()) for c in columns)
        yield pa.RecordBatch.from_arrays([*ids, seq, line, pa.array(h[:, 0]), pa.array(h[:, 1]), words], ["id", "tk", "seq", "line", "h1", "h2", "words"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_rows(docs, each, f"id {kind}, tk long, seq int, line int, h1 long, h2 long, words int")


def _offsets(ordered: DataFrame) -> dict[int, int]:
    """Rows before each partition; one number a partition comes to the driver."""
    counts = {r.p: r.n for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p] = total
        total += counts[p]
    return offsets


def dense_rank(keys: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows `keys` with their rank in the order of `columns`, from 0, by a range sort and one offset a partition."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(keys.repartitionByRange(n, *columns).sortWithinPartitions(*columns))
    offsets = _offsets(ordered)

    def number(batches):
        from pyspark import TaskContext

        at = offsets.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "rank"])
            at += batch.num_rows

    return ordered.mapInArrow(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields) + ", rank long")


def numbered(active: DataFrame) -> DataFrame:
    """The lines in the order of (id, tk, seq) with their number `p`, that of the first line of their run, and `upto`, the words of the run before them.

    A run is a row of consecutive lines of one document; a document is within one task.
    """
    n = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(active.repartitionByRange(n, "id", "tk").sortWithinPartitions("id", "tk", "seq"))
    offsets = _offsets(ordered)

    def number(batches):
        from pyspark import TaskContext

        at = offsets.get(TaskContext.get().partitionId(), 0)
        last, run, upto = None, at, 0
        for batch in batches:
            starts, before = [], []
            for k, (own, tk, seq, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "tk", "seq", "words")), strict=True)):
                if last != (own, tk, seq - 1):
                    run, upto = at + k, 0
                last = (own, tk, seq)
                starts.append(run)
                before.append(upto)
                upto += words
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows)), pa.array(starts, pa.int64()), pa.array(before, pa.int64())], [*batch.schema.names, "p", "run", "upto"])
            at += batch.num_rows

    return ordered.mapInArrow(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in active.schema.fields) + ", p long, run long, upto long")


def prefix_levels(placed: DataFrame) -> list[DataFrame]:
    """(p, run, rank) by the first 1, 2, 4, ... lines, for the suffixes that share so many lines with another."""
    levels = [placed.select("p", "run", "rank")]
    while True:
        now, step = levels[-1], 1 << len(levels) - 1
        ahead = now.select((F.col("p") - step).alias("p"), "run", F.col("rank").alias("r2"))
        paired = stored(now.withColumnRenamed("rank", "r1").join(ahead, ["p", "run"]))
        often = paired.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        level = stored(paired.join(dense_rank(often, "r1", "r2"), ["r1", "r2"]).select("p", "run", "rank"))
        if level.isEmpty():
            return levels
        levels.append(level)


def earlier_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(p, length): lines of the longest prefix of suffix p that an earlier suffix has too; none where there is no such line."""
    state = None
    nowhere = F.lit(-1).cast("long")
    for k in reversed(range(len(levels))):
        level = levels[k]
        if state is None:
            keyed = level.select("p", "run", F.lit(0).cast("long").alias("length"), nowhere.alias("first"), nowhere.alias("home"), "rank")
            parts = keyed
        else:
            known = level.select("p", "run").join(state, "p", "left").select("p", "run", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("first", nowhere).alias("first"), F.coalesce("home", nowhere).alias("home"))
            ahead = level.select(F.col("p").alias("q"), F.col("run").alias("of"), "rank")
            keyed = stored(known.join(ahead, (F.col("p") + F.col("length") == F.col("q")) & (F.col("run") == F.col("of")), "left").select("p", "run", "length", "first", "home", "rank").where("rank is not null or length > 0"))
            # the earliest suffix of an interval has a state of its own, and takes part here as well
            anchors = keyed.where("first >= 0").select(F.col("first").alias("p"), F.col("home").alias("run"), "length", "first", "home").distinct()
            anchored = anchors.join(ahead, (F.col("p") + F.col("length") == F.col("q")) & (F.col("run") == F.col("of"))).select(*keyed.columns)
            parts = keyed.where("rank is not null").union(anchored)
        interval = ["first", "length", "rank"]
        parts = stored(parts.groupBy(*interval).agg(F.min(F.struct("p", "run")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
        on = keyed.join(parts, interval, "left")
        later = F.coalesce(F.col("least.p") < F.col("p"), F.lit(False))
        state = stored(on.select("p", (F.col("length") + F.when(later, 1 << k).otherwise(0)).alias("length"), F.when(later, F.col("least.p")).otherwise(F.col("first")).alias("first"), F.when(later, F.col("least.run")).otherwise(F.col("home")).alias("home")).where("length > 0"))
    return state.select("p", "length")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tk, spans) for each document of (id, tk, text) with lines to delete; a span is the first and last line."""
    lines = cut_lineage(line_ids(docs.where("id is not null")))
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ranked = dense_rank(often, "h1", "h2")
    active = lines.join(ranked, ["h1", "h2"]).select("id", "tk", "seq", "line", "words", "rank").dropDuplicates(["id", "tk", "seq"])
    placed = stored(numbered(active))
    copies = earlier_prefixes(prefix_levels(placed))
    ends = placed.select((F.col("p")).alias("q"), F.col("line").alias("end"), (F.col("upto") + F.col("words")).alias("through"))
    found = placed.join(copies, "p").withColumn("q", F.col("p") + F.col("length") - 1).join(ends, "q").where(F.col("through") - F.col("upto") >= min_words)
    spans = found.groupBy("id", "tk", "end").agg(F.min("line").alias("begin"))
    return spans.groupBy("id", "tk").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, outputs: tuple[str, str, str] = ("n_lines", "n_removed", "removed")) -> DataFrame:
    """The rows with later copies of repeated line runs deleted from the text, and n_lines, n_removed, removed (line numbers).

    A run counts from `min_words` words; with 1, every later copy of a line that holds a word goes. The earliest copy, by
    id, then text hash, then line, stays whole or survives in one still earlier. Lines are compared without the white space
    around them; blank lines are no part of a run but go with the run around them. Null texts and rows without id stay as
    they are; rows that repeat id and text are one document and stay alike. All columns stay; an output whose name is taken
    gets underscores after it (`outputs` may give others).
    """
    tk, own_id, own_tk, spans_col, gone, lines = fresh(docs, "tk", "own_id", "own_tk", "spans", "gone", "lines")
    keyed = docs.withColumn(tk, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    spans = repeated_runs(keyed.select(F.col(id_col).alias("id"), F.col(tk).alias("tk"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), min_words)
    spans = spans.select(F.col("id").alias(own_id), F.col("tk").alias(own_tk), F.col("spans").alias(spans_col))
    joined = keyed.join(spans, (F.col(id_col) == F.col(own_id)) & (F.col(tk) == F.col(own_tk)), "left")
    numbers = F.array_distinct(F.flatten(F.transform(spans_col, lambda s: F.sequence(s["begin"], s["end"]))))
    out = joined.withColumn(gone, F.coalesce(numbers, F.array().cast("array<int>"))).withColumn(lines, F.split(F.col(text_col), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.size(gone) > 0, F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")).otherwise(F.col(text_col))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    names = fresh(docs, *outputs, hidden=False)
    return out.select(*columns, *(x.alias(n) for x, n in zip((F.coalesce(F.size(lines), F.lit(0)), F.size(gone), F.col(gone)), names, strict=True)))
