"""Operators on records: projects, validation, identity, alignment and provenance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_of(text: Column, projects: dict[str, list[str]], default: str | None = "general") -> Column:
    """The first project one of whose terms occurs, without regard to case."""
    out, low = F, F.lower(text)
    for name, terms in projects.items():
        test = F.lit(False)
        for t in terms:
            test = test | low.contains(t.lower())
        out = out.when(test, name)
    return out.otherwise(default)


def compatible(a: Column, b: Column) -> Column:
    """Equal, or one of them unknown (null or empty)."""
    unknown = lambda x: x.isNull() | (x == "")
    return unknown(a) | unknown(b) | (a == b)


#: Rows of either side in a tile, and pairs that a task looks at on the average.
TILE_ROWS, TASK_PAIRS = 4096, 1 << 24


def near_pairs(a: DataFrame, b: DataFrame, keys: tuple[str, str], values: tuple[str, str], width: float) -> DataFrame:
    """Rows of `a` beside those of `b` with an equal key, where a value is unknown (negative) or both are less than `width` apart.

    Rows meet in cells: an unknown value meets all of its key, known ones only those of their own or a neighbouring band of
    values. Cells of many rows are cut into tiles, and there are as many tasks as the pairs need, so that a task looks at
    about `TASK_PAIRS` pairs however few keys there are. A pair is looked at in one cell only.
    """
    (a_key, b_key), (x, y) = keys, map(F.col, values)
    step = 2.0 ** math.ceil(math.log2(width) + 1e-9)  # a power of two, by which division is exact; larger than the width
    band = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(v.cast("double") / step, F.lit(1e15))))
    every, unknown, none = F.lit(-3).cast("long"), F.lit(-2).cast("long"), F.array().cast("array<bigint>")
    a_cells = F.when(x < 0, F.array(every)).otherwise(F.concat(F.array(unknown), F.when(x >= 0, F.array(band(x))).otherwise(none)))
    b_cells = F.concat(F.array(every), F.when(y < 0, F.array(unknown)).when(y >= 0, F.sequence(band(y) - 1, band(y) + 1)).otherwise(none))
    left = a.where(F.col(a_key).isNotNull()).withColumn("__cell", F.explode(a_cells))
    right = b.where(F.col(b_key).isNotNull()).withColumn("__cell", F.explode(b_cells))
    count = lambda df, key, n: df.groupBy(F.col(key).alias("__key"), "__cell").agg(F.count("*").alias(n))
    sizes = count(left, a_key, "__m").join(count(right, b_key, "__n"), ["__key", "__cell"])
    pairs = sizes.agg(F.sum(F.col("__m").cast("double") * F.col("__n"))).first()[0] or 0.0
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))
    tiles = lambda n: F.ceil(F.col(n) / TILE_ROWS)
    large = F.broadcast(sizes.where(F.greatest("__m", "__n") > TILE_ROWS).select("__key", "__cell", tiles("__m").alias("__r"), tiles("__n").alias("__c")))  # fewer than rows / TILE_ROWS

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*(c for c in df.columns if c != "__cell")), F.coalesce(F.col(own), F.lit(1)))
        rows = df.withColumn("__key", F.col(key)).join(large, ["__key", "__cell"], "left").withColumn(f"{own}_at", mine)
        rows = rows.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1)).cast("long") - 1))).drop("__r", "__c")
        return rows.repartition(tasks, "__key", "__cell", "__r_at", "__c_at")

    met = dealt(left, a_key, "__r", "__c").join(dealt(right, b_key, "__c", "__r").hint("merge"), ["__key", "__cell", "__r_at", "__c_at"])
    return met.where((F.col("__cell") < -1) | (F.abs(x - y) < width)).select(*a.columns, *b.columns)


def align(short: DataFrame, long: DataFrame, group: str, key: str, order: str, least: int = 2) -> DataFrame:
    """(group, offset): where the whole of the shorter list occurs in the longer one of the same group, if only once.

    Lists are rows (group, order, key), order from 0. Pairs of equal keys vote for their offset.
    """
    sizes = short.groupBy(group).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    pairs = short.select(group, key, F.col(order).alias("a")).join(long.select(group, key, F.col(order).alias("b")), [group, key])
    runs = pairs.groupBy(group, (F.col("b") - F.col("a")).alias("offset")).agg(F.count("*").alias("n")).join(sizes, group).where("n = size")
    once = runs.groupBy(group).agg(F.count("*").alias("times"), F.min("offset").alias("offset")).where("times = 1")
    return once.select(group, "offset")


def packet_errors(messages: Column, limit: int = 10000) -> Column:
    """The first thing wrong with a packet's messages, or null: none, too many, empty text, or a repeated id or order."""
    def repeated(name: str) -> Column:
        given = F.filter(F.transform(messages, lambda m: m[name]), lambda x: x.isNotNull())
        return F.size(F.array_distinct(given)) != F.size(given)

    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "no_messages")
        .when(F.size(messages) > limit, "too_many_messages")
        .when(F.exists(messages, lambda m: m["text"].isNull() | (m["text"] == "")), "empty_text")
        .when(repeated("message_id"), "duplicate_message_id")
        .when(repeated("source_order"), "duplicate_source_order")
    )


def packet_checks(messages: DataFrame, packet: str, text: str, message_id: str, source_order: str, limit: int = 10000) -> DataFrame:
    """(packet, n_messages, error) by counts alone, as `packet_errors` says of an array: no packet is held in one row."""
    def repeats(name: str, alias: str) -> DataFrame:
        often = messages.where(F.col(name).isNotNull()).groupBy(packet, name).agg(F.count("*").alias("n")).where("n > 1")
        return often.select(F.col(packet).alias("of"), F.lit(alias).alias("what")).distinct()

    empty = F.max((F.col(text).isNull() | (F.col(text) == "")).cast("int"))
    counts = messages.groupBy(packet).agg(F.count("*").alias("n_messages"), empty.alias("empty"))
    found = repeats(message_id, "duplicate_message_id").unionByName(repeats(source_order, "duplicate_source_order")).groupBy("of").agg(F.min("what").alias("what"))
    error = F.when(F.col("n_messages") > limit, "too_many_messages").when(F.col("empty") == 1, "empty_text").otherwise(F.col("what"))
    return counts.join(found, counts[packet] == F.col("of"), "left").select(packet, "n_messages", error.alias("error"))
