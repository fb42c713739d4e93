"""Ranked, ordered, differential and consistency operators on plain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, place: str | None = None) -> DataFrame:
    """The first n rows of each key in the given order, with their `place` from 1 if it has a name."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = df.withColumn("__rank", rank).where(F.col("__rank") <= n)
    return first.drop("__rank") if place is None else first.withColumn(place, F.col("__rank").cast("long")).drop("__rank")


def position(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def neighbours(df: DataFrame, anchors: DataFrame, keys: list[str], before: int, after: int, position_col: str = "position") -> DataFrame:
    """Rows at most `before` ahead of or `after` behind each anchor of the same key: an equi-join on exploded offsets."""
    around = anchors.select(*keys, F.col(position_col).alias("anchor"), F.explode(F.sequence(F.col(position_col) - before, F.col(position_col) + after)).alias(position_col))
    return df.join(around, [*keys, position_col])


def carried_state(df: DataFrame, keys: list[str], order: list[Column], toggle: Column, initial: bool = False, name: str = "paused") -> DataFrame:
    """State set by the last toggle before the row (null: no toggle)."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.last(toggle, ignorenulls=True).over(before), F.lit(initial)))


def islands(df: DataFrame, keys: list[str], order: list[Column], starts: Column, name: str = "island") -> DataFrame:
    """Number of rows up to this one that start an island."""
    return df.withColumn(name, F.sum(starts.cast("long")).over(Window.partitionBy(*keys).orderBy(*order)))


def fair_queue(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """Round robin over groups: all first rows, then all second rows, ..., up to `limit`.

    No group gives more than `limit` rows: that filter makes Spark cut each group down before it is shuffled.
    """
    return newest_per_key(df, [group], order, limit, "turn").orderBy("turn", *order).limit(limit)


def keyset_page(df: DataFrame, id_col: str, after, limit: int) -> DataFrame:
    return (df if after is None else df.where(F.col(id_col) > after)).orderBy(id_col).limit(limit)


def membership_fingerprint(df: DataFrame, id_col: str) -> DataFrame:
    """Count and an order-free digest of the ids: two sums and a xor, so that it needs no single task.

    The hashes have 48 bits: some 65,000 of them go over a long, so they are added as decimals.
    """
    h = F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 12), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("total"))


def diff(old: DataFrame, new: DataFrame, id_col: str, fingerprint: str) -> DataFrame:
    """(id, action): insert, update, delete or keep, by fingerprint."""
    a, b = old.select(id_col, F.col(fingerprint).alias("old_print")), new.select(id_col, F.col(fingerprint).alias("new_print"))
    action = F.when(F.col("old_print").isNull(), "insert").when(F.col("new_print").isNull(), "delete").when(F.col("old_print") == F.col("new_print"), "keep").otherwise("update")
    return a.join(b, id_col, "full_outer").select(id_col, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last writer wins by key."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows are added only where the key is not there yet."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def fill_unknown(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Null fields of old rows taken from new ones; known ones never overwritten."""
    given = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return old.join(given, keys, "left").select(*(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in old.columns))


def missing_and_unexpected(expected: DataFrame, present: DataFrame, id_col: str) -> DataFrame:
    """(state, n) of ids that are only expected, or only present."""
    e, p = expected.select(id_col), present.select(id_col)
    rows = e.join(p, id_col, "left_anti").select(F.lit("missing").alias("state")).unionByName(p.join(e, id_col, "left_anti").select(F.lit("unexpected").alias("state")))
    return rows.groupBy("state").agg(F.count("*").alias("n"))


def surplus_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows repeat a key: the sum of n - 1."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def conflicts(facts: DataFrame, keys: list[str], value: str, member: str) -> DataFrame:
    """Keys with more than one distinct value, without regard to case, and their sorted members."""
    return facts.groupBy(*(F.lower(k).alias(k) for k in keys)).agg(F.countDistinct(F.lower(value)).alias("n_values"), F.array_sort(F.collect_set(member)).alias("members")).where("n_values > 1")


def canonical_roots(spark, links: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, root, error) by following parents to the end; a row without parent is its own root. Ids are unique.

    Each round puts the pointer of a pointer in its place, so that chains of n links take log2(n) rounds; rows that have
    arrived are joined no more. A row on or below a ring has no root but the error `ring`; one below a parent that is not
    there has the id of that parent and the error `missing_parent`.
    """
    start = links.select(F.col(id_col).alias("id"), F.coalesce(parent_col, id_col).alias("at"), F.when(F.col(parent_col).isNull(), F.lit("root")).alias("end"))
    moving = stored(start)
    n = max(2, moving.count())
    left = moving.where("end IS NULL").count()
    for _ in range(n.bit_length() + 1):
        if not left:
            break
        known = moving.select(F.col("id").alias("at"), F.col("at").alias("__at"), F.coalesce("end", F.lit("")).alias("__end"))
        ahead = moving.where("end IS NULL").join(known, "at", "left").select("id", F.coalesce("__at", "at").alias("at"), F.when(F.col("__end").isNull(), F.lit("missing_parent")).when(F.col("__end") != "", F.col("__end")).alias("end"))
        moving = stored(moving.where("end IS NOT NULL").unionByName(ahead))
        left = moving.where("end IS NULL").count()
    error = F.when(F.col("end").isNull(), F.lit("ring")).when(F.col("end") != "root", F.col("end"))
    return moving.select("id", F.when(F.col("end").isNotNull(), F.col("at")).alias("root"), error.alias("error"))
