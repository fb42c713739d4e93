"""Views of groups that are kept up to date by what changes, instead of being made anew.

Records lie in buckets of their group, a small table of places says in which bucket a record lies, and the view has one row a
group. A batch of changes is first turned into signed rows: what it takes back and what it adds. Counts and sums follow from
these alone. The least and greatest time and the members shown are merged while only additions touch them; groups that lose
such a row are read again from their buckets. Only partitions that hold a changed record or group are written.

A batch has a number, and its signed rows are stored before anything is written; one that breaks off is given again under
the same number, finds them, and passes over the buckets of the view that have had it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS, MEMBERS = 64, 3
_RECORD = "id string, grp string, at long, size long, summary string"
_MEMBER = "struct<id:string,summary:string>"
_VIEW = f"grp string, n long, size long, first_at long, last_at long, members array<{_MEMBER}>, epoch long"
_FIELDS = [c.split()[0] for c in _RECORD.split(", ")]


def _bucket(name: str):
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def shown(entries, most: int = MEMBERS):
    """The least id of each summary that is not null, and of these entries the first ones."""
    held = F.array_sort(F.filter(entries, lambda x: x["summary"].isNotNull()))
    distinct = F.aggregate(held, F.array().cast(f"array<{_MEMBER}>"), lambda out, x: F.when((F.size(out) < most) & ~F.exists(out, lambda y: y["summary"] == x["summary"]), F.array_append(out, x)).otherwise(out))
    return distinct


def _first_members(rows: DataFrame) -> DataFrame:
    """(grp, members) of records: first the least id of each summary, then the first few of a group; no group is collected whole."""
    least = rows.where("summary is not null").groupBy("grp", "summary").agg(F.min("id").alias("id"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("id"))
    few = least.withColumn("place", place).where(F.col("place") <= MEMBERS)
    return few.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("id", "summary"))).alias("members"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(grp, n, size, first_at, last_at, members) of records from scratch."""
    sums = rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    own = _first_members(rows).withColumnRenamed("grp", "of")
    return sums.join(own, F.col("grp").eqNullSafe(F.col("of")), "left").select("grp", "n", "size", "first_at", "last_at", F.coalesce("members", F.array().cast(f"array<{_MEMBER}>")).alias("members"))


class GroupView:
    """Tables records, places, changes and view under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str, **within) -> DataFrame:
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing written yet
            rows = self.spark.createDataFrame([], schema)
        for column, values in within.items():
            rows = rows.where(F.col(column).isin(sorted(values)) if values else F.lit(False))
        return rows

    def _replace(self, name: str, rows: DataFrame, by: str, touched: set[int]) -> None:
        """Write the touched partitions, and no other; a row without key keeps an emptied one."""
        marks = self.spark.createDataFrame([(k,) for k in sorted(touched)], f"{by} int")
        blank = marks.select(*(F.col(c) if c == by else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
        rows.union(blank).repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")

    def view(self) -> DataFrame:
        return self._read("view", f"{_VIEW}, bucket int").where("n > 0").drop("epoch", "bucket")

    def records(self) -> DataFrame:
        return self._read("records", f"{_RECORD}, bucket int").where("id is not null").select(*_FIELDS)

    @staticmethod
    def _numbers(rows: DataFrame, column: str) -> set[int]:
        return {r[0] for r in rows.select(column).distinct().collect()}  # at most BUCKETS

    def signed(self, number: int, changes: DataFrame) -> DataFrame:
        """The rows that a batch takes back (-1) and adds (1), stored under its number."""
        schema = f"{_RECORD}, sign int, bucket int"
        at = f"{self.path}/changes/{number}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            one = changes.where("id is not null").groupBy("id").agg(F.max(F.struct((F.col("op") == "put").alias("put"), *_FIELDS[1:])).alias("r")).select("id", "r.*")
            keyed = one.withColumn("slot", _bucket("id"))
            places = self._read("places", "id string, bucket int, slot int", slot=self._numbers(keyed, "slot")).where("id is not null")
            mine = places.join(one.select("id"), "id", "left_semi")
            old = self._read("records", f"{_RECORD}, bucket int", bucket=self._numbers(mine, "bucket")).where("id is not null").join(one.select("id"), "id", "left_semi").select(*_FIELDS)
            new = one.where("put").select(*_FIELDS)
            rows = old.exceptAll(new).withColumn("sign", F.lit(-1)).union(new.exceptAll(old).withColumn("sign", F.lit(1)))
            rows.withColumn("bucket", _bucket("grp")).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(schema).parquet(at)

    def _records_after(self, rows: DataFrame, touched: set[int]) -> DataFrame:
        """The records of the touched buckets with the changes made; made twice, they are the same."""
        kept = self._read("records", f"{_RECORD}, bucket int", bucket=touched).where("id is not null").join(rows.select("id").distinct(), "id", "left_anti")
        return kept.select(*_FIELDS, "bucket").union(rows.where("sign = 1").select(*_FIELDS, "bucket"))

    def write_view(self, number: int, rows: DataFrame) -> None:
        touched = self._numbers(rows, "bucket")
        before = self._read("view", f"{_VIEW}, bucket int", bucket=touched)
        touched -= self._numbers(before.where(F.col("epoch") == number), "bucket")
        if not touched:
            return
        before = self._read("view", f"{_VIEW}, bucket int", bucket=touched).where("grp is not null")
        changed = rows.where(F.col("bucket").isin(sorted(touched)))
        plus, minus = F.col("sign") == 1, F.col("sign") == -1
        sums = changed.groupBy(F.col("grp").alias("of"), F.col("bucket").alias("b")).agg(
            F.sum("sign").alias("dn"), F.sum(F.col("sign") * F.coalesce("size", F.lit(0))).alias("ds"), F.min(F.when(plus, F.col("at"))).alias("low"), F.max(F.when(plus, F.col("at"))).alias("high"),
            F.min(F.when(minus, F.col("at"))).alias("lost_low"), F.max(F.when(minus, F.col("at"))).alias("lost_high"))
        lost = changed.where(minus).join(before.select("grp", F.explode("members.id").alias("id")), ["grp", "id"]).select(F.col("grp").alias("l")).distinct()
        added = _first_members(changed.where(plus)).select(F.col("grp").alias("m"), F.col("members").alias("more"))
        joined = before.join(sums, F.col("grp") == F.col("of"), "full").join(lost, F.col("of") == F.col("l"), "left").join(added, F.col("of") == F.col("m"), "left")
        again = F.coalesce(F.col("l").isNotNull() | (F.col("lost_low") <= F.col("first_at")) | (F.col("lost_high") >= F.col("last_at")), F.lit(False))
        none = F.array().cast(f"array<{_MEMBER}>")
        merged = joined.select(
            F.coalesce("grp", "of").alias("grp"), (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"), (F.coalesce("size", F.lit(0)) + F.coalesce("ds", F.lit(0))).alias("size"),
            F.least("first_at", "low").alias("first_at"), F.greatest("last_at", "high").alias("last_at"), shown(F.concat(F.coalesce("members", none), F.coalesce("more", none))).alias("members"),
            F.lit(number).cast("long").alias("epoch"), F.coalesce("bucket", "b").alias("bucket"), again.alias("again"))
        stale = merged.where("again and n > 0").select("grp")
        fresh = rebuilt(self._records_after(changed, touched).join(stale, "grp", "left_semi")).select(F.col("grp").alias("g"), F.col("first_at").alias("f"), F.col("last_at").alias("t"), F.col("members").alias("shown"))
        now = merged.where("n > 0").join(fresh, F.col("grp") == F.col("g"), "left")
        over = lambda a, b: F.when(F.col("again"), F.col(a)).otherwise(F.col(b)).alias(b)
        out = now.select("grp", "n", "size", over("f", "first_at"), over("t", "last_at"), over("shown", "members"), "epoch", "bucket")
        self._replace("view", out, "bucket", touched)

    def write_records(self, rows: DataFrame) -> None:
        touched = self._numbers(rows, "bucket")
        if not touched:
            return
        self._replace("records", self._records_after(rows, touched), "bucket", touched)
        keyed = rows.withColumn("slot", _bucket("id"))
        slots = self._numbers(keyed, "slot")
        kept = self._read("places", "id string, bucket int, slot int", slot=slots).where("id is not null").join(rows.select("id").distinct(), "id", "left_anti")
        self._replace("places", kept.select("id", "bucket", "slot").union(keyed.where("sign = 1").select("id", "bucket", "slot")), "slot", slots)

    def apply(self, number: int, changes: DataFrame) -> None:
        """Bring the view up to date by rows (op, id, grp, at, size, summary), op being `put` or `delete`.

        Numbers rise from batch to batch. An id belongs in a batch once; of several rows a put stands before a delete, and the
        greatest before others. Rows without id are passed over; a record without group has none in the view.
        """
        rows = self.signed(number, changes.withColumn("grp", F.coalesce("grp", F.lit(""))))
        self.write_view(number, rows)
        self.write_records(rows)
