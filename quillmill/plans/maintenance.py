"""Guarded writes, counters, integrity and membership checks, and time texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import query, table


@query("""WITH o AS (SELECT doc_id, source AS payload FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '*' ELSE source END AS payload FROM documents WHERE lang IN ('en', 'fr'))
SELECT n.doc_id, n.payload, o.doc_id IS NULL AS fresh FROM n LEFT JOIN o ON n.doc_id = o.doc_id WHERE o.doc_id IS NULL OR o.payload IS DISTINCT FROM n.payload""")
def guarded_upsert(spark, d):
    """Only the rows that a write would change."""
    docs = table(spark, d, "documents")
    old = docs.where("lang IN ('en', 'de')").select("doc_id", F.col("source").alias("before"), F.lit(True).alias("there"))
    new = docs.where("lang IN ('en', 'fr')").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("*"))).otherwise(F.col("source")).alias("payload"))
    changed = F.col("there").isNull() | ~F.col("before").eqNullSafe(F.col("payload"))
    return new.join(old, "doc_id", "left").where(changed).select("doc_id", "payload", F.col("there").isNull().alias("fresh"))


@query("""SELECT 'orders' AS child, count(*) AS orphans FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'lineitem_part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)""")
def referential_checks(spark, d):
    def orphans(child, key, parent, parent_key, name):
        return child.join(parent, F.col(key) == F.col(parent_key), "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("child"), "orphans")

    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    a = orphans(o, "o_custkey", table(spark, d, "customer").select("c_custkey"), "c_custkey", "orders")
    b = orphans(li, "l_orderkey", o.select("o_orderkey"), "o_orderkey", "lineitem")
    c = orphans(li, "l_partkey", table(spark, d, "part").select("p_partkey"), "p_partkey", "lineitem_part")
    return a.unionByName(b).unionByName(c)


@query("SELECT event_type, count(*) AS counter, max(event_id) AS last_event FROM events GROUP BY event_type")
def progress_counters(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("counter"), F.max("event_id").alias("last_event"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'v2' ELSE 'v1' END AS version FROM events")
def version_relabel(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "v2").otherwise("v1").alias("version"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS job FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id")
def claim_oldest(spark, d):
    """The oldest open job of each owner."""
    return table(spark, d, "events").where("event_type IN ('click', 'error')").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("job"))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_errors(spark, d):
    return table(spark, d, "events").where("event_type IN ('error', 'purchase')").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY user_id, event_type")
def latest_receipt(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("""WITH r AS (SELECT source, n_chars, text, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY source, n_chars, text)
SELECT a.id AS a, b.id AS b, a.copies AS copies_a, b.copies AS copies_b FROM r a JOIN r b ON a.source = b.source AND a.n_chars = b.n_chars AND a.id < b.id""")
def uncertain_pairs(spark, d):
    """Pairs that agree in source and size, but not in text; equal texts are one representative, with their number."""
    docs = table(spark, d, "documents").groupBy("source", "n_chars", F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    left, right = (docs.select("source", "n_chars", F.col("id").alias(k), F.col("copies").alias(f"copies_{k}")) for k in "ab")
    return left.join(right, ["source", "n_chars"]).where("a < b").select("a", "b", "copies_a", "copies_b")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) - min(turn) + 1 <> count(DISTINCT turn)")
def missing_members(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("span"), F.countDistinct("turn").alias("n")).where("span <> n").select("conv_id")


@query("""SELECT n_regionkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY n_regionkey""")
def distinct_over_joins(spark, d):
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    rows = n.select("n_nationkey", "n_regionkey").join(c.select("c_custkey", "c_nationkey"), F.col("n_nationkey") == F.col("c_nationkey")).join(o.select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("n_regionkey").agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct("o_orderkey").alias("orders"))


@query("""WITH c AS (SELECT conv_id, turn, nullif(role, 'system') AS account FROM conversations) SELECT a.conv_id, a.turn, count(*) AS same FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.account IS NOT DISTINCT FROM b.account GROUP BY a.conv_id, a.turn""")
def null_safe_join(spark, d):
    """How many turns of the conversation have the same speaker, an unknown one counting as one speaker."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.nullif(F.col("role"), F.lit("system")).alias("account"))
    size = c.groupBy("conv_id", "account").agg(F.count("*").alias("n"))
    one = c.alias("a").join(size.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & F.col("a.account").eqNullSafe(F.col("b.account")))
    return one.groupBy(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn")).agg(F.sum("n").alias("same"))


@query("""SELECT event_id, CAST(len(list_filter(json_keys(props), lambda k: k <> 'id')) AS BIGINT) AS unknown_fields FROM events""")
def unknown_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.size(F.array_except(F.json_object_keys("props"), F.array(F.lit("id")))).cast("long").alias("unknown_fields"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' ELSE 'soon' END AS s FROM orders)
SELECT o_orderkey, CAST(epoch(TRY_CAST(s AS TIMESTAMPTZ)) AS BIGINT) AS seconds FROM t WHERE s <> 'soon' UNION ALL SELECT o_orderkey, -1 FROM t WHERE s = 'soon'""")
def time_texts(spark, d):
    """Dates, UTC and offset times as seconds; -1 for what is no time."""
    day, full = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, day).when(k == 1, F.concat(full, F.lit("Z"))).when(k == 2, F.concat(full, F.lit("+02:00"))).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.unix_seconds(F.try_to_timestamp(text)), F.lit(-1)).alias("seconds"))


@query("""WITH q AS (SELECT doc_id, sha256(text) AS h, strlen(text) AS size FROM documents), r AS (SELECT doc_id, sum(size) OVER (PARTITION BY substr(h, 1, 2) ORDER BY h, doc_id) AS used, substr(h, 1, 2) AS folder FROM q)
SELECT folder, doc_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 6000""")
def queue_caps(spark, d):
    """Of each folder of a queue, the packets in the order of their digests that fit under the cap."""
    w = Window.partitionBy("folder").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("size")).withColumn("folder", F.substring("h", 1, 2))
    return rows.withColumn("used", F.sum("size").over(w)).where("used <= 6000").select("folder", "doc_id", "used")


@query("""WITH s AS (SELECT doc_id, lang, source FROM documents), a AS (SELECT DISTINCT source FROM s WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM s WHERE lang = 'fr')
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_second""")
def inventory_equality(spark, d):
    """Two inventories are the same if neither has what the other lacks."""
    docs = table(spark, d, "documents")
    a, b = docs.where("lang = 'en'").select("source").distinct(), docs.where("lang = 'fr'").select("source").distinct()
    sides = a.join(b, "source", "left_anti").select(F.lit(1).alias("first")).unionByName(b.join(a, "source", "left_anti").select(F.lit(0).alias("first")))
    return sides.agg(F.count(F.when(F.col("first") == 1, 1)).alias("only_first"), F.count(F.when(F.col("first") == 0, 1)).alias("only_second"))


@query("""SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS priority FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate DESC, l_partkey, l_suppkey, l_quantity) <= 2""")
def label_priority(spark, d):
    """The two best pieces of evidence of each record: by label, then the latest."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = table(spark, d, "lineitem").withColumn("priority", rank.cast("int"))
    return R.newest_per_key(rows, ["l_orderkey"], [F.col("priority"), F.desc("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")], 2).select("l_orderkey", "l_partkey", "priority")
