"""Aggregates, derived views, incremental maintenance and consistency checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import records, views
from ..operators import relational as R
from ..sources.tables import shared_folder
from .registry import query, table


@query("""SELECT d.lang, count(*) AS total, CAST(sum(CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS complete, CAST(sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS held,
round(100.0 * sum(CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END) / count(*), 2) AS pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def coverage(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    done = F.sum(F.when(F.col("quality").isNotNull(), 1).otherwise(0))
    return rows.groupBy("lang").agg(F.count("*").alias("total"), done.alias("complete"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("held"), F.round(100.0 * done / F.count("*"), 2).alias("pct"))


@query("""WITH s AS (SELECT source, CASE WHEN toxic = 1 THEN 0 WHEN quality IS NULL THEN 1 WHEN quality = 0 THEN 2 ELSE 3 END AS k FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, CASE min(k) WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'attention' ELSE 'ok' END AS state FROM s GROUP BY source""")
def state_rollup(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rank = F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNull(), 1).when(F.col("quality") == 0, 2).otherwise(3)
    return rows.groupBy("source").agg(F.element_at(F.array(*map(F.lit, ("failed", "partial", "attention", "ok"))), F.min(rank) + 1).alias("state"))


@query("""SELECT state, count(*) AS n FROM (SELECT 'missing' AS state FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'unexpected' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)) GROUP BY state""")
def missing_and_unexpected(spark, d):
    return R.missing_and_unexpected(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_index_rows(spark, d):
    return R.surplus_rows(table(spark, d, "documents").select(F.sha2("text", 256).alias("k")), ["k"])


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'es'), n AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE lang <> 'de')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' WHEN o.h = n.h THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def incremental_diff(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("lang <> 'es'").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.where("lang <> 'de'").select("doc_id", F.when(F.col("lang") == "fr", F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("h"))
    return R.diff(old, new, "doc_id", "h")


@query("""SELECT lower(event_type) AS event_type, user_id % 50 AS bucket, count(DISTINCT round(value, 1)) AS n_values, min(event_id) AS first_event FROM events GROUP BY ALL HAVING count(DISTINCT round(value, 1)) > 1""")
def conflict_detection(spark, d):
    rows = table(spark, d, "events").select(F.lower("event_type").alias("event_type"), (F.col("user_id") % 50).alias("bucket"), F.round("value", 1).alias("v"), "event_id")
    return rows.groupBy("event_type", "bucket").agg(F.countDistinct("v").alias("n_values"), F.min("event_id").alias("first_event")).where("n_values > 1")


@query("""SELECT o_custkey, CASE count(DISTINCT CAST(o_orderdate AS DATE)) WHEN 1 THEN 'message_date' ELSE 'conflicting_sources' END AS kind, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date FROM orders GROUP BY o_custkey""")
def date_conflicts(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.countDistinct(day) == 1, "message_date").otherwise("conflicting_sources").alias("kind"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_date"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 4")
def retention_keep_n(spark, d):
    return R.newest_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 4).select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2 OR row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""")
def head_tail_sample(spark, d):
    """Two group limits, so that neither sort moves more than a few rows of a user."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    head = R.newest_per_key(rows, ["user_id"], [F.col("ts"), F.col("event_id")], 2)
    tail = R.newest_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    return head.union(tail).select("user_id", "event_id").distinct()


@query("""SELECT event_id FROM (SELECT event_id, event_id <= 9990 AS wrapped FROM events) ORDER BY wrapped, event_id LIMIT 24""")
def rotating_sample(spark, d):
    """The next rows after a cursor, going on from the start when the end is reached."""
    return table(spark, d, "events").select("event_id", (F.col("event_id") <= 9990).alias("w")).orderBy("w", "event_id").limit(24).select("event_id")


@query("""WITH t AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn, value FROM events) SELECT event_id, event_type, turn FROM t ORDER BY turn, value DESC, event_id LIMIT 50""")
def fair_queue(spark, d):
    return R.fair_queue(table(spark, d, "events"), "event_type", [F.desc("value"), F.col("event_id")], 50).select("event_id", "event_type", "turn")


@query("""WITH n AS (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 19), o AS (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1) SELECT event_id FROM n UNION SELECT event_id FROM o""")
def old_backlog_union(spark, d):
    e = table(spark, d, "events")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(19).select("event_id").union(e.orderBy("ts", "event_id").limit(1).select("event_id")).distinct()


@query("""WITH l AS (SELECT conv_id, sha256(text) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p FROM conversations),
s AS (SELECT conv_id, k, p - 1 AS p FROM l WHERE p BETWEEN 1 AND 2), z AS (SELECT conv_id, count(*) AS size FROM s GROUP BY conv_id HAVING count(*) >= 2),
r AS (SELECT s.conv_id, l.p - s.p AS o, count(*) AS n FROM s JOIN l ON s.conv_id = l.conv_id AND s.k = l.k GROUP BY ALL)
SELECT r.conv_id, min(o) AS "offset" FROM r JOIN z ON r.conv_id = z.conv_id AND n = size GROUP BY r.conv_id HAVING count(*) = 1""")
def message_alignment(spark, d):
    """Where the excerpt of turns two and three stands in its conversation, if in one place only."""
    rows = R.position(table(spark, d, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")]).select("conv_id", F.sha2("text", 256).alias("k"), (F.col("position") - 1).alias("p"))
    short = rows.where("p BETWEEN 1 AND 2").withColumn("p", F.col("p") - 1)
    return records.align(short, rows, "conv_id", "k", "p")


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey - 1 END AS parent FROM customer WHERE c_custkey > 0),
w(id, node) AS (SELECT id, id FROM l UNION ALL SELECT w.id, l.parent FROM w JOIN l ON l.id = w.node WHERE l.parent IS NOT NULL)
SELECT id, min(node) AS root FROM w GROUP BY id""")
def canonical_root(spark, d):
    links = table(spark, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") - 1).alias("parent"))
    found = R.canonical_roots(spark, links, "id", "parent")  # the SQL takes a parent that is not there for the root; a ring has none
    return found.select("id", F.when(F.col("error") == "ring", F.raise_error(F.lit("ring of parents"))).otherwise(F.col("root")).alias("root"))


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS packets, count(DISTINCT l_partkey) AS objects, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS paths
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey""")
def provenance_collect(spark, d):
    """Parts are reduced to those of an order, then of a customer, before they are counted; so are orders."""
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_orderpriority")
    packets = orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("c_custkey", "o_orderkey").agg(F.collect_set("o_orderpriority").alias("p")).groupBy("c_custkey").agg(F.count("*").alias("packets"), F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_set("p"))))).alias("paths"))
    objects = orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select("c_custkey", "l_partkey").distinct().groupBy("c_custkey").agg(F.count("l_partkey").alias("objects"))
    return packets.join(objects, "c_custkey").select("c_custkey", "packets", "objects", "paths")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def receipt_anti_join(spark, d):
    seen = table(spark, d, "lineitem").where("l_quantity > 25").select("l_orderkey")
    o = table(spark, d, "orders")
    return o.join(seen, o.o_orderkey == seen.l_orderkey, "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT b.l_orderkey AS pass_id, b.l_partkey AS file FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_quantity >= 50")
def pass_self_join(spark, d):
    """All files of the passes that hold a lost one."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pass_id"), F.col("l_partkey").alias("file"), "l_quantity")
    return rows.join(rows.where("l_quantity >= 50").select("pass_id"), "pass_id", "left_semi").select("pass_id", "file").distinct()


@query("""SELECT lang, count(*) AS records, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT source))[1:8], ',') AS topics, arg_max(doc_id, n_chars * 1000000 + doc_id) AS longest FROM documents GROUP BY lang""")
def catalogue_rollup(spark, d):
    rows = table(spark, d, "documents")
    return rows.groupBy("lang").agg(F.count("*").alias("records"), F.countDistinct("source").alias("sources"), F.concat_ws(",", F.slice(F.array_sort(F.collect_set("source")), 1, 8)).alias("topics"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("longest"))


@query("""SELECT source, count(*) AS total, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ready, min(CASE WHEN quality = 1 THEN doc_id END) AS first_ready, count(DISTINCT CASE WHEN quality = 1 THEN lang END) AS langs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def brief_rollup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    good = F.col("quality") == 1
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.sum(F.when(good, 1).otherwise(0)).alias("ready"), F.min(F.when(good, F.col("doc_id"))).alias("first_ready"), F.countDistinct(F.when(good, F.col("lang"))).alias("langs"))


@query("""SELECT conv_id, count(*) AS messages, count(DISTINCT role) AS speakers, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) + 1 AS next_ordinal, array_to_string(list(role ORDER BY turn, role, text), '>') AS order_of_roles FROM conversations GROUP BY conv_id""")
def conversation_rollup(spark, d):
    """Turns are counted by speaker first, so that a group holds small entries and no text."""
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    roles = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "n"))), lambda x: F.array_repeat(x["role"], x["n"].cast("int"))))
    return turns.groupBy("conv_id").agg(F.sum("n").alias("messages"), F.size(F.collect_set("role")).cast("long").alias("speakers"), F.sum("size").alias("chars"), (F.max("turn") + 1).alias("next_ordinal"), F.concat_ws(">", roles).alias("order_of_roles"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 2")
def common_versions(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(2)


@query("""SELECT user_id, count(*) AS open FROM events WHERE event_type <> 'purchase' GROUP BY user_id HAVING count(*) > 32""")
def queue_depth(spark, d):
    return table(spark, d, "events").where("event_type <> 'purchase'").groupBy("user_id").agg(F.count("*").alias("open")).where("open > 32")


@query("""SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_seen, count(DISTINCT l_returnflag) AS options, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'ambiguous' ELSE 'known' END AS state FROM lineitem GROUP BY l_partkey, l_suppkey""")
def receipt_groups(spark, d):
    kinds = F.countDistinct("l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("first_seen"), kinds.alias("options"), F.when(kinds > 1, "ambiguous").otherwise("known").alias("state"))


@query("""WITH c AS (SELECT sha256(text) AS h, doc_id, count(*) OVER (PARTITION BY sha256(text)) AS claims FROM documents) SELECT doc_id, claims FROM c WHERE claims > 1""")
def entity_claims(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("claims")).where("claims > 1")
    return rows.join(often, "h").select("doc_id", "claims")


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40), b AS (SELECT doc_id, 1000 + row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 40)
SELECT doc_id, min(r) AS "rank" FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""")
def ordered_union(spark, d):
    """Two ranked lists, the first one's ids ahead; an id keeps its first place."""
    docs = table(spark, d, "documents")
    a = docs.orderBy(F.desc("n_chars"), "doc_id").limit(40).select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))
    b = docs.where("lang = 'fr'").orderBy("doc_id").limit(40).select("doc_id", (1000 + F.row_number().over(Window.orderBy("doc_id"))).cast("long").alias("rank"))
    return a.unionByName(b).groupBy("doc_id").agg(F.min("rank").alias("rank"))


@query("SELECT o_orderkey, coalesce(c_custkey, 0) AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN o_totalprice > c_acctbal THEN 'stale' ELSE 'current' END AS state FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def stale_or_missing(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    state = F.when(F.col("c_custkey").isNull(), "missing").when(F.col("o_totalprice") > F.col("c_acctbal"), "stale").otherwise("current")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_custkey", F.lit(0)).alias("c_custkey"), state.alias("state"))


@query("""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS grp, conv_id || ':' || turn AS id, turn, length(text) AS size, left(text, 20) AS summary FROM conversations),
l AS (SELECT grp, summary, min(id) AS id FROM c WHERE summary IS NOT NULL GROUP BY grp, summary), m AS (SELECT grp, string_agg(id, ',' ORDER BY id) AS members FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY grp ORDER BY id) <= 3) GROUP BY grp)
SELECT c.grp, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, min(turn) AS first_at, max(turn) AS last_at, any_value(m.members) AS members FROM c LEFT JOIN m ON c.grp = m.grp GROUP BY c.grp""")
def incremental_view(spark, d):
    """A view of conversations, made from other rows first (some missing, some longer, some of another conversation) and brought up to date."""
    now = table(spark, d, "conversations").select(F.lit("put").alias("op"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("grp"), F.col("turn").cast("long").alias("at"), F.length("text").cast("long").alias("size"), F.left("text", F.lit(20)).alias("summary"))
    fate = F.crc32("id") % 10
    before = now.where(fate != 0).withColumns({"size": F.when(fate == 1, F.col("size") + 7).otherwise(F.col("size")), "grp": F.when(fate == 2, F.concat(F.lit("x"), "grp")).otherwise(F.col("grp"))})
    extra = now.where(fate == 3).withColumn("id", F.concat("id", F.lit("-old")))
    view = views.GroupView(spark, f"{shared_folder(spark).rstrip('/')}/view-{uuid.uuid4().hex}")
    view.apply(0, before.union(extra))
    view.apply(1, now.where(fate <= 2).union(extra.withColumn("op", F.lit("delete"))))
    return view.view().select("grp", "n", "size", "first_at", "last_at", F.array_join("members.id", ",").alias("members"))
