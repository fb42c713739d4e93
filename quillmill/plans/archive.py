"""Ingest, identity, write semantics, time and encoding, and the streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aliases, records
from ..operators import relational as R
from ..sources.tables import stored
from ..streaming import capture, ledger
from .registry import query, table


@query("""SELECT conv_id, count(*) AS n_messages, CASE WHEN bool_or(text IS NULL OR text = '') THEN 'empty_text' WHEN count(DISTINCT turn) <> count(turn) THEN 'duplicate_message_id' END AS error FROM conversations GROUP BY conv_id""")
def packet_validation(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"))
    return records.packet_checks(rows, "conv_id", "text", "message_id", "turn")


@query("SELECT conv_id, turn, sha256(text) AS text_sha, sha256(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || role) AS entity FROM conversations")
def revision_identity(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.sha2("text", 256).alias("text_sha"), F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role"), 256).alias("entity"))


@query("""WITH k AS (SELECT sha256(text) AS h, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY 1)
SELECT CASE WHEN conv_id * 1000 + turn = first THEN 'added' ELSE 'reused' END AS action, count(*) AS n FROM conversations JOIN k ON sha256(text) = h GROUP BY 1""")
def import_counters(spark, d):
    rows = table(spark, d, "conversations").select(F.sha2("text", 256).alias("h"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    first = rows.groupBy("h").agg(F.min("at").alias("first"))
    return rows.join(first, "h").groupBy(F.when(F.col("at") == F.col("first"), "added").otherwise("reused").alias("action")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_nationkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND (c_acctbal < 0 OR s_acctbal < 0 OR abs(c_acctbal - s_acctbal) < 10)""")
def compatible_pairs(spark, d):
    """Equal key and a residual test in which an unknown side agrees with anything."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return records.near_pairs(c, s, ("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal"), 10).select("c_custkey", "c_nationkey", "s_suppkey")


@query("""WITH o AS (SELECT doc_id, lang, source FROM documents WHERE lang = 'en'), n AS (SELECT doc_id, lang, 'new' AS source FROM documents WHERE source = 'src0')
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id)""")
def upsert_last_writer(spark, d):
    docs = table(spark, d, "documents")
    return R.upsert(docs.where("lang = 'en'").select("doc_id", "lang", "source"), docs.where("source = 'src0'").select("doc_id", "lang", F.lit("new").alias("source")), ["doc_id"])


@query("""WITH o AS (SELECT doc_id, lang, source FROM documents WHERE lang = 'en'), n AS (SELECT doc_id, lang, 'new' AS source FROM documents WHERE source = 'src0')
SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.doc_id = o.doc_id)""")
def insert_if_absent(spark, d):
    docs = table(spark, d, "documents")
    return R.insert_new(docs.where("lang = 'en'").select("doc_id", "lang", "source"), docs.where("source = 'src0'").select("doc_id", "lang", F.lit("new").alias("source")), ["doc_id"])


@query("SELECT d.doc_id, coalesce(CASE WHEN d.lang = 'en' THEN d.lang END, CASE WHEN l.toxic = 1 THEN 'held' ELSE 'open' END) AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en' OR l.doc_id IS NOT NULL")
def fill_unknown_fields(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    old = docs.join(labels.select("doc_id", F.lit(1).alias("k")), "doc_id", "left").where("lang = 'en' OR k = 1").select("doc_id", F.when(F.col("lang") == "en", F.col("lang")).alias("lang"))
    new = labels.select("doc_id", F.when(F.col("toxic") == 1, "held").otherwise("open").alias("lang"))
    return R.fill_unknown(old, new, ["doc_id"], ["lang"])


@query("SELECT doc_id, lang FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE length(text) > 60000)")
def delete_by_subquery(spark, d):
    docs = table(spark, d, "documents")
    return docs.join(docs.where(F.length("text") > 60000).select("source"), "source", "left_anti").select("doc_id", "lang")


@query("""SELECT user_id, event_type, count(*) AS writes, CASE WHEN count(DISTINCT props) > 1 THEN 'conflict' ELSE 'replay' END AS verdict FROM events GROUP BY user_id, event_type HAVING count(*) > 1""")
def write_once(spark, d):
    """A key written again with the same content is a replay, with other content a conflict."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("writes"), F.when(F.countDistinct("props") > 1, "conflict").otherwise("replay").alias("verdict")).where("writes > 1")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, CAST(least(3600, 600 * pow(2, least(event_id % 9, 6))) AS BIGINT) AS retry_s FROM events""")
def time_and_backoff(spark, d):
    t = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.unix_seconds(t).alias("seconds"), F.least(F.lit(3600), 600 * F.pow(F.lit(2), F.least(F.col("event_id") % 9, F.lit(6)))).cast("long").alias("retry_s"))


@query("""SELECT doc_id, replace(replace(rtrim(base64(encode('v1:' || CAST(doc_id AS VARCHAR) || ':' || source)), '='), '+', '-'), '/', '_') AS cursor, 'copy:' || substr(sha256('["copy","' || source || '"]'), 1, 20) AS group_key FROM documents""")
def cursors_and_keys(spark, d):
    raw = F.base64(F.concat_ws(":", F.lit("v1"), F.col("doc_id").cast("string"), "source").cast("binary"))
    key = F.concat(F.lit("copy:"), F.substring(F.sha2(F.to_json(F.array(F.lit("copy"), F.col("source"))), 256), 1, 20))
    return table(spark, d, "documents").select("doc_id", F.translate(F.rtrim(raw, F.lit("=")), "+/", "-_").alias("cursor"), key.alias("group_key"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text FROM events""")
def json_paths(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.k").alias("k_text"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name""")
def chained_left_joins(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("customers"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.countDistinct("s_suppkey").alias("suppliers"))
    out = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left")
    return out.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT event_id, user_id, coalesce(last_value(CASE event_type WHEN 'purchase' THEN true WHEN 'view' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS paused FROM events""")
def stream_privacy(spark, d):
    """The privacy state as a stream keeps it, which equals the batch window."""
    toggle = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "view", False)
    return capture.run_privacy(spark, f"{d}/events.parquet", "user_id", ["ts", "event_id"], toggle).select("event_id", "user_id", "paused")


@query(f"""SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN regexp_matches(text, '{X.PRIVACY_OFF.replace("'", "''")}') THEN true WHEN regexp_matches(text, '{X.PRIVACY_ON}') THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS paused FROM conversations""")
def stream_privacy_text(spark, d):
    """The same over texts, where the privacy switches themselves pause and lift."""
    return capture.run_privacy(spark, f"{d}/conversations.parquet", "conv_id", ["turn", "role", "text"], capture.privacy_toggle(F.col("text"))).select("conv_id", "turn", "role", "paused")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def stream_dedup(spark, d):
    """One row for each receipt (user, type), however often it is delivered."""
    return capture.run_to_end(spark, f"{d}/events.parquet", capture.receipt_stream, ["user_id", "event_type", "event_id"])


def _requests(events):
    """Views are searches that give the source k % 9, all other events read it; costs and capacities are taken from the row."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(F.col("user_id").alias("lookup"), F.col("event_id").alias("event"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "view").alias("search"), (k % 9).cast("string").alias("source"), F.ceil(F.col("value") * 8).cast("long").alias("cost"), (k * 20 + 300).cast("long").alias("capacity"))


@query("""WITH RECURSIVE e AS (SELECT event_id AS event, user_id AS lookup, epoch_ms(ts) AS at, event_type = 'view' AS search, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 9 AS VARCHAR) AS source,
    CAST(ceil(value * 8) AS BIGINT) AS cost, least(2000, greatest(512, CAST(json_extract_string(props, '$.k') AS INT) * 20 + 300)) AS capacity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT DISTINCT lookup, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS used, CAST(NULL AS BIGINT) AS opened, CAST(NULL AS BIGINT) AS room, CAST([] AS VARCHAR[]) AS sources FROM e
UNION ALL SELECT lookup, n, event, status, CASE WHEN status = 'admitted' THEN used + cost ELSE used END, opened, room, CASE WHEN status = 'admitted' AND search AND NOT list_contains(sources, source) THEN list_append(sources, source) ELSE sources END FROM
    (SELECT *, CASE WHEN opened IS NULL THEN 'unknown_lookup' WHEN NOT search AND NOT list_contains(sources, source) THEN 'outside_lookup' WHEN cost > room - used - 64 THEN 'over_budget' ELSE 'admitted' END AS status FROM
    (SELECT e.lookup, e.n, e.event, e.search, e.source, e.cost, CASE WHEN live THEN r.opened WHEN e.search THEN e.at END AS opened, CASE WHEN live THEN r.room WHEN e.search THEN e.capacity END AS room, CASE WHEN live THEN r.used WHEN e.search THEN 0 END AS used, CASE WHEN live THEN r.sources ELSE [] END AS sources
    FROM r JOIN e ON r.lookup = e.lookup AND e.n = r.n + 1, LATERAL (SELECT coalesce(e.at <= r.opened + 604800000, false) AS live) v)))
SELECT lookup, event, status, coalesce(used, 0) AS used FROM r WHERE n > 0""")
def stream_lookup_ledger(spark, d):
    """Admissions of requests to lookups with a capacity, sources and seven days to live, kept as keyed state with timers."""
    return ledger.run_ledger(spark, f"{d}/events.parquet", _requests).fillna(0, "used")


@query("""WITH o AS (SELECT json_extract_string(props, '$.k') || ':' || user_id AS source, max(ts) AS opened FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT source, strftime(opened, '%Y-%m-%d %H:%M:%S') AS opened FROM o WHERE o.opened >= (SELECT max(ts) FROM events WHERE event_type <> 'error') - INTERVAL 7 DAY ORDER BY o.opened DESC, source LIMIT 256""")
def retrieval_hints(spark, d):
    """The 256 sources opened last within seven days, from which background work begins."""
    opened = table(spark, d, "events").where("event_type <> 'error'").select(F.concat_ws(":", F.get_json_object("props", "$.k"), F.col("user_id").cast("string")).alias("source"), F.col("ts").alias("at"))
    return ledger.recent(opened).select("source", F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations),
q AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE turn IN (1, 2)),
f AS (SELECT q.conv_id, a.position AS k FROM q JOIN q r ON q.conv_id = r.conv_id AND q.position = 0 AND r.position = 1 JOIN c a ON a.conv_id = q.conv_id AND a.text = q.text AND a.role = q.role JOIN c b ON b.conv_id = a.conv_id AND b.position = a.position + 1 AND b.text = r.text AND b.role = r.role),
o AS (SELECT conv_id, min(k) AS k FROM f GROUP BY conv_id HAVING count(*) = 1)
SELECT q.conv_id, q.position, CASE WHEN o.k IS NULL THEN 'own' ELSE 'linked' END AS link, coalesce('m' || c.turn, '') AS message_id FROM q LEFT JOIN o ON q.conv_id = o.conv_id LEFT JOIN c ON c.conv_id = q.conv_id AND c.position = o.k + q.position""")
def late_identities(spark, d):
    """Anonymous excerpts (turns 1 and 2) that came first, and the packets with ids that come later: which message each turns out to be."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.lit("excerpt").alias("kind"), F.lit("me").alias("account_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.col("role").alias("speaker"), "text")

    def packet(rows, key, ids):
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
        own = F.concat(F.lit("m"), F.col("turn").cast("string")) if ids else F.lit(None).cast("string")
        return rows.select(F.concat(F.lit(key), "conversation_id").alias("packet_key"), place.alias("position"), "kind", "account_id", "conversation_id", own.alias("message_id"), "speaker", F.lit(None).cast("int").alias("source_order"), "text")

    first = aliases.late_identities(packet(turns.where("turn in (1, 2)"), "q", False))
    now = stored(aliases.arrived(first, packet(turns, "p", True)))
    ids = now.where("message_id is not null").select("entity_id", F.col("message_id").alias("found"))
    out = now.where("message_id is null").join(ids, "entity_id", "left")
    return out.select(F.col("conversation_id").cast("long").alias("conv_id"), F.col("position").cast("long").alias("position"), "link", F.coalesce("found", F.lit("")).alias("message_id"))


@query("""SELECT max(doc_id) AS doc_id, count(*) - 1 AS n_aliases FROM documents GROUP BY lang, source, n_chars""")
def alias_scan(spark, d):
    """Records without superseded ones (each stands for the one before it of its language, source and size), and how many each stands for."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    chained = docs.withColumn("canonical", F.lead("id").over(Window.partitionBy("lang", "source", "n_chars").orderBy("id")))
    known = stored(chained.where("canonical is not null").select("id", "canonical"))
    counts = aliases.canonical(known).groupBy(F.col("root").alias("doc_id")).agg(F.count("*").alias("n_aliases"))
    live = aliases.current(docs.select("id"), known)
    return live.withColumnRenamed("id", "doc_id").join(counts, "doc_id", "left").fillna(0, "n_aliases")
