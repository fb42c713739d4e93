"""Evidence access, timelines, privacy state and text derivations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import text as X
from ..operators import relational as R
from .registry import query, table

_TS = "epoch_us(ts)"


def _turns(spark, d):
    return R.position(table(spark, d, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")])


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position FROM conversations")
def timeline_position(spark, d):
    return _turns(spark, d).select("conv_id", "turn", "role", "position")


@query("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS position FROM conversations)
SELECT p.conv_id, p.turn, p.position, a.position AS anchor FROM p JOIN p a ON p.conv_id = a.conv_id AND p.position BETWEEN a.position - 1 AND a.position + 1""")
def timeline_band(spark, d):
    rows = _turns(spark, d)
    return R.neighbours(rows, rows, ["conv_id"], 1, 1).select("conv_id", "turn", "position", "anchor")


@query("""SELECT conv_id, turn, lag(role) OVER w AS before_role, lead(role) OVER w AS after_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def timeline_neighbors(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before_role"), F.lead("role").over(w).alias("after_role"))


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, d):
    return R.keyset_page(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100, 50)


_H48 = "CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT)"


@query(f"SELECT count(*) AS n, bit_xor({_H48}) AS digest, CAST(sum({_H48}) AS VARCHAR) AS total FROM documents")
def membership_fingerprint(spark, d):
    return R.membership_fingerprint(table(spark, d, "documents"), "doc_id")


@query("SELECT doc_id, sha256(text) AS revision, substr(text, 11, 40) AS slice, substr(sha256(sha256(text) || ':10:50'), 1, 20) AS match_id, length(text) > 50 AS more FROM documents")
def text_revision(spark, d):
    t = F.col("text")
    key = F.substring(F.sha2(F.concat(X.revision(t), F.lit(":10:50")), 256), 1, 20)
    return table(spark, d, "documents").select("doc_id", X.revision(t).alias("revision"), F.substring(t, 11, 40).alias("slice"), key.alias("match_id"), (F.length(t) > 50).alias("more"))


_EVENT_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"
_TOGGLE = "CASE event_type WHEN 'purchase' THEN true WHEN 'view' THEN false END"


def _state(spark, d):
    toggle = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "view", False)
    return R.carried_state(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], toggle)


@query(f"SELECT event_id, user_id, coalesce(last_value({_TOGGLE} IGNORE NULLS) OVER ({_EVENT_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS paused FROM events")
def privacy_state(spark, d):
    return _state(spark, d).select("event_id", "user_id", "paused")


@query(f"""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN lag(event_type) OVER ({_EVENT_ORDER}) IS NULL OR lag(event_type) OVER ({_EVENT_ORDER}) <> event_type THEN 1 ELSE 0 END AS starts FROM events)
SELECT event_id, user_id, CAST(sum(starts) OVER ({_EVENT_ORDER}) AS BIGINT) AS island FROM s""")
def batch_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    starts = F.coalesce(F.lag("event_type").over(w) != F.col("event_type"), F.lit(True))
    rows = table(spark, d, "events").withColumn("starts", starts)
    return R.islands(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("starts")).select("event_id", "user_id", "island")


@query("""SELECT event_id, props IS NOT NULL AND json_valid(props) AS sound, json_type(props) AS kind FROM events""")
def capture_event_filter(spark, d):
    parsed = F.try_parse_json("props")
    kind = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), "OBJECT").otherwise("OTHER")
    return table(spark, d, "events").select("event_id", parsed.isNotNull().alias("sound"), F.when(parsed.isNotNull(), kind).alias("kind"))


_SECRET_SQL = X.SECRET.replace("'", "''")


@query(f"SELECT doc_id, regexp_replace(text, '{_SECRET_SQL}', '[redacted]', 'g') AS text FROM documents WHERE regexp_matches(text, '{_SECRET_SQL}')")
def secret_scrub(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(X.SECRET)).select("doc_id", X.scrub(F.col("text")).alias("text"))


@query(f"SELECT CASE WHEN regexp_matches(text, '{_SECRET_SQL}') THEN 'secret' WHEN length(text) < 40 THEN 'short' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def reason_counts(spark, d):
    reason = F.when(F.col("text").rlike(X.SECRET), "secret").when(F.length("text") < 40, "short").otherwise("ok")
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT role, regexp_matches(text, '(?is)^\\s*(?:/memory\\s+off\\b|(?:please\\s+)?(?:do not|don''t)\\s+(?:save|record|remember|archive)\\s+(?:this|anything|the following)\\b|off the record\\b)') AS off, count(*) AS n FROM conversations GROUP BY ALL""")
def privacy_switches(spark, d):
    return table(spark, d, "conversations").groupBy("role", F.col("text").rlike(X.PRIVACY_OFF).alias("off")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN contains(lower(source || ' ' || text), 'license') THEN 'licensing' WHEN contains(lower(source || ' ' || text), 'password') THEN 'security' ELSE 'general' END AS project FROM documents""")
def project_classifier(spark, d):
    from ..operators.records import project_of

    return table(spark, d, "documents").select("doc_id", project_of(F.concat_ws(" ", "source", "text"), {"licensing": ["license"], "security": ["password"]}).alias("project"))


@query("""WITH c AS (SELECT CASE WHEN contains(lower(source || ' ' || text), 'license') THEN 'licensing' WHEN contains(lower(source || ' ' || text), 'password') THEN 'security' ELSE 'general' END AS project FROM documents) SELECT project, count(*) AS n FROM c GROUP BY project""")
def project_counts(spark, d):
    return project_classifier(spark, d).groupBy("project").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages""")
def titled_sources(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.substring_index("url", "/", -1).alias("name"))


@query("""WITH s AS (SELECT source, regexp_replace(left(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), 60), '^-+|-+$', '', 'g') AS s FROM documents) SELECT DISTINCT source, CASE WHEN s = '' THEN 'general' ELSE s END AS slug FROM s""")
def slugs(spark, d):
    return table(spark, d, "documents").select("source", X.slug(F.col("source")).alias("slug")).distinct()


@query()
def chunk_text(spark, d):
    """Overlapping windows of at most 1200 UTF-8 bytes; a test checks every slice."""
    return chunking.chunks(table(spark, d, "documents"), "doc_id")


@query("SELECT doc_id, sha256(text) AS revision, CAST(length(text) AS BIGINT) AS covered FROM documents WHERE length(trim(text)) > 0")
def chunk_exactness(spark, d):
    """Every chunk equals its slice of the text, and the chunks of a text reach from its start to its end without a gap."""
    docs = table(spark, d, "documents")
    parts = chunking.chunks(docs, "doc_id")
    w = Window.partitionBy("doc_id").orderBy("part")
    spans = parts.withColumn("reach", F.coalesce(F.lag("end").over(w), F.lit(0)))
    whole = spans.groupBy("doc_id").agg(F.min("start").alias("low"), F.max("end").alias("covered"), F.max(F.col("start") - F.col("reach")).alias("gap"), F.collect_list(F.struct("start", "end", "body")).alias("all"))
    exact = F.forall("all", lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]) == x["body"])
    return docs.join(whole, "doc_id").where("low = 0 AND gap <= 0").where(exact).select("doc_id", X.revision(F.col("text")).alias("revision"), F.col("covered").cast("long").alias("covered"))


@query("SELECT doc_id, sha256(text) AS revision FROM documents WHERE length(text) > 0")
def source_blocks(spark, d):
    """The gap-free blocks of a text, joined in order, give the text again."""
    parts = chunking.blocks(table(spark, d, "documents"), "doc_id")
    again = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "body"))), lambda x: x["body"]), "")
    return parts.groupBy("doc_id").agg(F.sha2(again, 256).alias("revision"))
