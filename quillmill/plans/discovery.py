"""Claims, relevance, budgets and the final order of hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import discovery as D
from ..operators import lexical
from ..operators import relational as R
from .registry import query, table
from .search import _SCORED, QUERY

_Q = lambda p: p.replace("'", "''")
_KIND = "CASE turn % 4 WHEN 0 THEN 'decided' WHEN 1 THEN 'proposed' WHEN 2 THEN 'question' ELSE 'observed' END"
_LABEL = f"""CASE WHEN NOT (contains(text, '?') OR kind = 'question' OR regexp_matches(lower(text), '{_Q(D.QUALIFIED)}')) AND regexp_matches(lower(text), '{_Q(D.TESTED)}') THEN 'tested_as_reported'
WHEN NOT (contains(text, '?') OR kind = 'question' OR regexp_matches(lower(text), '{_Q(D.QUALIFIED)}')) AND regexp_matches(lower(text), '{_Q(D.CORRECTED)}') THEN 'corrected_as_reported'
WHEN NOT (contains(text, '?') OR kind = 'question' OR regexp_matches(lower(text), '{_Q(D.QUALIFIED)}')) AND regexp_matches(lower(text), '{_Q(D.SUPERSEDED)}') THEN 'superseded_as_reported'
WHEN kind = 'proposed' THEN 'proposed' ELSE 'unknown' END"""


def _claims(spark, d):
    turn = F.col("turn") % 4
    kind = F.when(turn == 0, "decided").when(turn == 1, "proposed").when(turn == 2, "question").otherwise("observed")
    return table(spark, d, "conversations").select("conv_id", "turn", "text", kind.alias("kind"))


@query(f"""WITH c AS (SELECT conv_id, turn, text, {_KIND} AS kind FROM conversations), l AS (SELECT *, {_LABEL} AS label FROM c)
SELECT conv_id, turn, label, CASE WHEN contains(text, '?') OR kind = 'question' OR regexp_matches(lower(text), '{_Q(D.UNREAL)}') THEN NULL
WHEN label IN ('tested_as_reported', 'corrected_as_reported', 'superseded_as_reported') OR regexp_matches(lower(text), '{_Q(D.RESULT)}') THEN 'result'
WHEN kind = 'decided' AND regexp_matches(lower(text), '{_Q(D.DECIDED)}') AND NOT regexp_matches(lower(text), '{_Q(D.NEGATED)}') THEN 'decision'
WHEN regexp_matches(lower(text), '{_Q(D.TRIED)}') OR kind = 'proposed' THEN 'attempt' WHEN regexp_matches(lower(text), '{_Q(D.TROUBLE)}') THEN 'problem' END AS role FROM l""")
def evidence_labels(spark, d):
    q, k = F.col("text"), F.col("kind")
    return _claims(spark, d).select("conv_id", "turn", D.evidence_label(q, k).alias("label"), D.outcome_role(q, k).alias("role"))


_TOK = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


@query(f"""WITH t AS (SELECT doc_id, {_TOK.format("substr(text, 1, 80)")} AS h, {_TOK.format("text")} AS b FROM documents)
SELECT doc_id, CASE WHEN list_has_all(h, ['tion', 'the']) THEN 'title' WHEN list_has_all(b, ['tion', 'the']) THEN 'body' END AS relevance FROM t""")
def artifact_relevance(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.tokens(F.substring("text", 1, 80)).alias("h"), X.tokens(F.col("text")).alias("b"))
    return rows.select("doc_id", D.artifact_relevance(["tion", "the"], F.col("h"), F.col("b")).alias("relevance"))


@query("""WITH n AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS h FROM part)
SELECT p_partkey, CAST(CASE WHEN len(list_filter(h, lambda x: starts_with(x, 'part') OR (length(x) >= 3 AND starts_with('part', x)))) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(h, lambda x: starts_with(x, '10') OR (length(x) >= 3 AND starts_with('10', x)))) > 0 THEN 1 ELSE 0 END AS BIGINT) AS score FROM n""")
def fuzzy_name_score(spark, d):
    words = F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z0-9]+)"), F.lit(1))
    return table(spark, d, "part").select("p_partkey", D.prefix_score(["part", "10"], words).alias("score"))


@query("""SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 400""")
def budget_prefix(spark, d):
    rows = D.within_budget(table(spark, d, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], F.octet_length("text"), 400)
    return rows.select("conv_id", "turn", "used")


@query("""WITH s AS (SELECT doc_id, string_split(text, '\n') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) <= 8 THEN array_to_string(l, '|') ELSE array_to_string(list_transform(range(0, 8), lambda i: l[CAST(floor(i * (len(l) - 1) / 7.0::DOUBLE + 0.5) AS BIGINT) + 1]), '|') END AS sample FROM s""")
def even_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(D.evenly_spaced(F.split("text", "\n", -1), 8), "|").alias("sample"))


@query(f"""WITH {_SCORED}, l AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS position FROM b WHERE most > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 100),
h AS (SELECT l.doc_id, position, CASE WHEN source = 'src0' THEN 1.25 WHEN source = 'src1' THEN 2.5 ELSE 0.0 END AS keyword, CASE WHEN lang = 'fr' THEN 2 ELSE 0 END AS preference, n_chars < 200 AS notice FROM l JOIN documents d ON l.doc_id = d.doc_id)
SELECT doc_id, row_number() OVER (ORDER BY notice, preference DESC, position - keyword, keyword DESC, position, doc_id) AS place FROM h""")
def discovery_order(spark, d):
    docs = table(spark, d, "documents")
    top = lexical.bm25(docs, QUERY).orderBy(F.desc("score"), "doc_id").limit(100)
    placed = top.select("doc_id", (F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1).alias("position"))
    bonus = F.when(F.col("source") == "src0", 1.25).when(F.col("source") == "src1", 2.5).otherwise(0.0)
    hits = docs.join(placed, "doc_id").select("doc_id", "position", bonus.alias("keyword"), F.when(F.col("lang") == "fr", 2).otherwise(0).alias("preference"), (F.col("n_chars") < 200).alias("notice"))
    return D.discovery_order(hits).select("doc_id", "place")


@query("""SELECT page_id, d.doc_id IS NULL AS missing, coalesce(contains(d.text, regexp_extract(html, '<title>(.*?)</title>', 1)), false) AS quoted FROM pages LEFT JOIN documents d ON d.doc_id = TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT)""")
def derived_validity(spark, d):
    """Whether a derived row's source is there, and whether its quote (here a page's title) still stands in it."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint").alias("of"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("quote"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pages.join(docs, F.col("of") == F.col("doc_id"), "left").select("page_id", F.col("doc_id").isNull().alias("missing"), F.coalesce(F.contains("text", "quote"), F.lit(False)).alias("quoted"))


@query("""SELECT user_id, strftime(max(ts), '%Y-%m-%d') AS last_opened FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 256""")
def priority_hints(spark, d):
    rows = table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("t"))
    return rows.orderBy(F.desc("t"), "user_id").limit(256).select("user_id", F.date_format("t", "yyyy-MM-dd").alias("last_opened"))


@query("""WITH a AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), dirty AS (SELECT DISTINCT conv_id FROM conversations WHERE length(text) > 400)
SELECT a.conv_id, n FROM a WHERE conv_id IN (SELECT conv_id FROM dirty)""")
def dirty_groups(spark, d):
    """Only groups that have changed are rolled up again."""
    rows = table(spark, d, "conversations")
    dirty = rows.where(F.length("text") > 400).select("conv_id")
    return rows.join(dirty, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT event_id, event_type, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY user_id % 5 = 0 DESC, value, event_id) AS position FROM events WHERE event_type <> 'error')
SELECT event_id, event_type, position FROM q ORDER BY user_id % 5 = 0 DESC, position, event_id LIMIT 100""")
def work_queue(spark, d):
    """Opened projects first, then turn by turn; rows in error wait."""
    opened = (F.col("user_id") % 5 == 0).cast("int")
    rows = table(spark, d, "events").where("event_type <> 'error'")
    turned = R.newest_per_key(rows, ["event_type"], [opened.desc(), F.col("value"), F.col("event_id")], 100, "position")  # what is later than that is in no page
    return turned.orderBy(opened.desc(), "position", "event_id").limit(100).select("event_id", "event_type", "position")


@query("""SELECT page_id, CASE WHEN contains(lower(html), '<article') THEN 'article' ELSE 'page' END AS kind, length(html) <= 4000 AND NOT regexp_matches(html, '(?i)<(?:form|iframe)') AS concise FROM pages""")
def source_kind(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.when(F.contains(F.lower(h), F.lit("<article")), "article").otherwise("page").alias("kind"), ((F.length(h) <= 4000) & ~h.rlike("(?i)<(?:form|iframe)")).alias("concise"))
