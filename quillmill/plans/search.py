"""Search queries: terms, BM25, phrases, tiers, cosine and fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import passages
from ..functions import text as X
from ..operators import answers, block_index, lexical, relational, vector
from ..sources.tables import shared_folder
from .registry import query, table

QUERY = "tell me about the thonre erst tion que les der"
_TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
_TERMS = "['thonre', 'erst', 'tion', 'que', 'les', 'der']"
_SCORED = f"""
t AS (SELECT doc_id, {_TOKENS} AS k FROM documents),
c AS (SELECT doc_id, len(k) AS dl, list_transform({_TERMS}, lambda w: len(list_filter(k, lambda x: x = w))) AS tf FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS a FROM c),
i AS (SELECT pos, greatest(ln(((SELECT n FROM s) - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM (SELECT pos, sum(CASE WHEN tf[pos] > 0 THEN 1 ELSE 0 END) AS df FROM c, range(1, 7) r(pos) GROUP BY pos)),
b AS (SELECT doc_id, min(tf[pos]) AS least, max(tf[pos]) AS most, sum(idf * tf[pos] * 2.2 / (tf[pos] + 1.2 * (0.25 + 0.75 * dl / (SELECT a FROM s)))) AS score FROM c, i GROUP BY doc_id)"""
_QUERY_VECTOR = [round(((i * 37) % 64 - 31.5) / 32, 6) for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _QUERY_VECTOR) + "]"
_COSINE = f"round(greatest(-1.0, least(1.0, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({_VECTOR_SQL})[i])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({_VECTOR_SQL}, lambda x: x * x)))))), 6)"


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM b WHERE most > 0")
def bm25_or(spark, d):
    return lexical.bm25(table(spark, d, "documents"), QUERY)


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM b WHERE least > 0")
def bm25_and(spark, d):
    return lexical.bm25(table(spark, d, "documents"), QUERY, every=True)


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM b WHERE most > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_top_20(spark, d):
    return lexical.bm25(table(spark, d, "documents"), QUERY).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score, least > 0 AS whole FROM b WHERE most > 0")
def bm25_postings(spark, d):
    """The same scores from a postings table that is built first."""
    at = f"{shared_folder(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    return lexical.Postings.build(table(spark, d, "documents"), at).scored(QUERY)


@query(f"""WITH t AS (SELECT doc_id, ' ' || array_to_string({_TOKENS}, '  ') || ' ' AS k FROM documents)
SELECT doc_id, CAST((len(k) - len(replace(k, ' of  the ', ''))) / len(' of  the ') AS BIGINT) AS n FROM t WHERE k LIKE '% of  the %'""")
def phrase_match(spark, d):
    return lexical.phrase(table(spark, d, "documents"), ["of", "the"])


@query(f"""WITH {_SCORED}, f AS (SELECT doc_id, CASE WHEN least > 0 THEN 2 ELSE 3 END AS tier, round(score, 6) AS score FROM b WHERE most > 0)
SELECT doc_id, CAST(tier AS BIGINT) AS tier, score FROM f ORDER BY tier, score DESC, doc_id LIMIT 50""")
def tiered_search(spark, d):
    return lexical.tiered(table(spark, d, "documents"), QUERY, 50)


@query("SELECT doc_id, text, source FROM documents WHERE doc_id = 7")
def exact_id_lookup(spark, d):
    return table(spark, d, "documents").where("doc_id = 7").select("doc_id", "text", "source")


@query("SELECT d.doc_id, sha256(d.text) AS revision FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1")
def hydrate_candidates(spark, d):
    wanted = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").join(wanted, "doc_id", "left_semi").select("doc_id", X.revision(F.col("text")).alias("revision"))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS)) + "]"


@query(rf"""WITH k AS (SELECT item_id, regexp_extract_all(strip_accents(lower(substr(trim(text), 1, 2048))), '[\p{{L}}\p{{N}}]+') AS k FROM benchmark),
u AS (SELECT item_id, w, min(p) AS p FROM (SELECT item_id, unnest(k) AS w, generate_subscripts(k, 1) AS p FROM k) WHERE NOT list_contains({_STOP}, w) GROUP BY item_id, w)
SELECT item_id, array_to_string(list(w ORDER BY p)[1:32], ' ') AS terms FROM u GROUP BY item_id""")
def query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", X.query_terms(F.col("text"))).alias("terms"))


@query(f"SELECT vec_id, {_COSINE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return vector.top_k(table(spark, d, "embeddings"), _QUERY_VECTOR, 10)


@query(f"WITH s AS (SELECT label, vec_id, {_COSINE} AS score FROM embeddings) SELECT label, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1")
def cosine_best_per_group(spark, d):
    return vector.best_per_group(table(spark, d, "embeddings"), _QUERY_VECTOR, "label")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def vector_norms(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vector.norm(e), 6).alias("norm"), F.round(vector.unit(e)[0], 6).alias("first"))


@query(f"""WITH {_SCORED}, l AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS r FROM (SELECT * FROM b WHERE most > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 100)),
v AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT vec_id AS doc_id, {_COSINE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 100)),
p AS (SELECT doc_id, 1.0::DOUBLE / (40 + r) AS part FROM l UNION ALL SELECT doc_id, 0.7::DOUBLE / (40 + r) FROM v)
SELECT doc_id, round(sum(part), 9) AS score FROM p GROUP BY doc_id""")
def hybrid_fusion(spark, d):
    words = lexical.bm25(table(spark, d, "documents"), QUERY).orderBy(F.desc("score"), "doc_id").limit(100)
    vectors = vector.top_k(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _QUERY_VECTOR, 100, "doc_id")
    return vector.fuse([(words, 1.0), (vectors, 0.7)], "doc_id")


_SUBJECT = ["thonre", "erst", "tion"]


@query(f"""WITH t AS (SELECT doc_id, list_distinct({_TOKENS}) AS b, list_distinct(regexp_extract_all(strip_accents(lower(substr(text, 1, 80))), '[\\p{{L}}\\p{{N}}]+')) AS h FROM documents),
m AS (SELECT doc_id, len(list_filter(['thonre', 'erst', 'tion'], lambda w: list_contains(b, w))) AS n, len(list_filter(['thonre', 'erst', 'tion'], lambda w: list_contains(h, w))) > 0 AS titled FROM t)
SELECT doc_id, CAST(CASE WHEN n < 2 THEN 0.0 WHEN n = 3 THEN CASE WHEN titled THEN 2.75 ELSE 2.5 END ELSE least(2.0, 0.5 + 1.25 * n / 3 + CASE WHEN titled THEN 0.25 ELSE 0.0 END) END AS DOUBLE) AS preference FROM m""")
def keyword_preference(spark, d):
    """How much of the subject a record covers, with a bonus for its title (here the first 80 characters)."""
    subject = F.array(*map(F.lit, _SUBJECT))
    rows = table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("b"), X.tokens(F.substring("text", 1, 80)).alias("h"))
    n, titled = F.size(F.array_intersect(subject, "b")), F.size(F.array_intersect(subject, "h")) > 0
    part = F.least(F.lit(2.0), 0.5 + 1.25 * n / len(_SUBJECT) + F.when(titled, 0.25).otherwise(0.0))
    value = F.when(n < 2, 0.0).when(n == len(_SUBJECT), F.when(titled, 2.75).otherwise(2.5)).otherwise(part)
    return rows.select("doc_id", value.cast("double").alias("preference"))


@query("""WITH s AS (SELECT sha256(text) AS h, doc_id, source, n_chars FROM documents)
SELECT h AS copy_key, min(doc_id) AS representative, count(*) AS matches, count(DISTINCT source) AS sources FROM s WHERE n_chars >= 80 GROUP BY h""")
def copy_groups(spark, d):
    rows = table(spark, d, "documents").where("n_chars >= 80").select(X.revision(F.col("text")).alias("copy_key"), "doc_id", "source")
    return rows.groupBy("copy_key").agg(F.min("doc_id").alias("representative"), F.count("*").alias("matches"), F.countDistinct("source").alias("sources"))


@query("""SELECT doc_id, substr(text, 1, 80) AS title, substr(source, 1, 100) AS source, substr(text, 1, 120) AS preview, length(text) > 120 AS truncated,
CASE WHEN length(text) > 240 THEN substr(text, 1, 239) || '…' ELSE text END AS bounded, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents""")
def preview_projection(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.substring(t, 1, 80).alias("title"), F.substring("source", 1, 100).alias("source"), F.substring(t, 1, 120).alias("preview"), (F.length(t) > 120).alias("truncated"), X.bounded(t, 240).alias("bounded"), F.octet_length(t).cast("long").alias("n_bytes"))


@query("""WITH m AS (SELECT doc_id, text, strpos(text, 'tion') AS p FROM documents WHERE contains(text, 'tion')), a AS (SELECT doc_id, text, greatest(1, p - 200) AS p FROM m)
SELECT doc_id, CASE WHEN p > 1 THEN '…' ELSE '' END || substr(text, p, 600) || CASE WHEN length(text) >= p + 600 THEN '…' ELSE '' END AS excerpt FROM a""")
def excerpts(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").contains("tion"))
    return rows.select("doc_id", X.excerpt(F.col("text"), "tion").alias("excerpt"))


@query(r"SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, CAST(len(list_distinct(k)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS k FROM documents)")
def token_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"))


@query("""SELECT doc_id, text, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50""")
def ranked_offset_page(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").offset(50).limit(25).select("doc_id", "text", "source")


@query("""WITH s AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT event_type, event_id, r AS position FROM s WHERE r <= 3""")
def diverse_top(spark, d):
    rows = relational.position(table(spark, d, "events"), ["event_type"], [F.desc("value"), F.col("event_id")])
    return rows.where("position <= 3").select("event_type", "event_id", "position")


def _scored_sql(name: str, where: str) -> str:
    """Common tables that score all of a record (text, source and title) among the records that `where` keeps."""
    return f"""
t{name} AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text || chr(10) || source || chr(10) || substr(text, 1, 80))), '[\\p{{L}}\\p{{N}}]+') AS k FROM documents WHERE {where}),
c{name} AS (SELECT doc_id, len(k) AS dl, list_transform({_TERMS}, lambda w: len(list_filter(k, lambda x: x = w))) AS tf FROM t{name}),
s{name} AS (SELECT count(*) AS n, avg(dl) AS a FROM c{name}),
i{name} AS (SELECT pos, greatest(ln(((SELECT n FROM s{name}) - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM (SELECT pos, sum(CASE WHEN tf[pos] > 0 THEN 1 ELSE 0 END) AS df FROM c{name}, range(1, 7) r(pos) GROUP BY pos)),
b{name} AS (SELECT doc_id, min(tf[pos]) AS least, max(tf[pos]) AS most, round(sum(idf * tf[pos] * 2.2 / (tf[pos] + 1.2 * (0.25 + 0.75 * dl / (SELECT a FROM s{name})))), 6) AS score FROM c{name}, i{name} GROUP BY doc_id)"""


def _held(of: str) -> str:
    return f"list_filter({_TERMS}, lambda w: list_contains({of}, w))"


@query(f"""WITH {_scored_sql("1", "true")}, {_scored_sql("2", "source = 'src0'")},
h AS (SELECT doc_id, 0 AS channel, CASE WHEN least > 0 THEN 2 ELSE 3 END AS tier, score FROM b1 WHERE most > 0 ORDER BY tier, score DESC, doc_id LIMIT 100),
m AS (SELECT doc_id, 1 AS channel, 0 AS tier, score FROM b2 WHERE most > 0 ORDER BY score DESC, doc_id LIMIT 40),
u AS (SELECT * FROM (SELECT * FROM h UNION ALL SELECT * FROM m) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY channel) = 1),
p AS (SELECT doc_id, row_number() OVER (ORDER BY channel, tier, score DESC, doc_id) - 1 AS position FROM u),
d AS (SELECT p.doc_id, position, text, source, lang, {_TOKENS} AS b, regexp_extract_all(strip_accents(lower(substr(text, 1, 80))), '[\\p{{L}}\\p{{N}}]+') AS t FROM p JOIN documents USING (doc_id)),
f AS (SELECT *, len({_held("list_concat(b, t)")}) AS n, len({_held("t")}) AS nt, len({_held("b")}) AS nb FROM d),
g AS (SELECT *, CASE WHEN source = 'src0' AND (nt = 6 OR nb = 6) THEN 1 ELSE 0 END AS preference, CAST(CASE WHEN n < 2 THEN 0.0 WHEN n = 6 THEN CASE WHEN nt > 0 THEN 2.75 ELSE 2.5 END ELSE least(2.0, 0.5 + 1.25 * n / 6 + CASE WHEN nt > 0 THEN 0.25 ELSE 0.0 END) END AS DOUBLE) AS keyword FROM f),
o AS (SELECT *, row_number() OVER (ORDER BY preference DESC, position - keyword, keyword DESC, position, doc_id) AS place, sha256(text) || CASE WHEN length(text) >= 80 THEN '' WHEN source = 'src1' THEN lang ELSE CAST(doc_id AS VARCHAR) END AS k FROM g),
r AS (SELECT doc_id, CASE source WHEN 'src0' THEN 'note' WHEN 'src1' THEN 'chat' ELSE 'memory' END AS source_kind, place, count(*) OVER w AS matches, count(DISTINCT CASE WHEN source = 'src1' THEN lang END) OVER w AS chats, row_number() OVER (PARTITION BY k ORDER BY place) AS r FROM o WINDOW w AS (PARTITION BY k))
SELECT doc_id, source_kind, place, matches, chats FROM r WHERE r = 1 ORDER BY place LIMIT 20""")
def grouped_search(spark, d):
    """A search as users call it: tiers, notes, preferences, copies in groups."""
    kind = F.when(F.col("source") == "src0", "note").when(F.col("source") == "src1", "excerpt")
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 80).alias("title"), "source", kind.alias("kind"), F.when(kind == "excerpt", F.col("lang")).alias("conversation_id"))
    return answers.search(docs, QUERY, 20, "doc_id").select("doc_id", "source_kind", "place", "matches", "chats")


@query("SELECT doc_id, substr(text, 1, coalesce(list_max(list_filter(range(1, 65), lambda i: i <= length(text) AND strlen(CAST(to_json(substr(text, 1, i)) AS VARCHAR)) <= 40)), 1)) AS short FROM documents")
def short_texts(spark, d):
    """Beginnings that surely fit into so many tokens."""
    return table(spark, d, "documents").select("doc_id", X.short_text(F.col("text"), 40).alias("short"))


def _line_blocks(records):
    """(id, block_id, start, end, body): each line that is not blank."""
    lines = records.select("id", F.posexplode(F.split("text", "\n", -1)).alias("n", "body")).where("trim(body) <> ''")
    return lines.select("id", F.col("n").cast("string").alias("block_id"), F.col("n").alias("start"), (F.col("n") + 1).alias("end"), "body")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, n, {_TOKENS.replace("text", "line")} AS t FROM l WHERE trim(line) <> ''),
s AS (SELECT doc_id, count(*) AS blocks, avg(len(t)) AS mean FROM k GROUP BY doc_id),
w AS (SELECT doc_id, n, len(t) AS dl, x.w AS w, len(list_filter(t, lambda y: y = x.w)) AS tf FROM k, (SELECT unnest({_TERMS}) AS w) x),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS df FROM w WHERE tf > 0),
b AS (SELECT doc_id, n, round(sum(greatest(ln((blocks - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 12) AS score FROM f JOIN s USING (doc_id) GROUP BY doc_id, n)
SELECT doc_id, CAST(n AS BIGINT) AS line, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) AS place FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) <= 2""")
def best_blocks(spark, d):
    """The two best blocks of each record from an index that was built for earlier texts and brought up to date."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    index = block_index.BlockIndex(spark, f"{shared_folder(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}")
    index.update(docs.withColumn("text", F.when(F.crc32("id") % 4 == 0, F.concat(F.lit("les les "), "text")).otherwise(F.col("text"))), blocks=_line_blocks)
    index.update(docs, blocks=_line_blocks)
    return index.best(QUERY).select(F.col("id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("line"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("""WITH v AS (SELECT vec_id, vec_id // 4 AS record, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query, v.record, v.vec_id AS vec, round(greatest(-1.0, least(1.0, list_dot_product(q.e, v.e) / (q.size * v.size))), 6) AS score FROM v AS q JOIN v ON len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
b AS (SELECT * FROM s WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY query, record ORDER BY score DESC, vec) = 1)
SELECT query, record, vec, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, record) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, record) <= 10""")
def search_many(spark, d):
    """Every twentieth vector as a query against all: the ten records (of four vectors each) with the best vector, from the floor on."""
    rows = table(spark, d, "embeddings").withColumn("record", F.floor(F.col("vec_id") / 4).cast("long"))
    queries = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return vector.search_many(rows, queries, 10, "record").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS k FROM documents), h AS (SELECT doc_id, k, unnest(list_filter(range(1, len(k) + 1), lambda i: list_contains({_TERMS}, k[i]))) AS p FROM t),
w AS (SELECT doc_id, p, len(k) AS n, list_filter(k[p:p + 63], lambda x: list_contains({_TERMS}, x)) AS found FROM h)
SELECT doc_id, greatest(0, least(p - 1, n - 64)) AS token, len(list_distinct(found)) AS n_terms, len(found) AS n_hits FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(list_distinct(found)) DESC, len(found) DESC, p) = 1""")
def snippet_windows(spark, d):
    """The 64 words of each text that hold most of the query's terms."""
    return passages.snippets(table(spark, d, "documents"), QUERY).drop("snippet")
