"""The queries of this subpackage: thin digests of what its operators return over whole tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, conversations, decontam, embed_dedup, html_extract, langid, license_scan, line_dedup, packing, pii, sharding, spelling
from .common import read, spread


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_classes(read(spark, sf_dir, "embeddings"))


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key that the session names; where it names none, one drawn for this run, which nobody can turn back."""
    key = spark.conf.get("spark.quillmill.pii.key", None) or secrets.token_hex(32)
    return pii.pseudonymize(spread(read(spark, sf_dir, "documents")), key)


def op3_suffix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spread(read(spark, sf_dir, "documents")))
    return out.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.concat_ws(",", "removed").alias("removed"))


def op4_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spread(read(spark, sf_dir, "pages")))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    return langid.identify(docs, langid.train(docs))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), shards=24)


def op7_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    return license_scan.scan_documents(docs, license_scan.train(docs))


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(spread(read(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spread(read(spark, sf_dir, "documents")), tokenizer_path())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(read(spark, sf_dir, "conversations"), damage=True)


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(read(spark, sf_dir, "documents")), tokenizer_path())


def op13_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spread(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op")} | {"pipeline": corpus_pipeline.run}


_OP1 = """
WITH RECURSIVE n AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.root = l.a),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON e.vec_id = c.vec_id LEFT JOIN k ON e.vec_id = k.a"""

_OP3 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, n, md5(trim(line)) AS h, len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS p FROM l WHERE trim(line) <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM k),
f AS (SELECT a.doc_id, a.p AS i, min(b.p) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p >= a.p WHERE b.s - a.s + a.w >= 50 GROUP BY a.doc_id, a.p
    UNION SELECT b.doc_id, max(a.p), b.p FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p >= a.p WHERE b.s - a.s + a.w >= 50 GROUP BY b.doc_id, b.p),
g AS (SELECT f.doc_id, f.i, f.j, min(c.n) AS begin, max(c.n) AS last, string_agg(c.h, ',' ORDER BY c.p) AS key FROM f JOIN c ON c.doc_id = f.doc_id AND c.p BETWEEN f.i AND f.j GROUP BY f.doc_id, f.i, f.j),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS copy FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(begin, last + 1)) AS n FROM o WHERE copy > 1),
t AS (SELECT l.doc_id, string_agg(CASE WHEN gone.n IS NULL THEN line END, chr(10) ORDER BY l.n) AS text, count(*) AS n_lines, count(gone.n) AS n_removed, string_agg(CAST(gone.n AS VARCHAR), ',' ORDER BY l.n) AS removed
    FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.n = gone.n GROUP BY l.doc_id)
SELECT d.doc_id, sha256(coalesce(t.text, '')) AS text_sha256, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(length(t.text), 0) END AS n_chars, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id"""

_OP8 = r"""
WITH d AS (SELECT doc_id, unnest(k) AS w, unnest(range(len(k))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS k FROM documents)),
b AS (SELECT item_id, len(k) AS n, least(len(k), 20) AS size, unnest(k) AS w, unnest(range(len(k))) AS q FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS k FROM benchmark) WHERE len(k) > 0),
m AS (SELECT doc_id, item_id, d.p - b.q AS diag, any_value(n) AS n, any_value(size) AS size, list(b.q) AS places FROM d JOIN b ON d.w = b.w GROUP BY doc_id, item_id, d.p - b.q HAVING count(*) >= 0.8 * any_value(size)),
s AS (SELECT doc_id, item_id, diag, n, size, len(places) AS n_matched, list_max(list_transform(range(0, n - size + 1), lambda k: len(list_filter(places, lambda x: x >= k AND x < k + size)))) AS best FROM m)
SELECT doc_id, item_id, n AS n_words, n_matched, best::DOUBLE / size AS overlap, diag AS word_start FROM s WHERE best >= 0.8 * size
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, best DESC, diag) = 1"""

_OP9 = r"""
WITH RECURSIVE k AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS k FROM documents),
w AS (SELECT doc_id, array_to_string(k[i:i + 4], ' ') AS s FROM k, LATERAL (SELECT unnest(range(1, greatest(len(k) - 3, 2))) AS i) WHERE len(k) > 0),
c AS (SELECT doc_id, s, count(*) AS n FROM w GROUP BY doc_id, s), z AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN z x ON a = x.doc_id JOIN z y ON b = y.doc_id WHERE shared >= 0.8 * (x.n + y.n - shared)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.root = l.a),
t AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id)
SELECT t.doc_id, class_id, t.doc_id = class_id AS kept, coalesce(z.n, 0) AS n_shingles FROM t LEFT JOIN z ON t.doc_id = z.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested otherwise."""
    return {"op1_pca_tiles": _OP1, "op3_suffix_lines": _OP3, "op8_spaced_seeds": _OP8, "op9_bagminhash": _OP9}
