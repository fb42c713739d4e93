"""From hits to an answer: source kinds, preferences, notices, copies in groups, and a budget.

A search hands over a bounded list of candidates (at most `CANDIDATES` of words and as many saved notes), so the windows
without a key below see a few hundred rows at most. Records are rows (id, text, title, source, kind, account_id,
conversation_id, canonical_id, saved); columns that are missing count as unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import discovery, lexical

CANDIDATES, SAVED = 100, 40
_OPTIONAL = {"kind": "string", "account_id": "string", "conversation_id": "string", "canonical_id": "string", "saved": "boolean"}
# What a title of a versioned document looks like, and the file name of a save request.
DOCUMENT_TITLE = r"(?i)^Handoff\s*\|\s*([^|]+?)\s*\|\s*(v[1-9][0-9]*)\s*$"
REQUEST_FILE = r"(?i)^plugin-([0-9a-f]{64})\.json$"
#: More documents of one title word than this make the answer unsure, so none is given.
FEW = 128


def complete(records: DataFrame, id_col: str = "id") -> DataFrame:
    """The records with all columns that the steps look at."""
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in records.columns}
    rows = records.withColumns(missing)
    return rows.withColumns({"canonical_id": F.coalesce(F.col("canonical_id"), F.col(id_col).cast("string")), "saved": F.coalesce("saved", F.lit(False))})


def candidates(records: DataFrame, query: str, id_col: str = "id", text_col: str = "text", title_col: str = "title") -> DataFrame:
    """(id, position, score) of the best hits by tier, then of saved notes that hold a term and are not among them."""
    rows = complete(records, id_col).withColumn("__all", F.concat_ws("\n", text_col, "source", title_col))
    hits = lexical.tiered(rows, query, CANDIDATES, id_col, "__all", title_col)
    notes = lexical.bm25(rows.where("saved OR kind = 'note'"), query, id_col, "__all").orderBy(F.desc("score"), id_col).limit(SAVED)
    both = hits.select(id_col, F.lit(0).alias("channel"), "tier", "score").unionByName(notes.select(id_col, F.lit(1).alias("channel"), F.lit(0).cast("long").alias("tier"), "score"))
    first = both.groupBy(id_col).agg(F.min(F.struct("channel", "tier", -F.col("score"))).alias("best"), F.max_by("score", -F.col("channel")).alias("score"))
    return first.select(id_col, (F.row_number().over(Window.orderBy("best", id_col)) - 1).alias("position"), "score")


def source_kind(kind: Column, saved: Column, document: Column, notice: Column) -> Column:
    """What a hit is: a verified document, a saved note, a note, a chat, a notice of the interface, a summary or a memory."""
    return (
        F.when(document, "saved_handoff").when(saved & ((kind == "note") | kind.isNull()), "saved_note").when(kind == "note", "note")
        .when((kind == "excerpt") & notice, "navigation_notice").when(kind == "excerpt", "chat").when(kind == "summary", "summary").otherwise("memory")
    )


def ranked(hits: DataFrame, query: str, id_col: str = "id", text_col: str = "text", title_col: str = "title") -> DataFrame:
    """The hits (records with `position`) with source_kind, preference, keyword, notice, group_key and their final place.

    Where the hits have `document_name` and `document_version` (null for what is no document), chats that only point to one
    of the preferred documents make one group for each document and account, however they are worded (`pointed_at`).
    """
    rows = complete(hits, id_col)
    if "document" not in rows.columns:
        rows = rows.withColumn("document", F.lit(False))
    text, title = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(title_col), F.lit(""))
    rows = rows.withColumns({"__b": X.tokens(text), "__t": X.tokens(title), "__n": discovery.navigation_notice(text), "revision": X.revision(text)})
    kind = source_kind(F.col("kind"), F.col("saved"), F.col("document"), F.col("__n").isNotNull())
    rows = rows.withColumn("source_kind", F.coalesce(kind, F.lit("memory")))
    subject = discovery.subject_of(query)
    relevance = discovery.artifact_relevance(subject, F.col("__t"), F.col("__b")) if subject else F.lit(None).cast("string")
    worth = F.when(F.col("source_kind") == "saved_handoff", 3).when(F.col("source_kind") == "saved_note", 2).when(F.col("source_kind") == "note", 1).otherwise(0)
    notice = F.col("source_kind") == "navigation_notice"
    same_place = F.when(F.length(text) < 80, F.coalesce(F.concat_ws("|", F.coalesce("account_id", F.lit("")), "conversation_id"), F.col(id_col).cast("string")) if "conversation_id" in rows.columns else F.col(id_col).cast("string")).otherwise("")
    key = F.when(notice, F.concat_ws("|", F.lit("notice"), F.col("__n.event"), F.concat_ws(" ", X.tokens(F.col("__n.subject"))), F.coalesce("account_id", F.lit("")))).otherwise(F.concat_ws("|", F.lit("copy"), "revision", same_place))
    marked = rows.withColumns({"relevance": relevance, "preference": F.when(relevance.isNotNull(), worth).otherwise(0), "keyword": discovery.keyword_preference(query, F.col("__t"), F.col("__b")), "notice": notice, "named": F.col(id_col).cast("string") == query.strip(), "group_key": key})
    marked = marked.withColumn("pointed_at", F.lit(None).cast("string"))
    if "document_name" in rows.columns:
        entry = F.struct(F.col("document_name").alias("name"), X.tokens(F.col("document_name")).alias("tokens"), F.col("document_version").alias("version"))
        known = marked.agg(F.collect_set(F.when(F.col("document") & (F.col("preference") > 0), entry)).alias("__documents"))
        marked = marked.drop("pointed_at").join(F.broadcast(known))  # one row, of the hits' documents
        at = F.when(F.col("source_kind") == "chat", discovery.pointed_at(text, F.col("__b"), F.col("__documents")))
        mention = F.concat_ws("|", F.lit("mentions"), at["name"], F.concat_ws(",", at["versions"]), F.coalesce("account_id", F.lit("")))
        marked = marked.withColumn("pointed_at", at["name"]).withColumn("group_key", F.when(F.col("pointed_at").isNotNull(), mention).otherwise(F.col("group_key"))).drop("__documents")
    return discovery.discovery_order(marked, id_col).drop("__b", "__t", "__n")


def grouped(placed: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """The first `limit` groups in the order of places: one row for each, with `matches` and `chats`.

    A record that another one stands for (same canonical id, same text) is no match of its own; the query's own id is a
    group by itself.
    """
    once = placed.withColumn("__k", F.row_number().over(Window.partitionBy("canonical_id", "revision").orderBy("place"))).where("__k = 1")
    key = F.when(F.col("named"), F.concat(F.lit("id|"), F.col(id_col).cast("string"))).otherwise(F.col("group_key"))
    of = Window.partitionBy("__g").orderBy("place")
    chat = F.when(F.col("conversation_id").isNotNull(), F.struct(F.coalesce("account_id", F.lit("")), "conversation_id"))
    counts = once.withColumn("__g", key).withColumns({"__r": F.row_number().over(of), "matches": F.count("*").over(Window.partitionBy("__g")), "chats": F.size(F.collect_set(chat).over(Window.partitionBy("__g"))).cast("long")})
    return counts.where("__r = 1").drop("__k", "__g", "__r").orderBy("place").limit(limit)


def within(answers: DataFrame, size: Column, cap: int) -> DataFrame:
    """The answers, in order of place, that fit: one that would go over the cap is left out and smaller ones after it may follow.

    The list is a search's, so it is folded as one array.
    """
    listed = answers.agg(F.array_sort(F.collect_list(F.struct("place", size.cast("long").alias("size")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    take = F.aggregate("all", start, lambda s, x: F.when(s["used"] + x["size"] <= cap, F.struct((s["used"] + x["size"]).alias("used"), F.concat(s["kept"], F.array(x["place"])).alias("kept"))).otherwise(s))
    return answers.join(F.broadcast(listed.select(F.explode(take["kept"]).alias("place"))), "place", "left_semi")


def search(records: DataFrame, query: str, limit: int = 10, id_col: str = "id", budget: int | None = None, documents: DataFrame | None = None) -> DataFrame:
    """The whole way from a query to grouped answers (id, place, source_kind, matches, chats, group_key, score, title, text, ...).

    `documents` has the records that are verified documents, as `verified_documents` gives them: they come first where the
    query is about them, and messages that only point to them are one group.
    """
    found = candidates(records, query, id_col)
    hits = complete(records, id_col).join(F.broadcast(found), id_col)  # at most CANDIDATES + SAVED rows
    if documents is not None:
        named = documents.groupBy(F.col("id").alias(id_col)).agg(F.min("name").alias("document_name"), F.min("version").alias("document_version"), F.lit(True).alias("document"))
        hits = hits.join(named, id_col, "left").withColumn("document", F.coalesce("document", F.lit(False)))
    answers = grouped(ranked(hits, query, id_col), limit, id_col)
    return answers if budget is None else within(answers, F.length(X.bounded(F.coalesce("title", F.lit("")), 240)) + F.length(X.bounded(F.coalesce("text", F.lit("")), 240)), budget)


def save_requests(items: DataFrame, packet_sources: DataFrame, receipts: DataFrame) -> DataFrame:
    """(memory_id, request), distinct: the save requests whose files brought a record in, by the names of the files."""
    name = F.regexp_extract(F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1), REQUEST_FILE, 1)
    given = receipts.where("options_json = '{}'").select("object_sha", F.lower(name).alias("request")).where("request <> ''")
    return items.select("memory_id", "packet_key").join(packet_sources.select("packet_key", "object_sha"), "packet_key").join(given, "object_sha").select("memory_id", "request").distinct()


def verified_documents(notes: DataFrame, requests: DataFrame, manifests: DataFrame, format: str | None = None) -> DataFrame:
    """(id, name, version) of notes whose title names a version, and for which a manifest of that name, version and request stands.

    Manifests are rows (name, version, request_id, format, has_instructions), as `sources.transcripts.versions` lists them; with
    `format`, only those of that format count.
    """
    titled = notes.select("id", "canonical_id", F.regexp_extract("title", DOCUMENT_TITLE, 1).alias("name"), F.regexp_extract("title", DOCUMENT_TITLE, 2).alias("version"))
    sound = titled.where(F.col("name").rlike("^[A-Za-z0-9][A-Za-z0-9 _.-]{0,79}$") & ~F.col("name").contains("..") & ~F.col("name").rlike("[. ]$"))
    asked = sound.select("id", "name", "version", F.explode(F.array("id", "canonical_id")).alias("memory_id")).join(requests, "memory_id")
    known = F.lit(True) if format is None else F.col("format") == format
    stands = manifests.where(known & F.col("has_instructions")).select("name", "version", F.lower("request_id").alias("request"))
    return asked.join(stands, ["name", "version", "request"]).select("id", "name", "version").distinct()


def resolve_document(notes: DataFrame, requests: DataFrame, manifests: DataFrame, query: str, format: str | None = None) -> DataFrame:
    """(id, name, status) of the one document version that a query names; no row if it names none, several, or too many fit.

    Only notes whose title has a word of the query beside the version are looked at; from `FEW` of them on nothing is said,
    and so where a note of that version is there but not verified.
    """
    mention = discovery.version_mention(query)
    if mention is None:
        return notes.select("id", F.lit("").alias("name"), F.lit("").alias("status")).where(F.lit(False))
    words, number = mention
    titles = notes.where((F.length("title") <= 128) & F.arrays_overlap(X.tokens(F.col("title")), F.array(*map(F.lit, words))))
    title = F.regexp_extract("title", DOCUMENT_TITLE, 2)
    seen = titles.agg(F.count("*").alias("n"), F.count(F.when(title == f"v{number}", 1)).alias("of_version")).first()
    known = verified_documents(titles, requests, manifests, format).withColumn("version", F.substring("version", 2, 9).cast("long"))
    found = discovery.resolve_version(known, query)
    return found.where(F.lit(seen.n <= FEW)).where((F.col("status") == "ok") | F.lit(not seen.of_version))
