"""The archive as one object: plain Parquet tables under one folder, and the calls that readers and writers make."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .functions import chunking
from .functions import text as X
from .operators import aliases, answers, discovery, passages, records, relational

SCHEMAS = {
    "memories": "id string, text string, source string, title string, created_at string, kind string, account_id string, conversation_id string, source_order bigint, saved boolean",
    "receipts": "key string, digest string, id string",
    "labels": "id string, state string",
    "aliases": "id string, canonical string",
}
#: Blocks on one page of a text's map.
MAP_PAGE = 5


class Archive:
    """Tables to which every write appends; ids are digests of what is written, so a write done twice adds no record.

    A frame of a table holds the files that were there when it was made: a reader that keeps it sees no later write.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str) -> DataFrame:
        return self._rows(name).dropDuplicates(["key"] if name == "receipts" else ["id"])

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).write.mode("append").parquet(f"{self.path}/{name}")

    def store(self, rows: DataFrame) -> DataFrame:
        """Add rows (key, text, source, title, created_at); (key, status): a key seen before is a replay or a conflict.

        Of several rows with one key that is new, the one with the least digest is stored; the same again is a replay, any
        other a conflict. Records go before receipts: a write that breaks off is done again whole, and its records are the same ones.
        """
        given = rows.select("key", "text", "source", "title", "created_at", F.sha2(F.concat_ws("\u0001", "text", "source", F.coalesce("title", F.lit(""))), 256).alias("digest"))
        old = self.table("receipts").select("key", F.col("digest").alias("old"))
        own = Window.partitionBy("key").orderBy("digest")
        turn, first = F.row_number().over(own), F.coalesce("old", F.first("digest").over(own))
        judged = given.join(old, "key", "left").withColumn("status", F.when(F.col("digest") != first, "conflict").when(F.col("old").isNull() & (turn == 1), "stored").otherwise("replay"))
        new = judged.where("status = 'stored'").withColumn("id", F.substring(F.sha2(F.concat_ws(":", "key", "digest"), 256), 1, 32))
        if not new.isEmpty():
            blank = F.lit(None).cast("string")
            self._append("memories", new.withColumns({"kind": blank, "account_id": blank, "conversation_id": blank, "source_order": F.lit(None).cast("long"), "saved": F.lit(True)}))
            self._append("receipts", new)
        return judged.select("key", "status")  # against the receipts from before

    def import_messages(self, messages: DataFrame) -> None:
        """Add resolved messages (see operators.ingest) whose action is `added`, and that are not there yet."""
        new = messages.where("action = 'added'").select(F.col("memory_id").alias("id"), "text", F.concat_ws(" | ", "kind", "conversation_id").alias("source"), "title", F.col("source_date").alias("created_at"), "kind", "account_id", "conversation_id", "source_order", F.lit(False).alias("saved"))
        self._append("memories", new.join(self.table("memories").select("id"), "id", "left_anti"))

    def supersede(self, rows: DataFrame) -> None:
        """Add (memory_id, canonical_id), as `aliases.repointed` gives them: the first leave the search and stay readable by id."""
        new = rows.where("memory_id <> canonical_id").select(F.col("memory_id").alias("id"), F.col("canonical_id").alias("canonical")).distinct()
        self._append("aliases", new.join(self.table("aliases"), ["id", "canonical"], "left_anti"))

    def canonical_id(self, id: str) -> str:
        """The record that an id stands for by now."""
        row = aliases.canonical(self.table("aliases")).where(F.col("id") == id).first()
        return id if row is None else row.root

    def search(self, query: str, limit: int = 20, budget: int | None = None) -> DataFrame:
        """(id, place, source_kind, matches, chats, title, preview, passage): copies in one group, within a budget of characters."""
        found = answers.search(aliases.current(self.table("memories"), self.table("aliases")), query, max(1, min(100, limit)), "id", budget)
        shown = passages.with_passages(found, query, "id")
        return found.select("id", "place", "source_kind", "matches", "chats", "score", X.bounded(F.col("title"), 240).alias("title")).join(shown.select("id", "preview", "passage"), "id").orderBy("place")

    def membership(self) -> str:
        """A fingerprint of the ids in the archive, for pages that belong together."""
        row = relational.membership_fingerprint(self.table("memories"), "id").first()
        return f"{row.n}:{row.digest}:{row.total}"

    def list(self, after: str | None = None, limit: int = 50, membership: str | None = None) -> DataFrame:
        """The next page by id; with the fingerprint of the first page, an error if records have come since."""
        if membership is not None and membership != self.membership():
            raise ValueError("the archive has changed since the first page")
        t = F.col("text")
        page = relational.keyset_page(self.table("memories"), "id", after, limit)
        return page.select("id", F.substring("title", 1, 80).alias("title"), F.substring("source", 1, 100).alias("source"), F.substring("created_at", 1, 40).alias("created_at"), F.substring(t, 1, 120).alias("preview"), (F.length(t) > 120).alias("truncated"))

    def map(self, id: str, start: int = 0) -> DataFrame:
        """(block_id, start, end, first_line, last_line, kind, label, total_blocks) of the next blocks of a text from a place on."""
        parts = chunking.blocks(self.table("memories").where(F.col("id") == id), "id")
        total = parts.groupBy("id").agg(F.count("*").alias("total_blocks"))
        return parts.where(F.col("end") > start).join(total, "id").orderBy("start").limit(MAP_PAGE).select("block_id", "start", "end", "first_line", "last_line", "kind", "label", "total_blocks")

    def get(self, id: str, start: int = 0, end: int | None = None, revision: str | None = None) -> DataFrame:
        """(id, revision, status, body): a slice by code points; `stale_revision` if the text is another by now."""
        row = self.table("memories").where(F.col("id") == id).withColumn("revision", X.revision(F.col("text")))
        good = F.lit(True) if revision is None else F.col("revision") == revision
        size = F.length("text") if end is None else F.lit(end - start)
        return row.select("id", "revision", F.when(good, "ok").otherwise("stale_revision").alias("status"), F.when(good, F.substring(F.col("text"), F.lit(start + 1), size)).alias("body"))

    def peek(self, id: str, at: int, before: int = 200, after: int = 400) -> DataFrame:
        low = max(0, at - before)
        return self.get(id, low, at + after).withColumn("start", F.lit(low))

    def timeline(self, id: str, before: int = 2, after: int = 2) -> DataFrame:
        """Records around one in its conversation and account, by order, else by date with unknown dates last."""
        rows = self.table("memories").where("conversation_id IS NOT NULL")
        anchor = rows.where(F.col("id") == id).select(F.col("conversation_id").alias("c"), F.col("account_id").alias("a"), F.col("source_order").alias("o"))
        time = F.try_to_timestamp("created_at")
        same = rows.join(F.broadcast(anchor), (F.col("conversation_id") == F.col("c")) & F.col("account_id").eqNullSafe(F.col("a"))).where("o IS NULL OR source_order IS NOT NULL")  # one row
        placed = relational.position(same, ["c"], [F.when(F.col("o").isNotNull(), F.col("source_order")), time.asc_nulls_last(), F.col("created_at"), F.col("id")])
        centre = placed.where(F.col("id") == id).select("c", "position")
        return relational.neighbours(placed, centre, ["c"], before, after).select("id", "position", "text", "created_at").orderBy("position")

    def brief(self, projects: dict[str, list[str]], project: str) -> DataFrame:
        """Coverage and claims of a project: (label, n, ids) by the order of labels."""
        named = self.table("memories").withColumn("project", records.project_of(F.concat_ws(" ", "title", "source", "text"), projects)).where(F.col("project") == project)
        label = discovery.evidence_label(F.col("text"), F.lit("observed"))
        order = F.array_position(F.array(*map(F.lit, discovery.LABEL_ORDER)), F.col("label"))
        return named.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("id")), 1, 24).alias("ids")).orderBy(order)

    def project_brief(self, projects: dict[str, list[str]], project: str, facts: DataFrame | None = None, cited: DataFrame | None = None) -> DataFrame:
        """(section, label, n, ids) of a project: coverage by state, claims by label, conflicts between facts.

        Facts are rows (id, subject, value); a subject with more than one value is a conflict. `cited` has rows (id, revision)
        on which an earlier brief rests: if any text is another by now, the answer is the section `stale` alone.
        """
        mine = self.table("memories").withColumn("project", records.project_of(F.concat_ws(" ", "title", "source", "text"), projects)).where(F.col("project") == project)
        some = lambda x: F.slice(F.array_sort(F.collect_set(x)), 1, 24)
        state = F.coalesce("state", F.lit("open"))
        parts = [mine.join(self.table("labels"), "id", "left").groupBy(state.alias("label")).agg(F.count("*").alias("n"), some("id").alias("ids")).select(F.lit("coverage").alias("section"), "label", "n", "ids")]
        parts.append(self.brief(projects, project).select(F.lit("claim").alias("section"), "label", "n", "ids"))
        if facts is not None:
            found = relational.conflicts(facts.join(mine.select("id"), "id", "left_semi"), ["subject"], "value", "id")
            parts.append(found.select(F.lit("conflict").alias("section"), F.col("subject").alias("label"), F.col("n_values").alias("n"), F.slice("members", 1, 24).alias("ids")))
        answer = functools.reduce(DataFrame.unionByName, parts)
        if cited is None:
            return answer
        now = self.table("memories").select("id", X.revision(F.col("text")).alias("now"))
        stale = cited.join(now, "id", "left").where(~F.col("now").eqNullSafe(F.col("revision"))).agg(F.count("*").alias("n"), some("id").alias("ids")).where("n > 0").select(F.lit("stale").alias("section"), F.lit("changed").alias("label"), "n", "ids")
        return answer if stale.isEmpty() else stale

    def status(self) -> DataFrame:
        """Records in all, labelled, held, and the percentage done."""
        rows = self.table("memories").join(self.table("labels"), "id", "left")
        done = F.count(F.when(F.col("state").isNotNull(), 1))
        return rows.agg(F.count("*").alias("total"), done.alias("complete"), F.count(F.when(F.col("state") == "held", 1)).alias("held"), F.round(F.try_divide(100.0 * done, F.count("*")), 2).alias("pct"))

    def health(self) -> DataFrame:
        """(check, n): records with one id and several texts, receipts without record, labels without record; all 0 in a sound archive."""
        m = self.table("memories")
        checks = [relational.surplus_rows(self._rows("memories").select("id", "text").distinct(), ["id"]).select(F.lit("repeated_ids").alias("check"), F.col("surplus").cast("long").alias("n"))]
        for t in ("receipts", "labels"):
            checks.append(self.table(t).join(m, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{t}_without_record").alias("check"), "n"))
        return checks[0].unionByName(checks[1]).unionByName(checks[2])
