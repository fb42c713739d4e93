"""Identities that become known late: anonymous messages joined with the records that other packets give an id, in any order.

What a message is depends on the set of packets alone, not on the order in which they came: links follow from order and
alignment, a component of links is one entity if it holds at most one known id and no two messages of one packet, and is left
apart otherwise. When packets arrive, only the conversations that they speak of are worked out again, and earlier anonymous
rows are pointed at the entity that is known by now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ingest import identities
from .records import compatible
from .relational import canonical_roots

#: Messages of the shortest packet that alignment may link.
LEAST = 2
_GROUP = ["kind", "account_id", "conversation_id"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) reaches.

    Each round takes the smallest label of the neighbours and then the label of that label, so rounds are few; each is written as a table.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    now = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        seen = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = now.join(seen, "node").select("node", "root", F.least("root", "near").alias("least"))
        jump = now.select(F.col("node").alias("least"), F.col("root").alias("further"))
        new = stored(least.join(jump, "least", "left").select("node", F.least("least", "further").alias("root"), (F.least("least", "further") < F.col("root")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        now = new.select("node", "root")


def _conversation() -> Column:
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c), F.lit("")) for c in _GROUP)), 256)


def _order_links(items: DataFrame) -> DataFrame:
    """(a, b): messages of one conversation with the same order, text and speaker (or none given), each linked to the least of them."""
    placed = items.where("source_order is not null")
    speakers = F.size(F.collect_set("speaker").over(Window.partitionBy("conversation", "source_order", "text_sha")))
    least = F.min("entity_id").over(Window.partitionBy("conversation", "source_order", "text_sha"))
    return placed.select(F.col("entity_id").alias("a"), least.alias("b"), speakers.alias("n")).where("n <= 1 and a <> b").select("a", "b")


def _aligned(items: DataFrame, least: int) -> DataFrame:
    """(a, b): messages of a packet whose whole run of texts stands in one place only of another of the conversation, and of that run there.

    Candidates come from the packet's first two texts, looked up among all neighbouring texts; each is then verified on the
    whole run, for speakers and orders too. Packets of one content are looked up once.
    """
    entry = F.struct("position", "text_sha", "speaker", "source_order", "entity_id")
    packets = items.groupBy("conversation", "packet_key").agg(F.array_sort(F.collect_list(entry)).alias("run")).withColumn("size", F.size("run")).where(F.col("size") >= least)
    pairs = packets.select("conversation", F.col("packet_key").alias("long_key"), F.col("run").alias("long"), F.col("size").alias("long_size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.concat(F.col("run")[i - 1]["text_sha"], F.col("run")[i]["text_sha"]))).alias("offset", "key"))
    short = packets.select("conversation", F.col("packet_key").alias("short_key"), F.col("run").alias("short"), F.col("size").alias("short_size"), F.concat(F.col("run")[0]["text_sha"], F.col("run")[1]["text_sha"]).alias("key"))
    bigger = (F.col("long_size") > F.col("short_size")) | (F.col("long_size") == F.col("short_size")) & (F.col("short_key") < F.col("long_key"))
    met = short.join(pairs, ["conversation", "key"]).where(bigger & (F.col("offset") + F.col("short_size") <= F.col("long_size")))
    same = lambda x: (x["s"]["text_sha"] == x["l"]["text_sha"]) & compatible(x["s"]["speaker"], x["l"]["speaker"]) & F.coalesce(x["s"]["source_order"] == x["l"]["source_order"], F.lit(True))
    zipped = F.arrays_zip(F.col("short").alias("s"), F.slice("long", F.col("offset") + 1, F.col("short_size")).alias("l"))
    fits = met.withColumn("pairs", zipped).where(F.forall("pairs", same))
    once = fits.groupBy("short_key", "long_key").agg(F.count("*").alias("n"), F.first("pairs").alias("pairs")).where("n = 1")
    return once.select(F.explode("pairs").alias("p")).select(F.col("p.s.entity_id").alias("a"), F.col("p.l.entity_id").alias("b")).where("a <> b")


def late_identities(messages: DataFrame, least: int = LEAST) -> DataFrame:
    """The messages with entity_id, memory_id and `link`: own (no link), linked, or refused (why it could not be).

    Messages are rows (packet_key, position, kind, account_id, conversation_id, message_id, speaker, source_order, text), each packet
    and position once. Known ids are never united with each other. Refused are `several_ids`, where links lead to more than one
    known id, and `repeated`, where they lead to two messages of one packet.
    """
    items = stored(identities(messages.where("conversation_id is not null")).withColumn("conversation", _conversation()))
    links = _order_links(items).union(_aligned(items, least))
    known = items.where("message_id is not null").select("entity_id").distinct().withColumn("known", F.lit(True))
    ends = links.join(known.select(F.col("entity_id").alias("a"), F.col("known").alias("ka")), "a", "left").join(known.select(F.col("entity_id").alias("b"), F.col("known").alias("kb")), "b", "left")
    roots = components(ends.where("ka is null or kb is null").select("a", "b"))
    members = items.select("entity_id", "packet_key", "message_id").distinct().join(roots, F.col("entity_id") == F.col("node"))
    of_packet = members.groupBy("root", "packet_key").agg(F.countDistinct("entity_id").alias("n"))
    several = of_packet.groupBy("root").agg(F.max("n").alias("in_packet"))
    ids = members.groupBy("root").agg(F.countDistinct(F.when(F.col("message_id").isNotNull(), F.col("entity_id"))).alias("n_known"), F.min(F.when(F.col("message_id").isNotNull(), F.col("entity_id"))).alias("known"), F.min("entity_id").alias("least"))
    verdict = ids.join(several, "root").select("root", F.coalesce("known", "least").alias("target"), F.when(F.col("n_known") > 1, "several_ids").when(F.col("in_packet") > 1, "repeated").alias("refused"))
    mapped = roots.join(verdict, "root").select(F.col("node").alias("of"), "target", "refused")
    joined = items.join(mapped, F.col("entity_id") == F.col("of"), "left")
    entity = F.when(F.col("refused").isNull(), F.coalesce("target", "entity_id")).otherwise(F.col("entity_id"))
    link = F.when(F.col("of").isNull(), "own").otherwise(F.coalesce("refused", F.lit("linked")))
    out = joined.withColumn("entity_id", entity).withColumn("link", link)
    return out.withColumn("memory_id", F.sha2(F.concat_ws(":", "entity_id", "text_sha"), 256)).drop("of", "target", "refused", "conversation")


def arrived(known: DataFrame, new: DataFrame, least: int = LEAST) -> DataFrame:
    """`late_identities` of all messages when `new` come to those `known` (as it returned them): only the conversations of new ones are worked out again."""
    columns = new.columns
    fresh = new.join(known.select("packet_key", "position"), ["packet_key", "position"], "left_anti").select(columns)
    touched = fresh.select(_conversation().alias("c")).distinct()
    marked = known.withColumn("c", _conversation()).join(touched.withColumn("again", F.lit(True)), "c", "left")
    again = late_identities(marked.where("again").select(columns).union(fresh), least)
    kept = marked.where("again is null").drop("c", "again")
    return kept.unionByName(again.select(kept.columns))


def repointed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(memory_id, canonical_id): memories of earlier runs that are another's by now; they leave the search and stay readable."""
    a, b = before.select("packet_key", "position", "memory_id"), after.select("packet_key", "position", F.col("memory_id").alias("canonical_id"))
    return a.join(b, ["packet_key", "position"]).where("memory_id <> canonical_id").select("memory_id", "canonical_id").distinct()


def canonical(aliases: DataFrame) -> DataFrame:
    """(id, root): the record that each superseded id stands for at last, by pointer jumping; a ring is an error."""
    once = aliases.where("id is not null and canonical is not null and id <> canonical").groupBy("id").agg(F.max("canonical").alias("canonical"))
    ends = once.select(F.col("canonical").alias("id")).distinct().join(once.select("id"), "id", "left_anti").withColumn("canonical", F.lit(None).cast(once.schema["canonical"].dataType))
    roots = canonical_roots(aliases.sparkSession, once.union(ends), "id", "canonical")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("aliases form a ring at "), F.col("id").cast("string")))).otherwise(F.col("root"))
    return roots.select("id", checked.alias("root")).where("id <> root")


def current(records: DataFrame, aliases: DataFrame, id_col: str = "id") -> DataFrame:
    """The records without superseded ones, which stay readable where they are asked for by id."""
    return records.join(aliases.where("id <> canonical").select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti").select(records.columns)
