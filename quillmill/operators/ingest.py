"""Identity resolution: entities and revisions from imported messages, merged with what the archive holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def identities(messages: DataFrame) -> DataFrame:
    """Messages with entity_id and memory_id.

    A message with an id of its own is the entity (kind, account, conversation, id); one without is anonymous and known by
    its packet and position. A memory is one text of one entity, so an edit is a new revision and a repeat is not.
    """
    own = F.concat_ws("\u0001", "kind", F.coalesce("account_id", F.lit("")), F.coalesce("conversation_id", F.lit("")), "message_id")
    anonymous = F.concat_ws("\u0001", F.lit("anonymous"), "packet_key", F.col("position").cast("string"))
    entity = F.sha2(F.when(F.col("message_id").isNotNull(), own).otherwise(anonymous), 256)
    rows = messages.withColumn("entity_id", entity).withColumn("text_sha", F.sha2("text", 256))
    return rows.withColumn("memory_id", F.sha2(F.concat_ws(":", "entity_id", "text_sha"), 256))


def resolve(messages: DataFrame, archive: DataFrame) -> DataFrame:
    """Messages with an action: `added` for a new memory, `reused` for one the archive or an earlier message has."""
    first = Window.partitionBy("memory_id").orderBy("packet_key", "position")
    known = archive.select("memory_id").distinct().withColumn("__known", F.lit(True))
    rows = messages.join(known, "memory_id", "left").withColumn("__n", F.row_number().over(first))
    return rows.withColumn("action", F.when(F.col("__known").isNull() & (F.col("__n") == 1), "added").otherwise("reused")).drop("__known", "__n")


def anonymous_matches(messages: DataFrame, archive: DataFrame, least: int = 2) -> DataFrame:
    """(packet_key, status, offset) of anonymous packets whose whole run of texts stands in a known conversation.

    `linked` if in one place of one conversation only, else `ambiguous`; packets of fewer than `least` messages never link.
    """
    short = messages.where("message_id IS NULL").select("packet_key", "position", F.sha2("text", 256).alias("k"))
    sizes = short.groupBy("packet_key").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    long = archive.where("message_id IS NOT NULL").select("conversation_id", "source_order", F.sha2("text", 256).alias("k"))
    runs = short.join(long, "k").groupBy("packet_key", "conversation_id", (F.col("source_order") - F.col("position")).alias("offset")).agg(F.countDistinct("position").alias("n"))
    whole = runs.join(sizes, "packet_key").where("n = size")
    return whole.groupBy("packet_key").agg(F.when(F.count("*") == 1, "linked").otherwise("ambiguous").alias("status"), F.min("conversation_id").alias("conversation_id"), F.min("offset").alias("offset"))
