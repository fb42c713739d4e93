"""Import packets: JSON packets and plain notes from folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import packet_errors
from .tables import stored

MESSAGE = "struct<text:string,speaker:string,message_id:string,source_order:bigint,source_date:string,source_url:string>"
PACKET = f"struct<format:string,kind:string,title:string,account_id:string,conversation_id:string,source_url:string,source_date:string,derived_from:array<string>,messages:array<{MESSAGE}>>"
KINDS = ("excerpt", "summary", "note")
MAX_BYTES = 32 << 20


def input_files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, name, suffix, sha256, content, oversize) of the files in a folder, not in folders below it.

    Files still being written (.incoming-*, *.part, *.tmp) are no input; the content of a file over the limit is not kept.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.substring_index("path", "/", -1)
    rows = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).alias("suffix"), "length", "content")
    rows = rows.where(~F.col("name").rlike(r"^\.incoming-|\.part$|\.tmp$"))
    return rows.select("path", "name", "suffix", F.sha2("content", 256).alias("sha256"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"), (F.col("length") > max_bytes).alias("oversize"))


def read_packets(files: DataFrame) -> DataFrame:
    """(path, sha256, packet, error): JSON files parsed, text and Markdown files as a note of one message.

    `error` is null for a packet that may be imported. Fields that the packet format does not know are counted in `extra`.
    """
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    noted = F.struct(F.lit("note").alias("kind"), F.col("name").alias("title"), F.array(F.struct(text.alias("text"))).alias("messages"))
    as_note = F.from_json(F.to_json(noted), PACKET)
    packet = F.when(F.col("suffix") == ".json", F.from_json(text, PACKET)).when(F.col("suffix").isin(".txt", ".md", ".markdown"), as_note)
    known = F.array(*(F.lit(x) for x in ("format", "kind", "title", "account_id", "conversation_id", "source_url", "source_date", "derived_from", "messages")))
    extra = F.when(F.col("suffix") == ".json", F.size(F.array_except(F.coalesce(F.json_object_keys(text), known), known))).otherwise(0)
    rows = files.select("path", "sha256", "oversize", "suffix", packet.alias("packet"), extra.alias("extra"))
    error = (
        F.when(F.col("oversize"), "too_large")
        .when(~F.col("suffix").isin(".json", ".txt", ".md", ".markdown"), "unknown_suffix")
        .when(F.col("packet").isNull(), "not_a_packet")
        .when(~F.coalesce(F.col("packet.kind").isin(*KINDS), F.lit(False)), "bad_kind")
        .otherwise(packet_errors(F.col("packet.messages")))
    )
    return rows.select("path", "sha256", "packet", "extra", error.alias("error"))


def messages_of(packets: DataFrame) -> DataFrame:
    """One row for each message of the packets without error, with its packet key (the file's digest) and position."""
    p = F.col("packet")
    rows = packets.where("error IS NULL").select(F.col("sha256").alias("packet_key"), p["kind"].alias("kind"), p["title"].alias("title"), F.coalesce(p["account_id"], F.lit("")).alias("account_id"), p["conversation_id"].alias("conversation_id"), p["source_date"].alias("packet_date"), F.posexplode(p["messages"]).alias("position", "m"))
    return rows.select("*", F.col("m.*")).drop("m")


def canonical_json(value: Column) -> Column:
    """JSON of a struct whose fields are declared in sorted order; nulls are kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def halved(packets: DataFrame, max_bytes: int) -> DataFrame:
    """Packets (packet_key, packet) of which none is over the bytes as JSON: the messages of a larger one are halved until it fits.

    Columns: packet_key, part (the path of halves, `` for a whole packet), packet, oversize (one message that does not fit).
    Each round looks at the parts that are still too large; a packet of n messages takes log2(n) rounds at most.
    """
    p = F.col("packet")
    open_, done = packets.select("packet_key", F.lit("").alias("part"), "packet"), None
    while True:
        sized = stored(open_.withColumns({"fits": F.octet_length(F.to_json(p)) <= max_bytes, "n": F.coalesce(F.size(p["messages"]), F.lit(0))}))
        ready = sized.where("fits OR n < 2").select("packet_key", "part", "packet", (~F.col("fits")).alias("oversize"))
        done = ready if done is None else done.unionByName(ready)
        rest = sized.where("NOT fits AND n >= 2")
        if rest.isEmpty():
            return done
        middle = F.floor(F.col("n") / 2).cast("int")
        halves = [p.withField("messages", F.slice(p["messages"], a, n)) for a, n in ((F.lit(1), middle), (middle + 1, F.col("n") - middle))]
        open_ = rest.select("packet_key", "part", F.posexplode(F.array(*halves)).alias("half", "packet")).select("packet_key", F.concat("part", F.col("half").cast("string")).alias("part"), "packet")


IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".gif")


def images(spark: SparkSession, folder: str, known: DataFrame | None = None, max_bytes: int = MAX_BYTES, settled_before=None) -> DataFrame:
    """(sha256, path, size, modified, folders, copies) of the distinct images below a folder that `known` (sha256) does not have.

    One row for each content: its smallest path, when it was changed last, and the folders it is in. Empty and oversize
    files, hidden ones, parts still being written and those changed after `settled_before` wait.
    """
    name = F.substring_index("path", "/", -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kept = files.where(F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).isin(*IMAGES) & ~name.startswith(".") & F.col("length").between(1, max_bytes))
    if settled_before is not None:
        kept = kept.where(F.col("modificationTime") <= F.lit(settled_before))
    rows = kept.select(F.sha2("content", 256).alias("sha256"), "path", "length", "modificationTime", F.element_at(F.split("path", "/"), -2).alias("folder"))
    found = rows.groupBy("sha256").agg(F.min("path").alias("path"), F.first("length").alias("size"), F.max("modificationTime").alias("modified"), F.array_sort(F.collect_set("folder")).alias("folders"), F.count("*").alias("copies"))
    return found if known is None else found.join(known.select("sha256"), "sha256", "left_anti")
