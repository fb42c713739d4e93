"""Append-only JSONL transcripts and the queue folders between machines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PRIVACY_OFF, PRIVACY_ON, SECRET
from . import byte_ranges

CONTENT = "array<struct<type:string,text:string>>"
EVENT = f"struct<timestamp:string,type:string,payload:struct<id:string,source:string,thread_source:string,cwd:string,type:string,thread_id:string,item:struct<type:string,id:string,phase:string,content:{CONTENT}>>>"
PHASES = ("commentary", "final", "final_answer")
BATCH = 200


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, at, line): each complete line of each file with the byte where it begins; a last line without its end waits for a later run."""
    byte_ranges.register(spark)
    return spark.read.format("transcript_lines").option("path", folder).load()


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream: each micro-batch reads the bytes that came since, and the first line of each file that grew."""
    byte_ranges.register(spark)
    return spark.readStream.format("transcript_lines").option("path", folder).load()


def new_lines(spark: SparkSession, folder: str, known: DataFrame, max_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """The complete lines since the last run, and the places to go on from, for runs that keep their own places.

    `known` has rows (path, offset, header_sha, edge_sha) from the last run, one a file. A file starts anew where its first
    line is another, it is shorter than the offset, or the up to 1024 bytes before the offset are others. At most
    `max_bytes` of a file are read; a longer line waits. Lines are (path, at, line), `at` being the byte where they begin;
    the first line (at 0) always comes along. Places are (path, offset, header_sha, edge_sha, restarted).
    """
    byte_ranges.register(spark)
    old = {r.path: [r.offset, r.header_sha, r.edge_sha] for r in known.select("path", "offset", "header_sha", "edge_sha").collect()}
    ranges, places = [], []
    for path, size, _ in byte_ranges.listed(folder, ".jsonl"):
        low, restarted = byte_ranges.resumed(path, size, old.get(path))
        found = byte_ranges.entry(path, size, low, max_bytes)
        if found is None:
            continue
        places.append((path, *found, restarted))
        if low:
            with byte_ranges.opened(path) as file:
                ranges.append((path, 0, file.read(min(byte_ranges.HEAD, low)).find(b"\n") + 1))
        if found[0] > low:
            ranges.append((path, low, found[0]))
    lines = spark.read.format("transcript_lines").option("path", folder).option("ranges", json.dumps(ranges)).load()
    return lines, spark.createDataFrame(places, "path string, offset long, header_sha string, edge_sha string, restarted boolean")


def events(lines: DataFrame, paused: DataFrame | None = None) -> DataFrame:
    """Each line after the header with the reason why it is no message, or none; privacy state runs through each file.

    `paused` has rows (path, paused): the state that the last run left.
    """
    e = lines.select("path", "at", F.from_json("line", EVENT).alias("e"))
    heads = e.where("at = 0").select("path", F.col("e.payload.id").alias("session"), (F.col("e.type") == "session_meta").alias("sound"))
    p, item = F.col("e.payload"), F.col("e.payload.item")
    texts = F.filter(item["content"], lambda c: c["text"].isNotNull())
    body = e.where("at > 0").join(heads, "path").select(
        "path", "at", "session", item["id"].alias("message_id"), item["type"].alias("kind"), F.element_at(texts, 1)["text"].alias("text"),
        F.when(~F.col("sound"), "not_a_session").when((F.col("e.type") != "event_msg") | (p["type"] != "item_completed") | ~item["type"].isin("UserMessage", "AgentMessage"), "not_a_message")
        .when(p["thread_id"] != F.col("session"), "other_thread").when(item["phase"].isNotNull() & ~item["phase"].isin(*PHASES), "phase").when(item["id"].isNull(), "no_id")
        .when((F.size(item["content"]) != 1) | (F.size(texts) != 1), "not_one_text_part").when(F.trim(F.element_at(texts, 1)["text"]) == "", "empty").alias("shape"),
    )
    user = F.col("shape").isNull() & (F.col("kind") == "UserMessage")
    toggle = F.when(user & F.col("text").rlike(PRIVACY_OFF), True).when(user & F.col("text").rlike(PRIVACY_ON), False)
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    if paused is not None:
        body = body.join(paused.select("path", F.col("paused").alias("left_paused")), "path", "left")
    left = F.lit(False) if paused is None else F.coalesce("left_paused", F.lit(False))
    told = body.withColumn("toggle", toggle).withColumn("paused", F.coalesce(F.last("toggle", ignorenulls=True).over(before), left))
    reason = F.coalesce("shape", F.when(F.col("toggle").isNotNull(), "privacy_switch").when(F.col("paused"), "paused").when(F.col("text").rlike(SECRET), "secret"))
    return told.select("path", "at", "session", "message_id", "kind", "text", reason.alias("reason"))


def batches(found: DataFrame, size: int = BATCH) -> DataFrame:
    """Messages with the number of their packet: a dropped visible message or a repeated id ends one, as does its size."""
    w = Window.partitionBy("path").orderBy("at")
    seen = Window.partitionBy("path", "message_id").orderBy("at")
    marked = found.withColumn("again", F.row_number().over(seen) > 1).withColumn("stop", ((F.col("reason").isNotNull() & ~F.coalesce(F.col("reason") == "not_a_message", F.lit(False))) | F.col("again")).cast("int"))
    run = marked.withColumn("run", F.sum("stop").over(w)).where("reason IS NULL AND NOT again")
    place = F.row_number().over(Window.partitionBy("path", "run").orderBy("at")) - 1
    return run.withColumn("part", F.floor(place / size).cast("int")).select("path", "session", "at", "message_id", "kind", "text", "run", "part")


def pending(files: DataFrame, cap: int = 8 << 20, most: int = 200) -> DataFrame:
    """Queued packets of (name, sha256, length) whose name is their digest, in name order, as many as the caps allow.

    The first `most` names are taken by a top-k, however long the queue is; the window runs over those only.
    """
    first = files.where(F.regexp_extract("name", r"^([0-9a-f]{64})\.json$", 1) == F.col("sha256")).orderBy("sha256").limit(most)
    w = Window.orderBy("sha256").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum("length").over(w)).where(F.col("used") <= cap).drop("used")


def acknowledge(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without the packets that have been committed."""
    return queue.join(done.select("sha256"), "sha256", "left_anti")


def versions(paths: DataFrame) -> DataFrame:
    """(name, versions in numeric order, latest) of folders name/vN/... in a column `path`."""
    parts = paths.select(F.regexp_extract("path", r"([^/]+)/v([1-9][0-9]*)(?:/|$)", 1).alias("name"), F.regexp_extract("path", r"([^/]+)/v([1-9][0-9]*)(?:/|$)", 2).alias("v"))
    return parts.where("name <> ''").groupBy("name").agg(F.array_sort(F.collect_set(F.col("v").cast("int"))).alias("versions"), F.max(F.col("v").cast("int")).alias("latest"))
