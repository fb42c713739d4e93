"""Conversation exports: ZIP archives of conversation lists, each a tree of messages."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_EXPANDED, MAX_MEMBERS = 128 << 20, 10_000
_PART = re.compile(r"(?:^|/)conversations(?:-(\d+))?\.json$")
NODE = "struct<id:string,parent:string,role:string,text:string,created:double,refused:string>"


def _text(message: dict) -> tuple[str | None, str | None]:
    """The one text part of a message, or why it is refused."""
    content = message.get("content") or {}
    kind, parts = content.get("content_type"), content.get("parts") or []
    if kind == "text":
        kept = [p for p in parts if isinstance(p, str)]
        return (kept[0], None) if len(parts) == len(kept) == 1 else (None, "not_one_text_part")
    if kind == "multimodal_text":
        kept = [p if isinstance(p, str) else p.get("text") for p in parts if isinstance(p, str) or p.get("content_type") == "audio_transcription"]
        return (kept[0], None) if len(kept) == 1 and kept[0] else (None, "not_one_text_part")
    return None, "unsupported_content"


def _members(raw: bytes) -> list[bytes]:
    """The numbered parts of one export in order; a gap in the numbers, encryption or too much data is an error."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_EXPANDED or any(i.flag_bits & 1 for i in infos):
            raise ValueError("archive_limits")
        found = sorted((int(m[1]) if m[1] else 0, i) for i in range(len(infos)) if (m := _PART.search(infos[i].filename)))
        if not found or [n for n, _ in found] != list(range(len(found))):
            raise ValueError("missing_part")
        return [z.read(infos[i]) for _, i in found]


def conversations(files: DataFrame) -> DataFrame:
    """(sha256, conversation_id, title, current_node, nodes, error) of ZIP files of (sha256, content): a row a conversation."""

    node = pa.struct([("id", pa.string()), ("parent", pa.string()), ("role", pa.string()), ("text", pa.string()), ("created", pa.float64()), ("refused", pa.string())])
    schema = pa.schema([("sha256", pa.string()), ("conversation_id", pa.string()), ("title", pa.string()), ("current_node", pa.string()), ("nodes", pa.list_(node)), ("error", pa.string())])

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for sha, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    lists = [json.loads(x.decode("utf-8-sig")) for x in _members(raw)]
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append({"sha256": sha, "error": str(e)[:80] or "bad_archive", "nodes": []})
                    continue
                for c in (c for part in lists for c in part):
                    nodes = []
                    for key, node in (c.get("mapping") or {}).items():
                        message = node.get("message") or {}
                        text, refused = _text(message) if message else (None, "no_message")
                        nodes.append({"id": key, "parent": node.get("parent"), "role": (message.get("author") or {}).get("role"), "text": text, "created": message.get("create_time"), "refused": refused})
                    rows.append({"sha256": sha, "conversation_id": c.get("id"), "title": c.get("title"), "current_node": c.get("current_node"), "nodes": nodes, "error": None})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("sha256", "content").mapInArrow(each, f"sha256 string, conversation_id string, title string, current_node string, nodes array<{NODE}>, error string")


def branches(found: DataFrame) -> DataFrame:
    """Each node with its distance from the current node on the branch to the root; nodes off that branch have none.

    A conversation is one row, so that its branch is walked within the row, however long it is. Where the walk meets a ring
    or a parent that does not exist, all nodes of the conversation have an error and no distance.
    """
    node = pa.struct([("id", pa.string()), ("parent", pa.string()), ("role", pa.string()), ("text", pa.string()), ("created", pa.float64()), ("refused", pa.string())])
    rest = [pa.field("steps", pa.int32()), pa.field("error", pa.string())]
    schema = pa.schema([pa.field("sha256", pa.string()), pa.field("conversation_id", pa.string()), *node, pa.field("current_node", pa.string()), *rest])

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for sha, conversation, current, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parents = {n["id"]: n["parent"] for n in nodes or ()}
                steps, at, error = {}, current, None
                while at is not None:
                    if at in steps or at not in parents:
                        steps, error = {}, "cycle_or_missing_parent"
                        break
                    steps[at] = len(steps)
                    at = parents[at]
                yield pa.RecordBatch.from_pylist([{"sha256": sha, "conversation_id": conversation, "current_node": current, **n, "steps": steps.get(n["id"]), "error": error} for n in nodes or ()], schema)

    rows = found.where("error IS NULL").select("sha256", "conversation_id", "current_node", "nodes")
    return rows.mapInArrow(each, "sha256 string, conversation_id string, id string, parent string, role string, text string, created double, refused string, current_node string, steps int, error string")


def runs(nodes: DataFrame) -> DataFrame:
    """Branch messages in order with the number of their packet: a refused node ends a packet; others stand alone.

    Conversations with an error in their tree give no messages; `branches` names them.
    """
    nodes = nodes.where("error IS NULL")
    w = Window.partitionBy("sha256", "conversation_id").orderBy(F.desc("steps"))
    on = nodes.where("steps IS NOT NULL").withColumn("packet", F.sum(F.col("refused").isNotNull().cast("int")).over(w)).withColumn("source_order", F.row_number().over(w) - 1)
    off = nodes.where("steps IS NULL").withColumn("packet", F.lit(None).cast("long")).withColumn("source_order", F.lit(None).cast("int"))
    return on.unionByName(off).where("refused IS NULL").select("sha256", "conversation_id", "id", "role", "text", "packet", "source_order")
