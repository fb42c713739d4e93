"""Files as the archive imports them: packets, exports, transcripts, queues and versions."""

import hashlib
import json
import zipfile

import pytest

from quillmill.operators import ingest, relational
from quillmill.sources import byte_ranges, exports, packets, transcripts


def test_packets_and_identity(spark, tmp_path):
    message = lambda i, text, **more: {"text": text, "speaker": "user", "message_id": i, "source_order": more.pop("order", None), **more}
    files = {
        "a.json": {"format": "x/1", "kind": "excerpt", "account_id": "me", "conversation_id": "c", "messages": [message("m1", "one", order=0), message("m2", "two", order=1)], "colour": 1},
        "b.json": {"format": "x/1", "kind": "excerpt", "account_id": "me", "conversation_id": "c", "messages": [message("m1", "one"), message("m2", "two, edited")]},
        "c.json": {"format": "x/1", "kind": "excerpt", "messages": [message("m1", "x"), message("m1", "y")]},
        "d.json": {"format": "x/1", "kind": "excerpt", "messages": []},
        "e.json": {"format": "x/1", "kind": "poem", "messages": [message("q", "x")]},
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "f.md").write_text("﻿# A note")
    (tmp_path / "g.json.part").write_text("{")
    (tmp_path / "h.bin").write_text("?")
    read = packets.read_packets(packets.input_files(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    assert {k: r.error for k, r in got.items()} == {"a.json": None, "b.json": None, "c.json": "duplicate_message_id", "d.json": "no_messages", "e.json": "bad_kind", "f.md": None, "h.bin": "unknown_suffix"}
    assert got["a.json"].extra == 1 and got["f.md"].packet.messages[0].text == "# A note"
    rows = ingest.identities(packets.messages_of(read))
    empty = rows.where("1 = 0")
    acts = sorted((r.text, r.action) for r in ingest.resolve(rows, empty).collect())
    assert acts == [("# A note", "added"), ("one", "added"), ("one", "reused"), ("two", "added"), ("two, edited", "added")]
    assert {r.action for r in ingest.resolve(rows, rows).collect()} == {"reused"}


def test_anonymous_runs(spark):
    schema = "packet_key string, position int, message_id string, conversation_id string, source_order int, text string"
    archive = spark.createDataFrame([("k", i, f"m{i}", "c", i, t) for i, t in enumerate(["a", "b", "c", "b", "c", "d"])], schema)
    new = spark.createDataFrame([("once", 0, None, None, None, "a"), ("once", 1, None, None, None, "b"), ("twice", 0, None, None, None, "b"), ("twice", 1, None, None, None, "c"), ("short", 0, None, None, None, "a"), ("none", 0, None, None, None, "c"), ("none", 1, None, None, None, "a")], schema)
    assert {r.packet_key: (r.status, r.offset) for r in ingest.anonymous_matches(new, archive).collect()} == {"once": ("linked", 0), "twice": ("ambiguous", 1)}


def test_export_tree(spark, tmp_path):
    node = lambda parent, text, kind="text": {"parent": parent, "message": {"author": {"role": "user"}, "content": {"content_type": kind, "parts": [text]}}}
    tree = {"root": {"parent": None}, "a": node("root", "A"), "b": node("a", "B"), "side": node("a", "S"), "x": node("b", "X", "code"), "c": node("x", "C")}
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("conversations-0.json", json.dumps([{"id": "c1", "title": "t", "current_node": "c", "mapping": tree}]))
        z.writestr("conversations-1.json", "[]")
    with zipfile.ZipFile(tmp_path / "gap.zip", "w") as z:
        z.writestr("conversations-1.json", "[]")
    (tmp_path / "bad.zip").write_text("no")
    found = exports.conversations(packets.input_files(spark, str(tmp_path)).where("suffix = '.zip'"))
    assert sorted(r.error or "" for r in found.collect())[0] == "" and found.where("error IS NOT NULL").count() == 2
    rows = {r.text: (r.packet, r.source_order) for r in exports.runs(exports.branches(found)).collect()}
    assert set(rows) == {"A", "B", "C", "S"} and rows["A"][0] == rows["B"][0] != rows["C"][0] and rows["S"] == (None, None)
    assert rows["A"][1] < rows["B"][1] < rows["C"][1]


def test_long_and_broken_trees(spark):
    node = lambda i, parent: (i, parent, "user", i, None, None)
    chain = [node(f"n{i}", f"n{i - 1}" if i else None) for i in range(3000)]
    rows = [("s", "long", None, "n2999", chain, None), ("s", "ring", None, "b", [node("a", "b"), node("b", "a")], None), ("s", "gap", None, "b", [node("b", "gone")], None), ("s", "none", None, None, [node("a", None)], None)]
    nodes = exports.branches(spark.createDataFrame(rows, f"sha256 string, conversation_id string, title string, current_node string, nodes array<{exports.NODE}>, error string"))
    assert {r.conversation_id for r in nodes.where("error = 'cycle_or_missing_parent'").collect()} == {"ring", "gap"}
    got = exports.runs(nodes).collect()
    assert [r.source_order for r in sorted((r for r in got if r.conversation_id == "long"), key=lambda r: int(r.id[1:]))] == list(range(3000))
    assert {r.conversation_id for r in got} == {"long", "none"}


def test_canonical_roots_of_long_chains(spark):
    rows = [(i, i - 1 if i else None) for i in range(1000)] + [(2000, 2001), (2001, 2000), (2002, 2001), (3000, 2999), (3001, 3000)]
    got = {r.id: (r.root, r.error) for r in relational.canonical_roots(spark, spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect()}
    want = {i: (0, None) for i in range(1000)} | dict.fromkeys((2000, 2001, 2002), (None, "ring")) | dict.fromkeys((3000, 3001), (2999, "missing_parent"))
    assert got == want
    assert relational.canonical_roots(spark, spark.createDataFrame([], "id long, parent long"), "id", "parent").count() == 0


def test_transcripts(spark, tmp_path):
    item = lambda i, text, kind="UserMessage", **more: json.dumps({"type": "event_msg", "payload": {"type": "item_completed", "thread_id": "s", "item": {"type": kind, "id": i, "content": [{"type": "text", "text": text}], **more}}})
    lines = [json.dumps({"type": "session_meta", "payload": {"id": "s"}}), item("1", "hello"), item("2", "hi", "AgentMessage", phase="final"), item("3", "Please don't save this"), item("4", "hidden"), item("5", "/memory on"), item("6", "seen"), item("7", "password = abcdefgh1"), item("8", "end"), item("8", "end"), item("9", "noise", "ToolCall")]
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n" + '{"cut')
    found = transcripts.events(transcripts.read_lines(spark, str(tmp_path)))
    got = [(r.message_id, r.reason) for r in found.orderBy("at").collect()]
    assert got == [("1", None), ("2", None), ("3", "privacy_switch"), ("4", "paused"), ("5", "privacy_switch"), ("6", None), ("7", "secret"), ("8", None), ("8", None), ("9", "not_a_message")]
    parts = [(r.message_id, r.run) for r in transcripts.batches(found).orderBy("at").collect()]
    assert [m for m, _ in parts] == ["1", "2", "6", "8"] and len({r for _, r in parts}) == 3


def test_queue_and_versions(spark):
    sha = [hashlib.sha256(bytes([i])).hexdigest() for i in range(4)]
    queue = spark.createDataFrame([(f"{s}.json", s, 100) for s in sha] + [("x.json", "y", 1)], "name string, sha256 string, length long")
    ready = transcripts.pending(queue, cap=250)
    assert [r.sha256 for r in ready.orderBy("sha256").collect()] == sorted(sha)[:2]
    assert transcripts.acknowledge(queue, ready).count() == 3
    v = transcripts.versions(spark.createDataFrame([("in/plan/v2/a",), ("in/plan/v10/a",), ("in/plan/v2/b",), ("in/other/x",)], "path string")).collect()
    assert [(r.name, r.versions, r.latest) for r in v] == [("plan", [2, 10], 10)]


def test_new_lines_of_growing_files(spark, tmp_path):
    none = spark.createDataFrame([], "path string, offset long, header_sha string, edge_sha string")
    file = tmp_path / "s.jsonl"
    put = lambda text: file.write_bytes(text.encode())

    def run(known, **more):
        lines, places = transcripts.new_lines(spark, str(tmp_path), known, **more)
        places = spark.createDataFrame(places.collect(), places.schema)
        return sorted((r.at, r.line) for r in lines.collect()), places

    put("héad\none\ntw")
    got, places = run(none)
    assert got == [(0, "héad"), (6, "one")] and places.first().offset == 10
    put("héad\none\ntwö\nthree\n")
    got, places = run(places)
    assert got == [(0, "héad"), (10, "twö"), (15, "three")] and (places.first().offset, places.first().restarted) == (21, False)
    assert run(places)[0] == [(0, "héad")]
    put("héad\none\nTWO!\nthree\n")
    got, again = run(places)
    assert len(got) == 4 and again.first().restarted
    assert run(none, max_bytes=12)[0] == [(0, "héad"), (6, "one")]


def plain(path):
    """All complete lines of a file with their places, by hand."""
    at, out = 0, []
    for line in path.read_bytes().splitlines(keepends=True):
        if line.endswith(b"\n") and line.strip():
            out.append((at, line.rstrip(b"\n").decode()))
        at += len(line)
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_spans_part_a_file(tmp_path, monkeypatch, size):
    """Every line is in exactly one span, wherever the ranges are cut, and steps of reading do not show."""
    monkeypatch.setattr(byte_ranges, "STEP", 16)
    file = tmp_path / "a.jsonl"
    file.write_bytes("".join(f"{'é' * (i % 9)}{i}\n" + "\n" * (i % 4 == 3) for i in range(60)).encode() + b"cut")
    found = byte_ranges.entry(str(file), file.stat().st_size)
    assert found[0] == file.stat().st_size - 3
    for low in (0, 3, found[0] // 2):
        low = byte_ranges.line_end(open(file, "rb"), 0, low) if low else 0
        got = [(at, line.decode()) for s in byte_ranges.spans(str(file), low, found[0], size) for at, line in byte_ranges.lines_of(s) if line.strip()]
        assert got == [x for x in plain(file) if x[0] >= low]


def test_stream_reads_new_bytes_only(tmp_path, monkeypatch):
    read = []
    real = byte_ranges._bytes
    monkeypatch.setattr(byte_ranges, "_bytes", lambda f, a, b: (read.append(b - a), real(f, a, b))[1])
    file = tmp_path / "big.jsonl"
    with open(file, "wb") as f:
        f.write(b"head\n")
        f.truncate(3 << 30)  # three GB, of which the file system keeps nothing
        f.seek(0, 2)
        f.write(b"\nlast\n")
    reader = byte_ranges.TranscriptLines({"path": str(tmp_path), "header": "false"}).streamReader(None)
    start = reader.latestOffset()
    assert start[str(file)][0] == (3 << 30) + 6
    with open(file, "ab") as f:
        f.write("neu ä\nhalf".encode())
    read.clear()
    end = reader.latestOffset()
    got = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["at"], r["line"]) for r in got] == [((3 << 30) + 6, "neu ä")] and sum(read) < 4 * byte_ranges.HEAD + byte_ranges.STEP
    assert reader.partitions(end, reader.latestOffset()) == [] and len(reader.partitions({}, end)) == 97


def test_line_stream(spark, tmp_path):
    folder, at = tmp_path / "in", str(tmp_path)
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"

    def run():
        flow = transcripts.line_stream(spark, str(folder)).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
        flow.awaitTermination()
        now = sorted((r.path[-7:], r.at, r.line) for r in spark.read.parquet(f"{at}/out").collect())
        new = now.copy()
        for x in seen:
            new.remove(x)
        seen[:] = now
        return new

    seen = []
    a.write_bytes("héad\none\ntw".encode())
    assert run() == [("a.jsonl", 0, "héad"), ("a.jsonl", 6, "one")]
    a.write_bytes("héad\none\ntwo\n".encode())
    b.write_bytes(b"x\n")
    assert run() == [("a.jsonl", 0, "héad"), ("a.jsonl", 10, "two"), ("b.jsonl", 0, "x")]
    b.write_bytes(b"cut")  # nothing complete
    a.write_bytes(b"new\n")  # truncated: from the beginning
    assert run() == [("a.jsonl", 0, "new")]


def test_packets_are_halved(spark):
    kind = f"packet_key string, packet struct<kind:string,messages:array<{packets.MESSAGE}>>"
    many = lambda n, size: ("note", [("x" * size, None, None, i, None, None) for i in range(n)])
    out = packets.halved(spark.createDataFrame([("a", many(5, 10)), ("b", many(7, 100)), ("c", many(2, 900))], kind), 400).collect()
    orders = lambda k: [m.source_order for r in sorted(out, key=lambda r: r.part) if r.packet_key == k for m in r.packet.messages]
    assert orders("a") == list(range(5)) and orders("b") == list(range(7)) and orders("c") == [0, 1]
    assert {r.packet_key for r in out if r.oversize} == {"c"} and len([r for r in out if r.packet_key == "a"]) == 1


def test_images_by_content(spark, tmp_path):
    for name, body in {"a/x.png": b"1", "b/y.PNG": b"1", "b/z.jpg": b"2", "b/.h.png": b"3", "b/e.gif": b"", "b/t.txt": b"4"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = sorted((r.path.rsplit("/", 2)[-2:], r.folders, r.copies) for r in packets.images(spark, str(tmp_path)).collect())
    assert got == [(["a", "x.png"], ["a", "b"], 2), (["b", "z.jpg"], ["b"], 1)]
    known = spark.createDataFrame([(hashlib.sha256(b"2").hexdigest(),)], "sha256 string")
    assert packets.images(spark, str(tmp_path), known).count() == 1
