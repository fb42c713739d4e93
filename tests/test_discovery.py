"""Notices and exact versions."""

from pyspark.sql import functions as F

from quillmill.operators import answers
from quillmill.operators import discovery as D


def test_notices(spark):
    rows = [("Did you mean: **fox trap**?",), ("Did you mean what you said? I wonder.",), ("Gemini → Build plan · opens a new conversation.",), ("Helper → Build plan · opens a new conversation.",), (None,), ("Did you mean\nmany\nlines?",)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").select(D.navigation_notice(F.col("t")).alias("n")).collect()]
    assert [tuple(n) if n else None for n in got] == [("clarification", "fox trap"), None, ("conversation_opened", "Build plan"), None, None, None]


def test_versions(spark):
    docs = spark.createDataFrame([("a1", "Build Plan", 1), ("a2", "Build Plan", 2), ("b2", "Test", 2)], "id string, name string, version int")
    say = lambda q: [tuple(r) for r in D.resolve_version(docs, q).collect()]
    assert say("open build plan v2 please") == [("a2", "Build Plan", "ok")] and say("v2 test") == [("b2", "Test", "ok")]
    assert say("build plan v9") == [(None, "Build Plan", "version_not_found")]
    assert say("compare build plan v1 and v2") == say("build plan") == say("other v2") == say("build plan v2 test") == []


RECORDS = "id string, text string, title string, source string, kind string, account_id string, conversation_id string, canonical_id string, saved boolean"
LONG = "The wheel of the mill turned slowly while the river was low, and nobody ground corn that week."


def test_answers_are_grouped(spark):
    rows = [
        ("a", LONG, "mill", "s", "excerpt", "me", "c1", None, None), ("b", LONG, "mill", "s", "excerpt", "me", "c2", None, None), ("c", LONG, "mill", "s", "excerpt", "me", "c2", None, None),
        ("d", "mill wheel", "x", "s", "excerpt", "me", "c3", None, None), ("e", "mill wheel", "x", "s", "excerpt", "me", "c4", None, None),
        ("f", "mill wheel and notes", "Mill wheel", "s", "note", None, None, None, True), ("g", "mill wheel and notes", "Mill wheel", "s", "note", None, None, "f", True),
        ("h", "Claude → mill wheel · in a new conversation.", "t", "s", "excerpt", "me", "c5", None, None), ("i", "anything → mill wheel · in a new conversation.", "t", "s", "excerpt", "me", "c6", None, None),
        ("j", "nothing of it", "t", "s", "memory", None, None, None, None),
    ]
    records = spark.createDataFrame(rows, RECORDS)
    got = {r.id: r for r in answers.search(records, "mill wheel").collect()}
    assert set(got) == {"a", "d", "e", "f", "h", "i"}
    assert (got["a"].matches, got["a"].chats, got["f"].matches, got["d"].matches, got["d"].chats) == (3, 2, 1, 1, 1)
    assert min(got.values(), key=lambda r: r.place).id == "f" and max(got.values(), key=lambda r: r.place).id == "h"
    assert {i: got[i].source_kind for i in "afhi"} == {"a": "chat", "f": "saved_note", "h": "navigation_notice", "i": "chat"}
    few = answers.search(records, "mill wheel", budget=60).collect()
    assert 0 < len(few) < len(got) and sum(len(r.title[:240]) + len(r.text[:240]) for r in few) <= 60
    assert [r.id for r in answers.search(records, "d").collect()][:1] == ["d"] and answers.search(records, "the of").count() == 0


def test_documents_are_verified(spark):
    notes = spark.createDataFrame([(f"n{i}", f"n{i}", t) for i, t in enumerate(("Handoff | Mill plan | v2", "Handoff | Mill plan | v3", "Handoff | ../up | v1", "A mill plan"))], "id string, canonical_id string, title string")
    items = spark.createDataFrame([("n0", "p0"), ("n0", "p0"), ("n1", "p1"), ("n2", "p2")], "memory_id string, packet_key string")
    sources = spark.createDataFrame([(f"p{i}", f"o{i}") for i in range(3)], "packet_key string, object_sha string")
    receipts = spark.createDataFrame([("o0", "in\\plugin-" + "A" * 64 + ".json", "{}"), ("o1", "in/plugin-" + "b" * 64 + ".json", "{}"), ("o2", "in/other.json", "{}"), ("o1", "in/plugin-" + "c" * 64 + ".json", '{"x":1}')], "object_sha string, path string, options_json string")
    requests = answers.save_requests(items, sources, receipts)
    assert sorted(map(tuple, requests.collect())) == [("n0", "a" * 64), ("n1", "b" * 64)]
    manifests = spark.createDataFrame([("Mill plan", "v2", "a" * 64, "f/1", True), ("Mill plan", "v3", "b" * 64, "f/1", False)], "name string, version string, request_id string, format string, has_instructions boolean")
    assert [tuple(r) for r in answers.verified_documents(notes, requests, manifests, "f/1").collect()] == [("n0", "Mill plan", "v2")]
    ask = lambda q: [(r.id, r.status) for r in answers.resolve_document(notes, requests, manifests, q).collect()]
    assert ask("what does Mill plan v2 say") == [("n0", "ok")]
    assert ask("open Mill plan v9") == [(None, "version_not_found")]
    assert ask("Mill plan v3") == ask("compare Mill plan v2 and v3") == ask("mill") == []


def test_ledger(spark):
    requests = spark.createDataFrame([("a", i, 40) for i in range(4)] + [("b", 0, 500), ("c", 0, 10)], "lookup_id string, seq int, cost long")
    ledger = spark.createDataFrame([("a", 10), ("a", 5), ("c", 95)], "lookup_id string, cost long")
    assert sorted((r.lookup_id, r.seq, r.used) for r in D.admitted(requests, ledger, 100).collect()) == [("a", 0, 55), ("a", 1, 95)]
