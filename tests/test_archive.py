"""The archive's calls, and passages inside texts."""

import random

import pytest

from quillmill.archive import Archive
from quillmill.functions import passages as P
from quillmill.operators import passages as S


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("formalize", "formal"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"), ("sky", "sky"), ("a", "a"), ("größe", "größe")])
def test_stems(word, root):
    assert P.stem(word) == root


def test_spans_point_into_the_text_as_it_stands():
    text = "🌊 Straße café é\r\nneedle"
    assert [text[a:b] for a, b in P.spans(text, "STRASSE cafe é needle")] == ["Straße", "café", "é", "needle"]
    code = "def set_deadband(x)"
    assert [code[a:b] for a, b in P.spans(code, "set deadband band")] == ["set", "deadband"]
    assert P.spans("anything", "the of ***") == []


def test_windows():
    lines = "one\ntwo\n\nthree adopted measures\n" + "y" * 300
    assert [lines[a:b] for a, b in P.windows(lines)] == ["one\ntwo", "three adopted measures", "y" * 300]
    assert lines[slice(*P.best_passage(lines, "adopting a measure"))] == "three adopted measures" and P.best_passage(lines, "zebra") is None


def reads(spark, query, *texts, chunk=None):
    """The preview of each text, whose place must be in the text as it stands; None where there is none."""
    rows = spark.createDataFrame([(i, t, *(chunk or (None, None))) for i, t in enumerate(texts)], "doc_id long, text string, low long, high long")
    got = {r.doc_id: r for r in S.select_sentences(rows, query, low="low", high="high").collect()}
    for i, r in got.items():
        assert r.preview.strip("…") in texts[i][r.start : r.end]
    return [got[i].preview if i in got else None for i in range(len(texts))]


def test_sentences_and_previews(spark):
    text = "First one. Here is the needle in a sentence! Last.\n" + "x" * 50
    long = "word " * 200 + "needle " + "word " * 200
    own, seen, none, empty, unbroken = reads(spark, "needle", text, long, "🌊 nothing here", "", "é" * 300 + " NEEDLE " + "é" * 300)
    assert own == "Here is the needle in a sentence!" and none == "🌊 nothing here" and empty is None
    assert "needle" in seen and len(seen) <= S.PREVIEW and seen[0] == seen[-1] == "…" and set(seen[1:-1].split()) == {"word", "needle"}
    assert "NEEDLE" in unbroken and len(unbroken) <= S.PREVIEW


def test_places_to_read(spark):
    text = "# Pump plan\nDate: today\nshort\nThe pump was taken apart on Monday and its seal replaced.\nStatus: pump works again\n\nDid the pump work? Nobody knew. The pump test failed twice, then passed.\nsee pump_v2.cfg for it"
    cut = text.replace("Status: ", "")
    assert reads(spark, "pump plan", text, cut) == ["Status: pump works again", "The pump was taken apart on Monday and its seal replaced."]
    assert reads(spark, 'open "pump_v2.cfg" pump', text) == ["see pump_v2.cfg for it"]
    at = text.index("Did the pump")
    assert reads(spark, "what happened in the pump test?", text, chunk=(at, at + 75)) == ["The pump test failed twice, then passed."]
    assert reads(spark, "nobody", text, chunk=(at, at + 75)) == ["Nobody knew."]
    assert reads(spark, "zebra", text, "plain") == ["Status: pump works again", "plain"]


def test_snippet_windows_against_all_windows(spark):
    rng = random.Random(1)
    for _ in range(400):
        n, size = rng.randrange(1, 40), rng.randrange(1, 12)
        words = [rng.choice("abcxyz") for _ in range(n)]
        hits = [(k, w) for k, w in enumerate(words) if w in "abc"]
        at, terms, count = P.snippet_window(hits, n, size)
        scores = [(len({w for k, w in hits if s <= k < s + size}), sum(s <= k < s + size for k, _ in hits)) for s in range(max(1, n - size + 1))]
        assert (terms, count) == max(scores) and (not hits or scores[min(at, len(scores) - 1)] == (terms, count))
    text = "Où est, the " + "mill " * 80 + "ÉTÉ wheel_été"
    got = {r.doc_id: r for r in P.snippets(spark.createDataFrame([(1, text), (2, "short été"), (3, None), (4, "none")], "doc_id long, text string"), "ete wheel", size=5).collect()}
    assert got[1].snippet == "… mill mill ÉTÉ wheel_été" and (got[1].n_terms, got[1].n_hits) == (2, 3) and got[2].snippet == "short été" and set(got) == {1, 2}


def test_a_key_is_written_once(spark, tmp_path):
    """In one call, in two, and with the same or other texts."""
    a = Archive(spark, str(tmp_path))
    write = lambda *rows: sorted((r.key, r.status) for r in a.store(spark.createDataFrame([(k, t, "s", None, None) for k, t in rows], "key string, text string, source string, title string, created_at string")).collect())
    assert write(("k", "one"), ("k", "two"), ("l", "same"), ("l", "same")) == [("k", "conflict"), ("k", "stored"), ("l", "replay"), ("l", "stored")]
    assert a.table("memories").count() == a.table("receipts").count() == a._rows("receipts").count() == 2
    kept = a.table("memories").where("text <> 'same'").first().text
    assert write(("k", "one"), ("k", "two"), ("k", kept)) == [("k", "conflict"), ("k", "replay"), ("k", "replay")] and a.table("memories").count() == 2


def test_superseded_records(spark, tmp_path):
    a = Archive(spark, str(tmp_path))
    a.store(spark.createDataFrame([(k, f"fox {k}", "s", None, None) for k in "abc"], "key string, text string, source string, title string, created_at string"))
    ids = {r.text[-1]: r.id for r in a.table("memories").collect()}
    pairs = lambda *p: spark.createDataFrame([(ids[x], ids[y]) for x, y in p], "memory_id string, canonical_id string")
    a.supersede(pairs("ab", "cc"))
    a.supersede(pairs("ab", "bc"))
    assert {r.id for r in a.search("fox").collect()} == {ids["c"]} and a.get(ids["a"]).first().body == "fox a"
    assert [a.canonical_id(ids[x]) for x in "abc"] == [ids["c"]] * 3 and a._rows("aliases").count() == 2
    a.supersede(pairs("ca"))
    with pytest.raises(Exception, match="ring"):
        a.canonical_id(ids["a"])


def test_archive(spark, tmp_path):
    a = Archive(spark, str(tmp_path))
    assert a.status().first().total == 0 and a.search("fox").count() == 0
    writes = [("k1", "The quick brown fox. All tests passed today.", "note | x", "Foxes", "2024-01-01"), ("k2", "A slow hound", "note | y", None, "bad date")]
    schema = "key string, text string, source string, title string, created_at string"
    assert {r.status for r in a.store(spark.createDataFrame(writes, schema)).collect()} == {"stored"}
    again = [writes[0], ("k2", "another text", "note | y", None, None)]
    assert sorted((r.key, r.status) for r in a.store(spark.createDataFrame(again, schema)).collect()) == [("k1", "replay"), ("k2", "conflict")]
    before = a.table("memories")
    messages = [(f"m{i}", f"turn {i}", "excerpt", "T", None, "me", c, i, "added") for c in ("c1",) for i in range(5)] + [("z", "other", "excerpt", "T", None, "you", "c1", 2, "added"), ("m1", "turn 1", "excerpt", "T", None, "me", "c1", 1, "reused")]
    a.import_messages(spark.createDataFrame(messages, "memory_id string, text string, kind string, title string, source_date string, account_id string, conversation_id string, source_order long, action string"))
    assert (before.count(), Archive(spark, str(tmp_path)).table("memories").count()) == (2, 8)
    a.import_messages(spark.createDataFrame(messages, "memory_id string, text string, kind string, title string, source_date string, account_id string, conversation_id string, source_order long, action string"))
    assert a.table("memories").count() == 8
    hit = a.search("quick foxes").first()
    assert hit.title == "Foxes" and hit.preview.startswith("The quick brown fox") and (hit.source_kind, hit.matches, hit.chats) == ("saved_note", 1, 0)
    assert a.search("quick foxes", budget=5).count() == 0
    row = a.map(hit.id).first()
    assert (row.start, row.first_line, row.label, row.total_blocks) == (0, 1, "Text", 1) and row.block_id.startswith("b")
    row = a.get(hit.id, 4, 9).first()
    assert (row.body, row.status) == ("quick", "ok") and a.get(hit.id, revision="0").first().status == "stale_revision" and a.get("none").count() == 0
    assert a.peek(hit.id, 10, 6, 5).first().body == "quick brown"
    assert [r.id for r in a.timeline("m2", 1, 2).collect()] == ["m1", "m2", "m3", "m4"]
    first = [r.id for r in a.list(limit=5).collect()]
    assert len(a.list(limit=5, membership=a.membership()).collect()) == 5
    with pytest.raises(ValueError):
        a.list(limit=5, membership="0:0:0")
    assert len(first + [r.id for r in a.list(first[-1], 5).collect()]) == 8
    assert {r.check: r.n for r in a.health().collect()} == {"repeated_ids": 0, "receipts_without_record": 0, "labels_without_record": 0}
    assert [(r.label, r.n) for r in a.brief({"animals": ["fox", "hound"]}, "animals").collect()] == [("tested_as_reported", 1), ("unknown", 1)]
    facts = spark.createDataFrame([(hit.id, "Colour", "brown"), (hit.id, "colour", "Brown"), ("none", "colour", "red")] + [(r.id, "colour", "grey") for r in a.table("memories").where("text like '%hound%'").collect()], "id string, subject string, value string")
    projects = {"animals": ["fox", "hound"]}
    found = {(r.section, r.label): (r.n, len(r.ids)) for r in a.project_brief(projects, "animals", facts).collect()}
    assert found == {("coverage", "open"): (2, 2), ("claim", "tested_as_reported"): (1, 1), ("claim", "unknown"): (1, 1), ("conflict", "colour"): (2, 2)}
    cite = lambda revision: [r.section for r in a.project_brief(projects, "animals", cited=spark.createDataFrame([(hit.id, revision)], "id string, revision string")).collect()]
    assert cite("0" * 64) == ["stale"] and cite(a.get(hit.id).first().revision) == ["coverage", "claim", "claim"]
