"""Messages that only point to a document make one group."""

from quillmill.operators import answers

RECORDS = "id string, text string, title string, source string, kind string, account_id string, conversation_id string, canonical_id string, saved boolean"


def row(i, text, title=None, kind="excerpt", account="me", conversation=None, saved=False):
    return (i, text, title, "s", kind, account, conversation or f"c{i}", i, saved)


def test_pointers_are_grouped(spark):
    rows = [
        row("doc", "River pump plan. Step one is the seal, step two the wheel.", "Handoff | River pump | v2", None, saved=True),
        row("a", "Please open the saved handoff River Pump v2", conversation="c1"),
        row("b", "the river pump document is available here now", conversation="c2"),
        row("c", "open the handoff river pump v2", conversation="c3"),
        row("d", "saved file river pump v3"),
        row("e", "The river pump failed, see the file"),
        row("f", "river pump handoff", account="you"),
        row("g", "river pump and the mill of the saved file"),
    ]
    records = spark.createDataFrame(rows, RECORDS)
    documents = spark.createDataFrame([("doc", "River pump", "v2")], "id string, name string, version string")
    got = {r.id: r for r in answers.search(records, "river pump", 20, documents=documents).collect()}
    assert got["doc"].place == 1 and got["doc"].source_kind == "saved_handoff"
    pointed = {i: (r.pointed_at, r.matches, r.chats) for i, r in got.items() if r.pointed_at}
    both = [i for i in "ac" if i in pointed]
    assert len(both) == 1 and pointed[both[0]] == ("river pump", 2, 2) and pointed["b"] == ("river pump", 1, 1) and pointed["f"] == ("river pump", 1, 1)
    assert set(got) == {"doc", both[0], "b", "d", "e", "f", "g"}
    plain = answers.search(records, "river pump", 20)
    assert plain.count() == 8 and plain.where("pointed_at is not null").count() == 0
