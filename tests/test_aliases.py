"""Identities that become known late: any order of packets gives the same archive."""

import random

from quillmill.operators import aliases

SCHEMA = "packet_key string, position int, kind string, account_id string, conversation_id string, message_id string, speaker string, source_order int, text string"


def packet(key, texts, conv="c", ids=None, orders=None, speaker=None):
    return [(key, i, "excerpt", "me", conv, ids[i] if ids else None, speaker, orders[i] if orders else None, t) for i, t in enumerate(texts)]


def shown(frame):
    return sorted((r.packet_key, r.position, r.entity_id, r.memory_id, r.link) for r in frame.collect())


def test_links_and_refusals(spark):
    rows = packet("full", "abcdef", ids=[f"m{i}" for i in range(6)])
    rows += packet("part", "bcd") + packet("one", "e") + packet("other", "cx") + packet("placed", "f", orders=[9]) + packet("placed2", "f", ids=["m5"], orders=[9])
    rows += packet("twice", "ab", conv="d") + packet("repeats", "abab", conv="d", ids=["x0", "x1", "x2", "x3"]) + packet("far", "bcd", conv="other")
    rows += packet("k1", "pq", conv="e", ids=["1", "2"]) + packet("k2", "pq", conv="e", ids=["3", "4"]) + packet("both", "pq", conv="e")
    rows += packet("s1", "uv", conv="f", speaker="user") + packet("s2", "uv", conv="f", ids=["5", "6"], speaker="assistant")
    rows += packet("nobody", "ab", conv=None)
    got = {(r.packet_key, r.position): r for r in aliases.late_identities(spark.createDataFrame(rows, SCHEMA)).collect()}
    link = lambda k: [got[k, i].link for i in range(sum(r[0] == k for r in rows))]
    assert [got["part", i].entity_id for i in range(3)] == [got["full", i].entity_id for i in (1, 2, 3)] and link("part") == ["linked"] * 3
    assert link("one") == ["own"] and link("other") == ["own"] * 2 and link("far") == ["own"] * 3 and link("twice") == ["own"] * 2 and link("s1") == ["own"] * 2
    assert got["placed", 0].entity_id == got["full", 5].entity_id and link("placed") == ["linked"]
    assert link("both") == ["several_ids"] * 2 and len({got[k, 0].entity_id for k in ("k1", "k2", "both")}) == 3
    assert ("nobody", 0) not in got


def test_any_order_gives_the_same_archive(spark):
    rng = random.Random(7)
    talk = [rng.choice("abcdefgh") for _ in range(14)]
    packets = [packet("ids", talk[:9], ids=[f"m{i}" for i in range(9)]), packet("mid", talk[3:8]), packet("late", talk[6:12]), packet("end", talk[8:], ids=[f"m{i}" for i in range(8, 14)]), packet("side", talk[2:6], conv="z")]
    whole = shown(aliases.late_identities(spark.createDataFrame([r for p in packets for r in p], SCHEMA)))
    assert {x[4] for x in whole} >= {"own", "linked"}
    batches = lambda order: [order[0] + order[1], order[2], order[3] + order[4]]
    for order in map(batches, (packets[::-1], rng.sample(packets, len(packets)))):
        now = aliases.late_identities(spark.createDataFrame(order[0], SCHEMA))
        for p in order[1:]:
            before = now
            now = aliases.arrived(now, spark.createDataFrame(p, SCHEMA))
            moved = {r.memory_id for r in aliases.repointed(before, now).collect()}
            assert moved.isdisjoint({r.memory_id for r in now.collect()})
        assert shown(now) == whole
    assert shown(aliases.arrived(now, spark.createDataFrame(packets[1], SCHEMA))) == whole


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.root for r in aliases.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: parent[x] for a, b in edges if a != b for x in (a, b)}
    assert aliases.components(spark.createDataFrame([], "a long, b long")).count() == 0
