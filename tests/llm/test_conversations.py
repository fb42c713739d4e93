"""Conversation repair against the cheapest of all edits, by brute force over strings."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import conversations as C

PATTERN = re.compile("(s?(ua)+)?")


def outcome(rows, audit):
    """Cost and role initials of an audit, over every choice of role; None where the edits do not fit."""
    found = []
    for roles in itertools.product("ua", repeat=sum(e in "RI" for e in audit)):
        roles, i, cost, said = iter(roles), 0, 0, ""
        for edit in audit:
            if edit == "I":
                cost, said = cost + 2, said + next(roles)
                continue
            initial, fault = rows[i]
            i += 1
            if edit == "D":
                cost += 3
                continue
            if fault == "x":
                break
            cost += (fault == "t") + (2 if edit == "R" else 0)
            said += next(roles) if edit == "R" else initial
        else:
            if i == len(rows) and PATTERN.fullmatch(said):
                found.append((cost, audit, said))
    return min(found, default=None)


def brute(rows):
    """Every order of edits with at most two insertions more than rows."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for inserted in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * k + e for k, e in zip(inserted, (*edits, ""), strict=True))
            if best and 2 * sum(inserted) > best[0]:
                continue
            if (got := outcome(rows, audit)) and (best is None or got < best):
                best = got
    return best


ROWS = st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from("-xt")), max_size=3)


@given(ROWS)
@settings(max_examples=120, deadline=None)
def test_cheapest_edits(rows):
    cost, audit = C.cheapest("".join(map("".join, rows)))
    assert (cost, audit) == brute(rows)[:2]


def by_levels(rows):
    """The same by rows and states, with whole audits as labels."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    now = {0: (0, "")}
    for initial, fault in [*rows, (None, None)]:
        for _ in range(3):  # insertions
            for s, (c, a) in list(now.items()):
                for x in "ua":
                    if s in step[x]:
                        t = step[x][s]
                        now[t] = min(now.get(t, (9**9, "")), (c + 2, a + "I"))
        if initial is None:
            return min(now[s] for s in (0, 3) if s in now)
        new = {}
        for s, (c, a) in now.items():
            ways = [(s, c + 3, "D")]
            if fault != "x":
                more = c + (fault == "t")
                ways += [(step[x][s], more + 2, "R") for x in "ua" if s in step[x]]
                ways += [(step[initial][s], more, "K")] if s in step.get(initial, {}) else []
            for t, cost, e in ways:
                new[t] = min(new.get(t, (9**9, "")), (cost, a + e))
        now = new


@given(st.lists(st.tuples(st.sampled_from("ssuuuaaat "), st.sampled_from("----xt")), max_size=60), st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_long_and_in_segments(rows, size):
    seen = "".join(map("".join, rows))
    want = by_levels(rows)
    assert C.cheapest(seen) == want
    parts = [seen[2 * i : 2 * (i + size)] for i in range(0, len(rows), size)]
    found = [[C.cheapest(x, p, (q,), False) for p in range(4) for q in range(4)] for x in parts]
    orders = [[sorted(w[1] for w in f[4 * (k // 4) : 4 * (k // 4) + 4] if w).index(x[1]) if x else None for k, x in enumerate(f)] for f in found]
    cost, ways, tail = C.fold([([x[0] if x else None for x in f], o) for f, o in zip(found, orders, strict=True)])
    assert (cost, "".join(f[w][1] for f, w in zip(found, ways, strict=True)) + tail) == want


def by_hand(rows, damage):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        held = groups[conv]
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        held += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in held} - {None}
        n = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        seen, lattice = set(), []
        for _, role, text in held:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            lattice.append((role[:1] or " ", {None: "-", "truncated": "t"}.get(fault, "x")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        cost, audit = by_levels(lattice)
        kept, i = [], 0
        for e in audit:
            row = None if e == "I" else held[i]
            i += e != "I"
            if e == "D":
                continue
            said = [x[0] for x in kept]
            role = row[1] if e == "K" else "assistant" if said and said[-1][:1] == "u" else "user"
            kept.append((role, row[2] if row else ""))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("damage", "segment"), [(True, 512), (False, 5)])
def test_conversations(spark, monkeypatch, damage, segment):
    rng = random.Random(4)
    monkeypatch.setattr(C, "SEGMENT_ROWS", segment)
    texts = ["Good.", "Yes!", "why", "So it is. ", "", " \n\t", None, "é日 …", "a\nb?", " ", "x.\x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    rows = [(conv, turn if rng.random() < 0.9 else None, rng.choice(roles[: 2 + rng.randrange(8)]), rng.choice(texts[: 2 + rng.randrange(10)]) if rng.random() < 0.5 else f"{rng.random()}{rng.choice(['.', '', '!'])}") for conv in [*range(60), None] for turn in range(rng.choice([1, 2, 5, 9]))]
    rows += [(500, t // 2, rng.choice(roles[:5]), f"t {t % 90}{rng.choice(['.', '.', ''])}") for t in range(700)]
    rows += [(501, 3, "user", "same.")] * 40 + [(502, 10**6, "user", "x" * 200_000), (503, None, "user", "Hi."), (503, None, "assistant", "Hi.")]
    frame = spark.createDataFrame([(*r, 1, "o", 2) for r in rows], "conv_id long, turn long, role string, text string, cost int, __own string, conv int")
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_conversations(frame, damage=damage).collect()}
    want = by_hand(rows, damage)
    assert got.keys() == want.keys()
    for conv, row in want.items():
        assert got[conv] == row
    assert C.repair_conversations(frame.where("false")).count() == 0


def test_conversation_that_is_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn int, role string, text string")
    assert [tuple(r) for r in C.repair_conversations(frame, damage=True).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
