"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows taken, state of the pattern `(s?(ua)+)?`); its edges keep, rerole or delete the next row, or
insert an empty one. A forward heap starts at the first row, a reverse heap at the accepted ends. They stop when no path as cheap
as the best meeting is left outside; then every edge from a node that is settled forward to one settled in reverse, on a path of
least cost, is a crossing, and the least of the concatenated audits is the answer. Nodes of one cost are settled in
the order of rows, as only keeping costs nothing and takes a row; so the least audit of a node is known when it is settled.

Rows are range-sorted, so a long conversation lies over many tasks. A conversation inside one task and of at most
SEGMENT_ROWS rows is solved at once. Others are solved in segments: for each state before and after, the same search gives a
cost, an audit and the order of the audits; these few numbers a segment are folded along the conversation. A segment
never ends with an insertion (the next one begins with it), so no audit is the start of another of the same rows, and orders can be
compared without the texts.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: Rows that one search covers.
SEGMENT_ROWS = 512
ROLES = {"u": "user", "a": "assistant"}
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; where each role's initial leads.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SOUND, GONE, CUT = "-", "x", "t"  # a row as the lattice sees it: without fault, to be deleted, truncated
LEGAL = frozenset(("su", "ua", "au"))
_BLANKS = " \t\n\x0b\x0c\r"
_before = {t: [(s, x) for x in "ua" for s, to in STEPS[x].items() if to == t] for t in range(4)}


def _ahead(rows: str, i: int, s: int, tail: bool):
    """(cost, edit, node) of the edges from a node; `rows` has two characters a row: initial and fault."""
    n = len(rows) // 2
    if i < n or tail:
        yield INSERT, "I", (i, 3 if s == 2 else 2)
    if i < n:
        yield DELETE, "D", (i + 1, s)
        initial, fault = rows[2 * i], rows[2 * i + 1]
        if fault != GONE:
            more = TRUNCATED if fault == CUT else 0
            to = STEPS.get(initial, {}).get(s)
            if to is not None:
                yield KEEP + more, "K", (i + 1, to)
            yield REROLE + more, "R", (i + 1, 3 if s == 2 else 2)


def _back(rows: str, i: int, t: int, tail: bool):
    """(cost, edit, node) of the edges into a node."""
    if i < len(rows) // 2 or tail:
        for s, _ in _before[t]:
            yield INSERT, "I", (i, s)
    if i:
        yield DELETE, "D", (i - 1, t)
        initial, fault = rows[2 * i - 2], rows[2 * i - 1]
        if fault != GONE:
            more = TRUNCATED if fault == CUT else 0
            for s, to in STEPS.get(initial, {}).items():
                if to == t:
                    yield KEEP + more, "K", (i - 1, s)
            for s, _ in _before[t]:
                yield REROLE + more, "R", (i - 1, s)


@lru_cache(maxsize=50_000)
def cheapest(rows: str, entry: int = 0, ends: tuple[int, ...] = ENDS, tail: bool = True) -> tuple[int, str] | None:
    """Least cost and, of that cost, the least audit from state `entry` to one of `ends`; None if there is no way.

    Without `tail` nothing is inserted after the last row.
    """
    n = len(rows) // 2
    best: tuple[dict, dict] = ({(0, entry): (0, "")}, {(n, t): (0, "") for t in ends})
    heaps = ([(0, 0, entry)], [(0, -n, t) for t in ends])
    settled: tuple[set, set] = (set(), set())
    least = min((0 for t in ends if (0, entry) == (n, t)), default=float("inf"))

    def top(side: int) -> float:
        heap = heaps[side]
        while heap and (abs(heap[0][1]), heap[0][2]) in settled[side]:
            heapq.heappop(heap)
        return heap[0][0] if heap else float("inf")

    while (a := top(0)) + (b := top(1)) <= least and (a != float("inf") or b != float("inf")):
        side = 0 if a <= b else 1
        cost, i, s = heapq.heappop(heaps[side])
        node = abs(i), s
        settled[side].add(node)
        own, other = best[side], best[1 - side]
        audit = own[node][1]
        for weight, edit, to in (_back if side else _ahead)(rows, *node, tail):
            if to in settled[side]:
                continue
            label = cost + weight, edit + audit if side else audit + edit
            if to not in own or label < own[to]:
                if to not in own or label[0] < own[to][0]:
                    heapq.heappush(heaps[side], (label[0], -to[0] if side else to[0], to[1]))
                own[to] = label
                if to in other:
                    least = min(least, label[0] + other[to][0])
    if least == float("inf"):
        return None
    forward, reverse = best
    found = [forward[v][1] for v in settled[0] if v in reverse and reverse[v] == (0, "") and v[0] == n and v[1] in ends and forward[v][0] == least]
    for u in settled[0]:
        cost, audit = forward[u]
        for weight, edit, v in _ahead(rows, *u, tail):
            if v in settled[1] and cost + weight + reverse[v][0] == least:
                found.append(audit + edit + reverse[v][1])
    return int(least), min(found)


def repaired(audit: str, roles: list[str], texts: list[str], state: int = 0) -> list[str]:
    """The rows, as `role:text`, that an audit makes of these, from a state on."""
    out, i = [], 0
    for edit in audit:
        if edit != "I":
            role, text = roles[i], texts[i]
            i += 1
            if edit == "D":
                continue
        if edit != "K":
            role = ROLES["a" if state == 2 else "u"]
        out.append(f"{role}:{'' if edit == 'I' else text}")
        state = STEPS[role[:1]][state]
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with a drop, an emptied text, no stops, a repetition or the role user, by checksum of `conv:turn`."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    fate = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    held = rows.select("conv", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return held.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with `blank`, `cut` and `again`: whether role and text stand at an earlier turn of the conversation."""
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    known = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(7), "text", "role"), "blank": bare == "", "cut": ~F.right(bare, F.lit(1)).isin(".", "!", "?")})
    often = known.where("not blank").groupBy("conv", "h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("first")).where("times > 1")
    often = often.select(F.col("conv").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first.turn").alias("first"))
    joined = known.join(often, F.col("conv").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return joined.select("conv", "turn", "role", "text", "blank", "cut", (F.col("g1").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).alias("again"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Run:
    """Consecutive rows of one conversation: counts, and what the lattice sees."""

    def __init__(self, before: tuple | None):
        self.rows, self.roles, self.texts = [], [], []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.turns = [None, None, 0]  # first, last, how many
        self.previous = before

    def add(self, turn, role: str, text: str, blank: bool, cut: bool, again: bool) -> None:
        row = turn, role, text
        fault = "blank" if blank else "duplicate" if again or row == self.previous else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        if self.rows and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        self.previous = row
        self.roles.append(role)
        self.texts.append(text)
        self.rows.append((role[:1] or " ") + (SOUND if fault is None else CUT if fault == "truncated" else GONE))


def _gaps(first, last, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


_THIN = "part int, at int, blank long, duplicate long, truncated long, illegal long, first long, last long, turns long, opens string, closes string, costs array<int>, orders array<int>"
_WIDE = "audits array<string>, roles array<string>, texts array<string>"


def _segments(sorted_rows: DataFrame, kind: str) -> DataFrame:
    """One row for each conversation that lies within a task, with its repair, and one for each segment of the others."""
    schema = f"conv {kind}, {_THIN}, {_WIDE}, gaps long, cost long, audit string, repaired_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[dict] = []
        conv, at, rows, before, inside = None, 0, None, None, False

        def finish(whole: bool) -> None:
            nonlocal at
            seen = "".join(rows.rows)
            row = {"conv": conv, "part": part, "at": at, **rows.counts}
            at += 1
            if whole:
                cost, audit = cheapest(seen)
                digest = hashlib.sha256("\n".join(repaired(audit, rows.roles, rows.texts)).encode()).hexdigest()
                row |= {"gaps": _gaps(*rows.turns), "cost": cost, "audit": audit, "repaired_sha256": digest}
            else:
                found = [[cheapest(seen, p, (q,), False) for q in range(4)] for p in range(4)]
                orders = [sorted(x[1] for x in found[p] if x) for p in range(4)]
                flat = [(p, x) for p in range(4) for x in found[p]]
                row |= {"first": rows.turns[0], "last": rows.turns[1], "turns": rows.turns[2], "opens": rows.roles[0][:1], "closes": rows.roles[-1][:1]}
                row |= {"costs": [x[0] if x else None for _, x in flat], "orders": [orders[p].index(x[1]) if x else None for p, x in flat], "audits": [x[1] if x else None for _, x in flat]}
                row |= {"roles": rows.roles, "texts": rows.texts}
            out.append(row)

        def table(types: pa.DataType) -> pa.RecordBatch:
            kinds = {"conv": types, "part": pa.int32(), "at": pa.int32(), "costs": pa.list_(pa.int32()), "orders": pa.list_(pa.int32())}
            kinds |= dict.fromkeys(("audits", "roles", "texts"), pa.list_(pa.string())) | dict.fromkeys(("opens", "closes", "audit", "repaired_sha256"), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], kinds.get(n, pa.int64())) for n in names], names)
            out.clear()
            return batch

        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows is None or own != conv:
                    if rows is not None:
                        finish(inside and at == 0)
                        inside = True
                    conv, at, rows = own, 0, _Run(None)
                elif len(rows.rows) >= SEGMENT_ROWS:
                    before = rows.previous
                    finish(False)
                    rows = _Run(before)
                rows.add(*row)
            if len(out) > 2000:
                yield table(types)
        if rows is not None:
            finish(False)
            yield table(types)

    return sorted_rows.mapInArrow(run, schema)


def fold(segments: list[tuple[list, list]]) -> tuple[int, list[int], str]:
    """Least cost, the way (4 * state before + state after) through each segment of (costs, orders), and what is inserted at the end."""
    labels = {0: (0, 0)}  # state: cost, place among the audits that lead here
    steps: list[dict[int, int]] = []
    for costs, orders in segments:
        new = {}
        for q in range(4):
            ways = [(c + costs[4 * p + q], place, p) for p, (c, place) in labels.items() if costs[4 * p + q] is not None]
            if ways:
                new[q] = min(ways)
        ranked = sorted(new, key=lambda q: (new[q][1], orders[4 * new[q][2] + q]))
        steps.append({q: new[q][2] for q in new})
        labels = {q: (new[q][0], k) for k, q in enumerate(ranked)}
    tails = {0: "", 3: "", 2: "I", 1: "II"}
    q = min(labels, key=lambda q: (labels[q][0] + INSERT * len(tails[q]), labels[q][1]))
    total, tail, chosen = labels[q][0] + INSERT * len(tails[q]), tails[q], []
    for step in reversed(steps):
        chosen.append(4 * step[q] + q)
        q = step[q]
    return total, chosen[::-1], tail


def _joined(segments: DataFrame, kind: str) -> DataFrame:
    """The result rows of conversations in segments: choose a way through each, then put audits and repaired rows end to end."""
    thin = segments.select("conv", *(x.split()[0] for x in _THIN.split(", "))).repartition("conv").sortWithinPartitions("conv", "part", "at")

    def choose(batches):
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            totals = {c: sum(r[c] for r in held) for c in _COUNTS}
            distinct, last, closes = 0, None, None
            for r in held:
                distinct += r["turns"] - (r["first"] is not None and r["first"] == last)
                last = last if r["last"] is None else r["last"]
                totals["illegal"] += closes is not None and closes + r["opens"] not in LEGAL
                closes = r["closes"]
            first = next((r["first"] for r in held if r["first"] is not None), None)
            cost, chosen, tail = fold([(r["costs"], r["orders"]) for r in held])
            rows = [{"conv": r["conv"], "part": r["part"], "at": r["at"], "way": way, "tail": ""} | dict.fromkeys((*_COUNTS, "gaps", "cost")) for r, way in zip(held, chosen, strict=True)]
            rows[-1] |= totals | {"gaps": _gaps(first, last, distinct), "cost": cost, "tail": tail}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

        kinds: dict = {}
        for batch in batches:
            kinds = {"conv": batch.schema.field(0).type, "part": pa.int32(), "at": pa.int32(), "way": pa.int32(), "tail": pa.string()} | dict.fromkeys((*_COUNTS, "gaps", "cost"), pa.int64())
            for row in batch.to_pylist():
                if held and row["conv"] != held[-1]["conv"]:
                    yield done()
                held.append(row)
        if held:
            yield done()

    ways = stored(thin.mapInArrow(choose, f"conv {kind}, part int, at int, way int, tail string, {', '.join(f'{c} long' for c in (*_COUNTS, 'gaps', 'cost'))}"))
    wide = segments.select(F.col("part").alias("of"), F.col("at").alias("no"), F.col("conv").alias("whose"), *(x.split()[0] for x in _WIDE.split(", ")))
    same = (F.col("part") == F.col("of")) & (F.col("at") == F.col("no")) & F.col("conv").eqNullSafe(F.col("whose"))
    pieces = ways.join(wide, same).drop("of", "no", "whose").repartition("conv").sortWithinPartitions("conv", "part", "at")

    def lay(batches):
        audit, digest, begun = [], hashlib.sha256(), False
        for batch in batches:
            for r in batch.to_pylist():
                own = r["audits"][r["way"]] + r["tail"]
                for line in repaired(own, r["roles"], r["texts"], r["way"] // 4):
                    digest.update(f"{'\n' if begun else ''}{line}".encode())
                    begun = True
                audit.append(own)
                if r["cost"] is not None:  # the last segment of its conversation
                    values = [r["conv"], *(r[c] for c in _COUNTS), r["gaps"], r["cost"], "".join(audit), digest.hexdigest()]
                    types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["conv", *_COUNTS, "gaps", "cost", "audit", "repaired_sha256"])
                    audit, digest, begun = [], hashlib.sha256(), False

    return pieces.mapInArrow(lay, f"conv {kind}, {', '.join(f'{c} long' for c in (*_COUNTS, 'gaps', 'cost'))}, audit string, repaired_sha256 string")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """One row for each conversation: its faults, and the cheapest edits that give the roles `(s?(ua)+)?`.

    Rows stand in the order of turn (nulls first), then role and text. A null role or text is one space, a null id a
    conversation of its own. With `damage` the rows are damaged first; a conversation without rows has zeros, an empty
    audit and the hash of the empty string. A role is known by its initial; rows of other roles, or of an empty one, can be
    reroled or deleted only. Rows that repeat are duplicates. An empty table gives no rows; other columns are not looked at.

    No task holds a whole long conversation, but its audit is one string and its hash one chain over its repaired text: both
    are put together in one task, which reads the text as a stream.
    Columns: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    given = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = given.schema["conv"].dataType.simpleString()
    plain = given.select("conv", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    marked = _marked(damaged(given) if damage else plain)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "text"]
    segments = stored(_segments(marked.repartitionByRange(n, *order).sortWithinPartitions(*order), kind))
    columns = ["conv", *_COUNTS, "gaps", "cost", "audit", "repaired_sha256"]
    solved = segments.where("audit is not null").select(*columns).union(_joined(segments.where("audit is null"), kind).select(*columns))
    (own,) = fresh(solved, "own")
    every = given.select(F.col("conv").alias(own)).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return every.join(solved, F.col(own).eqNullSafe(F.col("conv")), "left").select(F.col(own).alias(conv_col), *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
