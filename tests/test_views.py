"""Views kept by changes against views made anew, under random changes, breaks and repeats."""

import random
from pathlib import Path

from quillmill.operators import views

CHANGES = "op string, id string, grp string, at long, size long, summary string"


def rows_of(frame):
    return sorted((r.grp, r.n, r.size, r.first_at, r.last_at, tuple(map(tuple, r.members))) for r in frame.collect())


def by_hand(records):
    out = []
    for g in {r[1] for r in records}:
        own = sorted(r for r in records if r[1] == g)
        least = {}
        for r in own:
            if r[4] is not None:
                least.setdefault(r[4], r[0])
        members = tuple(sorted((i, s) for s, i in least.items())[: views.MEMBERS])
        out.append((g, len(own), sum(r[3] for r in own), min(r[2] for r in own), max(r[2] for r in own), members))
    return sorted(out)


def test_random_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "BUCKETS", 8)
    rng, view, now = random.Random(5), views.GroupView(spark, f"{tmp_path}/v"), {}
    put = lambda i: ("put", i, f"g{rng.randrange(12)}", rng.randrange(50), rng.randrange(9), rng.choice([None, "a", "b", "c", "d", "e"]))
    for number in range(4):
        ids = rng.sample(range(120), 80 if number == 0 else 12)
        batch = [("delete", str(i), None, None, None, None) if number and rng.random() < 0.4 else put(str(i)) for i in ids]
        if number == 2:
            batch += [("delete", "none", None, None, None, None), (None, None, "g1", 1, 1, "x")] + [("delete", i, None, None, None, None) for i, r in now.items() if r[1] == "g3" and int(i) not in ids]
        for op, i, *rest in batch:
            if op == "put":
                now[i] = (i, *rest)
            else:
                now.pop(i, None)
        frame = spark.createDataFrame(batch, CHANGES)
        if number == 1:  # broken off after the signed rows, and again after the view
            view.signed(number, frame)
            view.write_view(number, view.signed(number, frame.limit(0)))
        view.apply(number, frame)
        if number == 3:
            view.apply(number, frame)
        want = by_hand(list(now.values()))
        assert rows_of(view.view()) == want and rows_of(views.rebuilt(view.records())) == want
    assert view.records().count() == len(now)


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    view = views.GroupView(spark, f"{tmp_path}/v")
    frame = lambda rows: spark.createDataFrame(rows, CHANGES)
    assert view.view().count() == 0
    view.apply(0, frame([("put", str(i), f"g{i % 20}", i, 1, "s") for i in range(60)]))
    files = lambda: {p: p.stat().st_mtime_ns for t in ("view", "records") for p in Path(f"{tmp_path}/v/{t}").rglob("*.parquet")}
    before = files()
    view.apply(1, frame([("put", "7", "g7", 7, 5, "other"), ("put", "8", "g8", 8, 1, "s")]))  # the second is as it was
    after = files()
    gone = {p.parent.name for p in before if p not in after}
    assert len(gone) == 1 and all(after[p] == t for p, t in before.items() if p.parent.name not in gone)
    row = view.view().where("grp = 'g7'").first()
    assert (row.n, row["size"]) == (3, 7) and [tuple(m) for m in row.members] == [("27", "s"), ("7", "other")]
    view.apply(2, frame([]))
    assert view.view().count() == 20
