"""Keyed state with expiry: lookups and hints, in one go, in pieces, and delivered again."""

import datetime
from unittest import mock

import pandas as pd
from pyspark.sql import functions as F

from quillmill.streaming import ledger

DAY = 24 * 3600
REQUESTS = "lookup string, event long, at timestamp, search boolean, source string, cost long, capacity long"


def at(days, seconds=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=days, seconds=seconds)


def fed(spark, folder, batches, schema, build):
    """Write the batches one file after another, draining the stream after each; all that its sink holds."""
    (folder / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/p{n}")
        ledger.drained(build(spark.readStream.schema(schema).parquet(f"{folder}/in/*")), str(folder))
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def test_admissions_and_expiry(spark, tmp_path):
    first = [("a", 1, at(0), False, "s", 5, 600), ("a", 2, at(0, 1), True, "s", 100, 600), ("a", 4, at(0, 3), False, "t", 1, 0), ("a", 3, at(0, 2), False, "s", 400, 0), ("b", 5, at(0), True, "x", 5000, 9999)]
    second = [("a", 6, at(1), False, "s", 40, 0), ("a", 7, at(1, 1), False, "s", 36, 0), ("b", 8, at(2), True, "x", 1936, 0), (None, 9, at(2), True, "x", 1, 0)]
    third = [("c", 10, at(30), True, "z", 1, 512)]  # moves the watermark past the lives of a and b
    fourth = [("a", 11, at(31), False, "s", 1, 0), ("a", 12, at(31, 1), True, "s", 9, 0), ("c", 13, at(31, 2), False, "z", 1, 0)]
    out = fed(spark, tmp_path, [first, second, third, third[:0], fourth], REQUESTS, ledger.admissions)
    got = {r.event: (r.lookup, r.status, r.used) for r in out.collect()}
    assert got == {1: ("a", "unknown_lookup", None), 2: ("a", "admitted", 100), 3: ("a", "admitted", 500), 4: ("a", "outside_lookup", 500), 5: ("b", "over_budget", 0), 6: ("a", "over_budget", 500), 7: ("a", "admitted", 536),
                   8: ("b", "admitted", 1936), 10: ("c", "admitted", 1), 11: ("a", "unknown_lookup", None), 12: ("a", "admitted", 9), 13: ("c", "admitted", 2)}
    state = spark.read.format("statestore").option("stateVarName", "lookup").load(f"{tmp_path}/state")
    assert {r.key.lookup for r in state.select("key").collect()} == {"a", "c"}  # b has expired and a was opened anew


def test_the_same_admissions_in_pieces(spark, tmp_path):
    rows = [(f"u{i % 3}", i, at(0, 40 * i), i % 4 == 0, str(i % 5), (i * 37) % 200, 700) for i in range(120)]
    whole, parts = tmp_path / "w", tmp_path / "p"
    whole.mkdir()
    parts.mkdir()
    one = fed(spark, whole, [rows[::-1]], REQUESTS, ledger.admissions).drop("batch")
    many = fed(spark, parts, [rows[:50], rows[50:51], rows[51:]], REQUESTS, ledger.admissions).drop("batch")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and one.select("status").distinct().count() == 4


def test_state_is_called_once_for_a_source():
    rows = pd.DataFrame([(i, 1000 + i, i % 2 == 0, str(i // 2 % 3), 1, 2000) for i in range(300)], columns=["event", "at_ms", "search", "source", "cost", "capacity"])
    one = ledger.Ledger()
    one.init(mock.MagicMock())
    one.lookup, one.sources = mock.MagicMock(), mock.MagicMock()
    one.lookup.exists.return_value, one.lookup.get.return_value = True, (500, 2000, 10)
    one.sources.keys.return_value = iter([("0",)])
    (out,) = one.handleInputRows(("u",), iter([rows[:100], rows[100:]]), None)
    assert set(out["status"]) == {"admitted"} and out["used"].iloc[-1] == 310
    assert sorted(c.args[0][0] for c in one.sources.updateValue.call_args_list) == ["1", "2"]
    assert len(one.sources.method_calls) == 3 and one.lookup.update.call_args.args == ((500, 2000, 310),)


def test_hints(spark, tmp_path):
    schema = "source string, at timestamp"
    batches = [[("a", at(0)), ("b", at(1)), ("a", at(0, 5))], [("a", at(5)), ("a", at(4)), (None, at(5))], [("z", at(11))], [("z", at(11, 1))]]
    out = fed(spark, tmp_path, batches, schema, ledger.hints)
    last = {r.source: r.opened for r in out.groupBy("source").agg(F.max_by("opened_ms", "batch").alias("opened")).collect()}
    ms = lambda t: int(t.replace(tzinfo=datetime.UTC).timestamp() * 1000)
    assert last == {"a": ms(at(5)), "b": None, "z": ms(at(11, 1))}
    everything = spark.createDataFrame([x for b in batches for x in b], schema)
    assert [r.source for r in ledger.recent(everything).collect()] == ["z", "a"] and ledger.recent(everything, most=1).count() == 1
    assert ledger.recent(everything.where("false")).count() == 0
