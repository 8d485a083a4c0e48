import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice import insights
from sluice.functions import calendar, keys
from sluice.runtime.report import Events, Report, Step, meta_by, meta_total


def test_calendar_values():
    assert calendar.parse("2026-08") == ("month", dt.date(2026, 8, 1))
    assert calendar.parse("2026-Q3") == ("quarter", dt.date(2026, 7, 1))
    assert calendar.parse("2026-W33") == ("week", dt.date(2026, 8, 10))
    with pytest.raises(ValueError):
        calendar.parse("not-a-label")
    assert calendar.bounds("month", "2026-08") == (dt.date(2026, 8, 1), dt.date(2026, 9, 1))
    assert calendar.bounds("year", "2026") == (dt.date(2026, 1, 1), dt.date(2027, 1, 1))
    assert calendar.bounds("quarter", "2026-Q4") == (dt.date(2026, 10, 1), dt.date(2027, 1, 1))
    with pytest.raises(ValueError):
        calendar.bounds("month", "2026")
    assert calendar.bucket_of_key("month", "2026-08-11|r4") == "2026-08"
    assert calendar.bucket_of_key("quarter", "2026-08") == "2026-Q3"
    with pytest.raises(ValueError):
        calendar.bucket_of_key("month", "r4")
    labels = {k: calendar.label_of(k, dt.date(2026, 8, 11)) for k in calendar.KINDS}
    assert labels == {"day": "2026-08-11", "week": "2026-W33", "month": "2026-08", "quarter": "2026-Q3", "year": "2026"}


def test_calendar_columns_agree(spark):
    days = [dt.date(2024, 12, 30), dt.date(2027, 1, 1), dt.date(2026, 8, 11), dt.date(2026, 2, 28), None]
    df = spark.createDataFrame([(d, None if d is None else f"{d}|x") for d in days], "d date, k string")
    for kind in calendar.KINDS:
        got = [tuple(r) for r in df.select("d", calendar.label(kind, "d"), calendar.bucket_of_key_column(kind, F.col("k"))).collect()]
        assert got == [(d, None, None) if d is None else (d, calendar.label_of(kind, d), calendar.label_of(kind, d)) for d in days]
    coarse = spark.createDataFrame([("2026-Q3",), ("2026-W33|a",), ("2026",), ("oops",), ("2026-13",)], "k string")
    assert [r[0] for r in coarse.select(calendar.bucket_of_key_column("quarter", F.col("k"))).collect()] == ["2026-Q3", "2026-Q3", "2026-Q1", None, None]


def test_keys_and_units(spark):
    df = spark.createDataFrame([("gf", 2025), (None, 1), ("", None)], "a string, b int")
    assert [r[0] for r in df.select(keys.key_of(["a", "b"])).collect()] == ["gf|2025", "|1", "|"]
    assert [r[0] for r in df.select(keys.key_of(["a"], "roll")).collect()] == ["roll|gf", "roll|", "roll|"]
    units = [r[0] for r in df.select(keys.identity_of(["a"])).collect()]
    assert len(set(units)) == 3


def test_fingerprints(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a")], "x string, y string")
    prints = [tuple(r) for r in df.select(keys.fingerprint(["x", "y"]), keys.fingerprint(["y", "x"])).collect()]
    assert len({p for r in prints for p in r}) == 4  # null and empty differ, order matters
    assert keys.fingerprint([]) is None and keys.fingerprint(None) is None


def test_basis(spark):
    rows = [{"a": "x", "b": 1}, {"a": "y", "b": None}]
    digest = keys.basis(rows, ["a", "b"])
    assert digest.startswith("1:") and digest == keys.basis(rows[::-1], ["a", "b"])
    assert digest == keys.basis(spark.createDataFrame(rows, "a string, b int"), ["a", "b"])
    assert len({digest, keys.basis(rows, ["b", "a"]), keys.basis(rows[:1], ["a", "b"]), keys.basis(rows, ["a"])}) == 4
    assert keys.basis([{"a": "ab", "b": "c"}], ["a", "b"]) != keys.basis([{"a": "a", "b": "bc"}], ["a", "b"])
    with pytest.raises(KeyError):
        keys.basis([{"a": 1}], ["zz"])
    assert keys.basis(rows, ["a"], version=9) == keys.BASIS_UNKNOWN
    assert keys.basis_matches(digest, rows, ["a", "b"]) and not keys.basis_matches(None, rows, ["a"]) and not keys.basis_matches("junk", rows, ["a"])
    odd = [{"a": "a", "b": "z"}, {"a": "a!", "b": "b"}, {"a": "a", "b": None}]  # sorted as lists, not as joined strings
    assert keys.basis(odd, ["a", "b"]) == keys.basis(spark.createDataFrame([(r["a"], r["b"]) for r in odd], "a string, b string"), ["a", "b"])
    assert keys.basis_version(digest) == 1 and keys.basis_version("x:y") == 0


def test_verdicts(spark):
    status = lambda h: insights.rollup(h).status
    assert insights.rollup({"present": 10, "failing": 2}) == insights.Verdict("findings", 2, 0)
    assert [status(h) for h in ({"present": 3, "pending": 1}, {"present": 3, "stale": 1}, {"present": 5}, {}, {"failing": 1, "pending": 9})] == ["pending", "pending", "green", "unknown", "findings"]
    assert [insights.roll_group(g) for g in (["green", "findings"], ["green", "pending"], ["green", "unknown"], ["unknown"], [])] == ["findings", "pending", "green", "unknown", "unknown"]
    df = spark.createDataFrame([("present",), ("failing",), (None,)], "status string")
    assert {r.status: r.n for r in insights.status_histogram(df).collect()} == {"present": 1, "failing": 1, None: 1}
    assert [tuple(r) for r in insights.status_histogram(df.select(F.lit(1).alias("x"))).collect()] == [(None, 3)]


def test_meta_rollups():
    assert meta_total([{"c": 100}, {"c": 5}], "c") == 105
    assert meta_total([{"c": {"a": 100}}, {"c": 5}, {"c": "x"}, {}], "c") == 105
    assert meta_by([{"c": {"a": 100, "b": "x"}}, {"c": 5}], "c") == {"a": 100, "unattributed": 5}
    report = Report([Step("a", 0, ["k"], [], 0, [], meta={"tokens": 7})])
    assert report.total("tokens") == 7 and report.total("absent") == 0


def test_events_contain_listeners():
    events, seen = Events(), []
    events.subscribe("drain.*", lambda name, what: seen.append(name))
    events.subscribe("drain.stop", lambda name, what: 1 / 0)
    events.emit("drain.stop")
    events.emit("scan.stop")
    assert seen == ["drain.stop"] and len(events.failures) == 1


def test_runs_keep_the_last():
    runs = insights.Runs(keep=2)
    for i in range(3):
        runs.record(i)
    assert (runs.recent(), runs.last(), runs.recent(1)) == ([2, 1], 2, [2])
    runs.forget()
    assert runs.last() is None
