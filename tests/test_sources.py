import pytest
from pyspark.sql import functions as F

from sluice import insights, jobs
from sluice.plans.model import Node, PerKey, Poll, Reduce
from sluice.runtime.engine import Engine
from sluice.sources.polling import NoScanner, PollResult, Source, poll_all, poll_cell, refresh
from sluice.sources.reconcile import invalidate, reconcile
from sluice.streaming import writes_of

DOCS = "key string, body string, md5 string, status string, seen int, fingerprint string"


def engine_of(spark, tmp_path, *nodes):
    return Engine(spark, nodes, str(tmp_path / "state"))


def scan(engine, rows, cell="docs", **options):
    df = engine.spark.createDataFrame(rows, "key string, body string, md5 string, seen int")
    return reconcile(engine, cell, df, **options)


def docs(**options):
    return Node("docs", DOCS, leaf=True, fingerprint=["md5"], **options)


def table(engine, *columns):
    return sorted(map(tuple, engine.table("docs").select(*columns).collect()))


def test_observations(spark, tmp_path):
    e = engine_of(spark, tmp_path, docs())
    assert scan(e, [("a", "x", "1", 1), ("b", "y", "2", 1)]).counts == {"created": 2, "updated": 0, "revived": 0, "retired": 0}
    e.drain()
    again = scan(e, [("a", "x2", "1", 2), ("b", "y", "2", 2)])  # only bookkeeping moved
    assert again.changed == [] and e.is_clean() and table(e, "key", "body", "seen") == [("a", "x2", 2), ("b", "y", 2)]
    moved = scan(e, [("a", "x", "9", 3)])
    assert moved.changed == ["a", "b"] and moved.counts == {"created": 0, "updated": 1, "revived": 0, "retired": 1}
    assert table(e, "key") == [("a",)]
    with pytest.raises(ValueError, match="observed"):
        scan(e, [("a", "x", "9", 3)], observed="some")
    with pytest.raises(ValueError, match="retire"):
        scan(e, [("a", "x", "9", 3)], retire="hide")


def test_policies(spark, tmp_path):
    e = engine_of(spark, tmp_path, docs(retain_if_vanished=True))
    scan(e, [("a", "x", "1", 1), ("b", "y", "2", 1)])
    assert scan(e, [("a", "x", "1", 1)]).changed == [] and len(table(e, "key")) == 2
    assert scan(e, [("a", "x", "1", 1)], observed="partial", retire="destroy").changed == []
    assert scan(e, [("a", "x", "1", 1)], retire="destroy").changed == ["b"] and table(e, "key") == [("a",)]


def test_mark_and_revive(spark, tmp_path):
    tomb = lambda rows: rows.select("key", F.lit("gone").alias("status"))
    e = engine_of(spark, tmp_path, docs(retain_if_vanished=tomb, live=lambda: F.coalesce(F.col("status") != "gone", F.lit(True))))
    scan(e, [("a", "x", "1", 1), ("b", "y", "2", 1)])
    assert scan(e, [("a", "x", "1", 1)]).counts["retired"] == 1 and table(e, "key", "status")[1] == ("b", "gone")
    assert scan(e, [("a", "x", "1", 1)]).changed == []  # what is marked does not vanish again
    back = scan(e, [("a", "x", "1", 1), ("b", "y", "2", 1)])
    assert (back.changed, back.counts["revived"]) == (["b"], 1)


def test_verdicts_of_the_caller(spark, tmp_path):
    e = engine_of(spark, tmp_path, docs())
    scan(e, [("a", "x", "1", 1), ("b", "y", "2", 1), ("c", "z", "3", 1)])
    e.drain()
    said = spark.createDataFrame([("a", "changed"), ("b", "unchanged"), ("c", None)], "key string, verdict string")
    assert reconcile(e, "docs", said).changed == ["a"] and len(table(e, "key")) == 3
    with pytest.raises(ValueError, match="verdict"):
        reconcile(e, "docs", spark.createDataFrame([("a", "maybe")], "key string, verdict string"))


class Feed(Source):
    def __init__(self, answer):
        self.answer = answer

    def poll(self, engine, cell, part=0, progress=None):
        progress(part=part)
        return self.answer(engine, cell, part)


def test_polling(spark, tmp_path):
    def answer(engine, cell, part):
        if part == 3:
            raise OSError("unreachable")
        return [("a",), {"changed": ["a"], "unreachable": ["z"], "detail": {"pages": 4}}, scan(engine, [("a", "x", "1", part)])][part] if part < 3 else None

    def tally(rows):
        return rows

    node = docs(poll=Poll(Feed(answer), {"part": lambda: 2}, every="1h"))
    per = Node("per", "key string, n long", ("key",), Reduce("docs", "key", {"count": "n"}, query=lambda rows, claimed: tally(rows)))
    e = engine_of(spark, tmp_path, node, per)
    assert refresh(e, "docs").ok and e.dirty_cells() == ["docs"]
    e.drain()
    assert poll_cell(e, "docs", part=1).unreachable == ["z"] and e.is_clean()
    assert refresh(e, "docs", part=1).detail == {"pages": 4} and e.dirty_cells() == ["docs"]
    e.drain()
    failed = poll_all(e, part=3)["docs"]
    assert not failed.ok and isinstance(failed.error, OSError) and e.is_clean()
    with pytest.raises(NoScanner):
        poll_cell(e, "per")
    assert jobs.scan(e, "per")[0] == "cancel" and jobs.scan(e, "docs", part=3)[0] == "error"
    runs = insights.Runs()
    state, run = jobs.scan(e, "docs", runs=runs, part=1)
    assert state == "ok" and not run.complete and run.total("pages") == 4 and run.by("pages") == {"unattributed": 4} and runs.last() is run
    state, run = jobs.sweep(e, every="1h")
    assert state == "ok" and run.complete and not run.changed
    with e.store.lock():
        assert jobs.sweep(e)[0] == "busy"
    with e.store.lock():
        assert jobs.drain_job(e)[0] == "busy"
    assert jobs.drain_job(e)[0] == "ok"
    assert PollResult(error=OSError()).ok is False


def test_reprocess_and_insights(spark, tmp_path):
    calls = PerKey(lambda body: {"size": F.length(body)}, over="docs", args={"body": "body"}, fingerprint=["body"])
    size = Node("size", "key string, size int, status string, fingerprint string", ("key",), calls)
    per = Node("per", "key string, n long", ("key",), Reduce("size", "key", {"count": "n"}))
    e = engine_of(spark, tmp_path, docs(), size, per)
    scan(e, [("a", "x", "1", 1), ("b", "yy", "2", 1)])
    e.drain()
    assert invalidate(e, "size", ["a"]) == ["a"] and invalidate(e, "per") == []
    report = jobs.reprocess(e, "size", keys=["a"])
    assert (report.step("size").claimed, report.step("size").meta["called"]) == (["a"], 1)
    assert jobs.reprocess(e, "size", where={"size": 2}).step("per").claimed == ["b"]
    assert jobs.reprocess(e, "size").step("size").meta["called"] == 2
    assert insights.levels(e.plan) == [["docs"], ["size"], ["per"]] and insights.edges(e.plan) == [("docs", "size"), ("size", "per")]
    status = {s["cell"]: s for s in insights.summary(e)}
    assert status["size"]["rows"] == "stored" and status["size"]["count"] == 2 and status["size"]["verdict"].status == "green"
    keys = lambda *a: [r.key for r in insights.keys_by_status(e, "size", *a).collect()]
    assert keys([None], 1) == ["a"] and keys([]) == [] and insights.key_count(e, "size") == 2
    assert insights.verdict_for(e, "size").status == "green"
    e.mark("per", ["a"], reason="by hand")
    assert [(p["cell"], p["reason"]) for p in insights.pending(e)] == [("per", "by hand")]


def test_config():
    assert len(jobs.Config(plan=3, around_poll=4, trace=-1).problems()) == 4
    with pytest.raises(ValueError, match="unknown"):
        jobs.Config.of({"rot": "x"})
    with pytest.raises(ValueError, match="no plan"):
        jobs.plan_of(jobs.Config(root="x"))
    assert jobs.plan_of(jobs.Config.of({"root": "x", "plan": lambda t: t}), 5) == 5


def test_micro_batches(spark, tmp_path):
    leaf = Node("docs", "key string, body string", leaf=True)
    e = engine_of(spark, tmp_path, leaf, Node("per", "key string, n long", ("key",), Reduce("docs", ("key", lambda: F.substring("body", 1, 1)), {"count": "n"})))
    handle = writes_of(e, "docs", deleted="gone")
    batch = lambda *rows: spark.createDataFrame(rows, "key string, body string, gone boolean, _order int")
    handle(batch(("a", "x", False, 1), ("a", "y", False, 2), ("b", "x", None, 1)), 0)
    handle(batch(("b", None, True, 1)), 1)
    handle(batch(("b", None, True, 1)), 1)  # delivered again
    assert sorted(map(tuple, e.table("per").collect())) == [("y", 1)] and e.is_clean()
