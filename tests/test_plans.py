import pytest

from sluice.plans.graph import build, cells_of, compile_cells, graph, validate_cells
from sluice.plans.model import CELL, Aggregate, Cell, Compose, Join, Lapse, Node, NodeError, PerKey, Poll, RecomputeBy, Reduce, Run, Side, Slice, Union, fold_items, group_items, snake
from sluice.sources import polling
from sluice.sources.polling import Source, crontab, poll_opts, resolve_args, scanners

LEAF = Node("rows", "key string, cat string, amount double", leaf=True, reads={"big": lambda r: r})
TOTALS = Node("totals", "cat string, total double, n long", ("cat",), Reduce("rows", "cat", {"sum": {"amount": "total"}, "count": "n"}))


class Feed(Source):
    def poll(self):
        return []


def one(**kw):
    return Node("x", kw.pop("columns", "cat string, total double, key string"), kw.pop("primary_key", ("cat",)), kw.pop("compute", Reduce("rows", "cat", {"sum": {"amount": "total"}})), **kw)


def test_depths_parents_and_context():
    c = lambda i, *inputs, **meta: Cell(i, "x", inputs, not inputs, meta)
    plan = build([c("a"), c("b", "a"), c("c", "a", "b"), c("d", "c", context=("b",)), c("e")])
    assert dict(plan.depths) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0}
    assert plan.parents["a"] == ("b", "c") and plan.parents["b"] == ("c",)
    assert plan.order == ["a", "e", "b", "c", "d"]
    cell = plan.cells["d"]
    assert cell["id"] == "d" and cell["context"] == ("b",) and cell["nothing"] is None
    with pytest.raises(TypeError):
        cell["id"] = 1
    for bad, word in (([c("a"), c("a")], "two cells"), ([c("a", "z")], "no node provides"), ([c("a", "b"), c("b", "a")], "cycle")):
        with pytest.raises(NodeError, match=word):
            build(bad)
    assert list(compile_cells([c("a"), Cell("a", "y")]).cells.values())[0].op == "x"
    assert validate_cells([c("a"), c("a"), c("b", "q")], lambda x: ["odd"] if x.id == "b" else []) == ["duplicate cell id 'a'", "'b' reads unknown 'q'", "odd"]


def test_deep_graphs_do_not_recurse():
    cells = [Cell("0", "x")] + [Cell(str(i), "x", (str(i - 1),)) for i in range(1, 3000)]
    assert build(reversed(cells)).depths["2999"] == 2999


def test_lowering():
    plan = graph([LEAF, Node("m", "cat string, n long", ("cat",), Reduce(folds={"count": "n"}), recompute_by=RecomputeBy("cat", from_="rows"))])
    assert plan.cells["m"].inputs == ("rows",) and group_items(plan.cells["m"].meta["node"].computation.group_by) == [("cat", "cat")]
    legs = Node("top", compose=(Compose("inner", (Compose("leaf", as_="deep"), Compose("leaf"))), Compose("other")), companion=True)
    ids = [c.id for c, _ in cells_of(legs)]
    assert ids == ["top/set/0/deep", "top/set/0/1", "top/set/0", "top/set/1", "top/set", "top"]
    many = Node("per", "cat string, n long", ("cat",), Reduce("rows", "cat", {"count": "n"}), for_each="towns")
    assert [c.id for c, _ in cells_of(many, lambda kind: ["a", "b"])] == ["per.a", "per.b"] and cells_of(many) == []
    assert cells_of(many, lambda kind: ["a"])[0][0]["member"] == "a"
    assert snake("MyApp.HTTPNode") == "http_node" and snake("FundBalance") == "fund_balance"
    assert fold_items({"sum": ["a"], "min": {"b": "c"}, "max": "d", "count": "n"}) == [("sum", "a", "a"), ("min", "b", "c"), ("max", "d", "d"), ("count", None, "n")]


@pytest.mark.parametrize(
    ("node", "word"),
    [
        (one(columns=None), "no columns"),
        (one(compute=[Reduce("rows", "cat", {"count": "n"}), Run(print)]), "more than one computation"),
        (one(compute=None), "no computation"),
        (one(primary_key=("nope",)), "primary key column"),
        (one(compare=[]), "compare is empty"),
        (one(compare=["zz"]), "compare names unknown"),
        (one(fingerprint=["zz"]), "fingerprint names unknown"),
        (one(fingerprint=["cat"]), "needs a column 'fingerprint'"),
        (one(fingerprint_attribute="total"), "nothing fills"),
        (one(augmented_by=("zz",)), "augmented_by names unknown"),
        (one(augmented_by=("total",)), "never end"),
        (one(lapses=(Lapse("key", over="cat"),)), "needs recompute_by"),
        (one(lapses=(Lapse("key", ["zz"]),)), "unknown column 'zz'"),
        (one(lapses=(Lapse("key", []),)), "when_changed"),
        (one(key_rule="all", recompute_by=RecomputeBy("cat")), "both recompute_by and a key rule"),
        (one(retain_if_vanished="maybe"), "retain_if_vanished"),
        (one(depends_on="rows"), "depends_on"),
        (one(compute=Reduce("rows", "cat")), "needs folds, into or expand"),
        (one(compute=Reduce("rows", "cat", {"count": "key"}, into=dict)), "more than one of"),
        (one(compute=Reduce("rows", None, {"count": "key"})), "no group"),
        (one(compute=Reduce("rows", "cat", {"median": "n"})), "unknown fold"),
        (one(compute=Reduce("rows", "cat", {"sum": 3})), "takes a column"),
        (one(compute=Reduce("rows", "cat", {"sum": {"amount": "zz"}})), "unknown column 'zz'"),
        (one(compute=Reduce("rows", "cat", {"sum": {"amount": "total"}}, key=print, key_prefix="p")), "key function and a key prefix"),
        (one(primary_key=("cat", "key")), "identity column 'key'"),
        (one(compute=Reduce("rows", folds={"sum": {"amount": "total"}}), recompute_by=RecomputeBy(CELL)), "no group"),
        (one(compute=Reduce("rows", folds={"sum": {"amount": "total"}}), recompute_by=RecomputeBy(["cat"], to="x")), "composite unit takes neither"),
        (one(compute=Reduce("rows", folds={"sum": {"amount": "total"}}), recompute_by=RecomputeBy([])), "composite unit is a list"),
        (one(compute=Reduce("rows", "cat", {"sum": {"amount": "total"}}), recompute_by=RecomputeBy("cat", from_="other")), "named twice"),
        (one(compute=Reduce("rows", "cat", {"sum": {"amount": "total"}}), recompute_by=RecomputeBy(CELL, from_key="month")), "from_key with the whole cell"),
        (one(compute=Join(Side("cat"), Side("cat"), {})), "join has no input"),
        (one(compute=Join(Side("cat"), Side("cat"), {}, left_over="rows")), "one side only"),
        (one(compute=Join(Side("cat"), Side("cat"), {}, over="rows", left_over="rows", right_over="rows")), "one input and an input"),
        (one(compute=Join(Side(None), Side("cat"), {}, over="rows")), "left side has no key"),
        (one(compute=Join(Side("cat", ["x"]), Side("cat"), {}, over="rows")), "where takes"),
        (one(compute=Join(Side("cat"), Side("cat"), {"middle": []}, over="rows")), "only left and right"),
        (one(compute=Join(Side("cat"), Side("cat"), {"left": {"amount": "zz"}}, over="rows")), "join writes unknown"),
        (one(compute=Union([], {})), "union has no inputs"),
        (one(compute=Union(["rows"], {"zz": "key"})), "union writes unknown"),
        (one(compute=Aggregate("rows", "cat"), refs=("rows",)), "no folds"),
        (one(compute=Aggregate("rows", "cat", {"count": "zz"}), refs=("rows",)), "aggregate writes unknown"),
        (one(compute=Aggregate("rows", "cat", {"sum": {"amount": "total"}})), "has no edge"),
        (one(compute=PerKey(print, over="rows", fingerprint=["cat"])), "per_key's fingerprint"),
        (one(compute=PerKey("act", over="rows")), "no function"),
        (one(compute=PerKey(print, over="rows", into={"zz": "a"})), "per_key writes unknown"),
        (one(compute=PerKey(print)), "per_key has no input"),
        (one(compute=Run("act")), "run's action"),
        (one(compute=Reduce("gone", "cat", {"sum": {"amount": "total"}})), "no node provides"),
        (one(compute=Reduce("rows", "zz", {"sum": {"amount": "total"}})), "neither a column nor a calculation"),
        (one(compute=Reduce("rows", "cat", {"sum": {"amount": "total"}}, read="small")), "has no read"),
        (one(compute=Join(Side("zz"), Side("cat"), {}, over="rows")), "side key 'zz'"),
        (one(compute=Union(["rows"], {"total": "zz"})), "has no column 'zz'"),
        (one(slices=(Slice("zz"),)), "slice of unknown column"),
        (one(slices=(Slice("cat", poll_as="c"),)), "not polled"),
        (one(lapses=(Lapse("nobody"),)), "neither an own column nor a node"),
        (one(lapses=(Lapse("rows"),)), "needs key="),
        (one(poll=Poll(Feed())), "polled or computed"),
        (Node("feed", "key string", leaf=True, poll=Poll("nothing")), "no source"),
    ],
)
def test_errors(node, word):
    with pytest.raises(NodeError, match=word):
        graph([LEAF, node])


def test_one_scanner_a_source():
    feed = lambda i: Node(i, "key string", leaf=True, poll=Poll(Feed()))
    with pytest.raises(NodeError, match="polls both"):
        graph([feed("a"), feed("b")])


def test_schedules():
    class Other(Feed):
        pass

    a = Node("a", "key string, town string", leaf=True, poll=Poll(Feed(), {"since": lambda: 5, "keep": len}, every="1h"), slices=(Slice("town", lambda: ["x", "y"], poll_as="towns"),))
    b = Node("b", "key string", leaf=True, poll=Poll(Other(), every="1h"))
    plan = graph([a, b, LEAF])
    assert scanners(plan) == ["a", "b"] and scanners(plan, lambda c: [-ord(x) for x in c]) == ["b", "a"]
    assert crontab(plan) == [("1h", {"sweep": True, "every": "1h"})]
    assert crontab(plan, per_cell=True, args={"cell": "z", "q": 1}) == [("1h", {"cell": "a", "q": 1}), ("1h", {"cell": "b", "q": 1})]
    assert crontab(graph([b], tenant="t1")) == [("1h", {"sweep": True, "every": "1h", "tenant": "t1"})]
    assert resolve_args({"since": lambda: 5, "keep": len, "n": 3}) == {"since": 5, "keep": len, "n": 3}
    assert poll_opts(plan, "a", {"town": "x", "other": 1}) == {"towns": "x"}
    assert polling.slices(plan, "a")[0]["values"] == ["x", "y"]
    assert [c["cell"] for c in polling.controls(plan)] == ["a", "b"]
    assert polling.scan_jobs(plan) == [{"cell": "a"}, {"cell": "b"}]
    assert set(polling.standing_args(plan, "a")) == {"since", "keep"}
    assert polling.cells_of(plan, a.poll.source) == ["a"]
