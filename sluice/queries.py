"""One query for each operator: seed, change, drain again, and return the maintained table.

The change is the same everywhere: rows whose id is divisible by 10 arrive late, those by 7 are updated, those by 13 are deleted.
The SQL beside each query computes the table from the final rows at once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions.calendar import Bucket
from .functions.keys import basis_column, fingerprint
from .insights import status_histogram, verdict_columns
from .jobs import reprocess
from .plans.model import Aggregate, Join, Lapse, Node, PerKey, Poll, RecomputeBy, Reduce, Run, Side, Union
from .runtime.engine import Engine
from .sources.polling import Source, refresh
from .sources.reconcile import reconcile
from .streaming import writes_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def state_root(spark: SparkSession) -> str:
    """A new state folder under the shared folder that the cluster names, or a local one where it names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    return f"{shared.rstrip('/')}/state-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="sluice-state-")


def engine_of(spark: SparkSession, *nodes: Node, **options) -> Engine:
    return Engine(spark, nodes, state_root(spark), trace=0, **options)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def orders(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_date"), "o_orderpriority", cents("o_totalprice").alias("cents"))


ORDERS = "o_orderkey long, o_custkey long, o_date date, o_orderpriority string, cents long"
#: the final rows of orders, in SQL
ORDERS_SQL = """(select o_orderkey, o_custkey, cast(o_orderdate as date) as o_date, o_orderpriority,
  cast(round(o_totalprice * 100) as bigint) + case when o_orderkey % 7 = 0 then 1000 else 0 end as cents
  from orders where o_orderkey % 13 <> 0)"""


def lineitem(spark, sf_dir) -> DataFrame:
    """Order and line number do not identify a line here: lines that share them are numbered by their other columns."""
    raw = load(spark, sf_dir, "lineitem")
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*(c for c in raw.columns if c not in ("l_orderkey", "l_linenumber")))
    return raw.withColumn("dup", F.row_number().over(same)).select("l_orderkey", "l_linenumber", "dup", "l_suppkey", F.col("l_quantity").cast("long").alias("qty"), cents("l_extendedprice").alias("cents"), "l_returnflag", "l_linestatus")


LINEITEM = "l_orderkey long, l_linenumber int, dup int, l_suppkey long, qty long, cents long, l_returnflag string, l_linestatus string"
LINEITEM_SQL = """(select l_orderkey, l_suppkey, l_returnflag, l_linestatus, cast(l_quantity as bigint) as qty,
  cast(round(l_extendedprice * 100) as bigint) + case when l_orderkey % 7 = 0 then 1000 else 0 end as cents
  from lineitem where l_orderkey % 13 <> 0)"""

LINES = Node("lines", LINEITEM, ("l_orderkey", "l_linenumber", "dup"), leaf=True)
ORDER_LEAF = Node("orders", ORDERS, ("o_orderkey",), leaf=True, calculations={k: Bucket(k, "o_date") for k in ("month", "quarter", "year")})


def apply_changes(engine: Engine, leaf: str, rows: DataFrame, pk: str, update: dict | None = None, drain: bool = True) -> None:
    """The two rounds of writes to a leaf, each drained."""
    keep = F.col(pk) % 13 != 0
    changed = rows.withColumns({c: F.when(F.col(pk) % 7 == 0, e).otherwise(F.col(c)) for c, e in (update or {}).items()})
    engine.write(leaf, rows.where(F.col(pk) % 10 != 0))
    if drain:
        engine.drain()
    node = engine.node(leaf)
    late = (F.col(pk) % 10 == 0) | (F.col(pk) % 7 == 0 if update else F.lit(False))
    engine.write(leaf, changed.where(keep & late), rows.where(~keep).select(*node.primary_key))
    if drain:
        engine.drain()


def maintained(spark, sf_dir, nodes: list[Node], out: str | None = None) -> DataFrame:
    """Tables over orders or lines, whose cents the update raises."""
    engine = engine_of(spark, *nodes)
    if "orders" in engine.plan.cells:
        apply_changes(engine, "orders", orders(spark, sf_dir), "o_orderkey", {"cents": F.col("cents") + 1000})
    if "lines" in engine.plan.cells:
        apply_changes(engine, "lines", lineitem(spark, sf_dir), "l_orderkey", {"cents": F.col("cents") + 1000})
    return engine.table(out or nodes[-1].id)


# -- folds --------------------------------------------------------------------------------------


@query(f"""select l_returnflag, l_linestatus, count(*) as n, cast(sum(qty) as bigint) as qty, cast(sum(cents) as bigint) as cents,
  cast(sum(qty) as double) / count(*) as avg_qty from {LINEITEM_SQL} group by 1, 2""")
def reduce_group_folds(spark, sf_dir):
    totals = Node("totals", "l_returnflag string, l_linestatus string, n long, qty long, cents long, avg_qty double", ("l_returnflag", "l_linestatus"), Reduce("lines", ["l_returnflag", "l_linestatus"], {"count": "n", "sum": ["qty", "cents"], "avg": {"qty": "avg_qty"}}))
    return maintained(spark, sf_dir, [LINES, totals])


@query(f"""select o_custkey, min(cents) as low, max(cents) as high, cast(min(o_date) as varchar) as since, arg_min(o_orderpriority, o_orderkey) as first_priority
  from {ORDERS_SQL} group by 1""")
def reduce_min_max_first(spark, sf_dir):
    per = Node("per", "o_custkey long, low long, high long, since date, first_priority string", ("o_custkey",), Reduce("orders", "o_custkey", {"min": {"cents": "low", "o_date": "since"}, "max": {"cents": "high"}, "first": {"o_orderpriority": "first_priority"}}))
    return maintained(spark, sf_dir, [ORDER_LEAF, per]).withColumn("since", F.col("since").cast("string"))


@query(f"select l_suppkey as supplier, l_returnflag as flag, count(*) as n, cast(sum(cents) as bigint) as cents from {LINEITEM_SQL} group by 1, 2")
def reduce_composite_identity(spark, sf_dir):
    per = Node("per", "supplier long, flag string, n long, cents long", ("supplier", "flag"), Reduce(folds={"count": "n", "sum": ["cents"]}), recompute_by=RecomputeBy({"supplier": "l_suppkey", "flag": "l_returnflag"}, from_="lines"))
    return maintained(spark, sf_dir, [LINES, per])


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", cents("value").alias("cents"))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, cents long"
EVENTS_SQL = """(select event_id, ts, user_id, event_type, cast(round(value * 100) as bigint) + case when event_id % 7 = 0 then 1000 else 0 end as cents
  from events where event_id % 13 <> 0)"""
EVENT_LEAF = Node("events", EVENTS, ("event_id",), leaf=True, calculations={k: Bucket(k, "ts") for k in ("day", "week", "month", "quarter", "year")})
_LABEL_SQL = {
    "day": "strftime(ts, '%Y-%m-%d')", "week": "strftime(ts, '%G-W%V')", "month": "strftime(ts, '%Y-%m')",
    "quarter": "strftime(ts, '%Y') || '-Q' || quarter(ts)", "year": "strftime(ts, '%Y')",
}


def on_events(spark, sf_dir, *nodes: Node, out: str | None = None) -> DataFrame:
    engine = engine_of(spark, EVENT_LEAF, *nodes)
    apply_changes(engine, "events", _events(spark, sf_dir), "event_id", {"cents": F.col("cents") + 1000})
    return engine.table(out or nodes[-1].id)


def _calendar(kind: str):
    @query(f"select {_LABEL_SQL[kind]} as label, count(*) as n, cast(sum(cents) as bigint) as cents from {EVENTS_SQL} group by 1", f"reduce_calendar_{kind}")
    def run(spark, sf_dir):
        per = Node("per", "label string, n long, cents long", ("label",), Reduce(folds={"count": "n", "sum": ["cents"]}), recompute_by=RecomputeBy(kind, to="label", from_="events"))
        return on_events(spark, sf_dir, per)

    return run


for _kind in _LABEL_SQL:
    _calendar(_kind)


@query(f"""select strftime(o_date, '%Y') as year, count(*) as months, cast(sum(cents) as bigint) as cents from
  (select strftime(o_date, '%Y-%m') as m, min(o_date) as o_date, sum(cents) as cents from {ORDERS_SQL} group by 1) group by 1""")
def reduce_from_key(spark, sf_dir):
    months = Node("months", "month string, cents long", ("month",), Reduce(folds={"sum": ["cents"]}), recompute_by=RecomputeBy("month", from_="orders"))
    years = Node("years", "year string, months long, cents long", ("year",), Reduce(folds={"count": "months", "sum": ["cents"]}), recompute_by=RecomputeBy("year", from_="months", from_key="year"))
    return maintained(spark, sf_dir, [ORDER_LEAF, months, years])


@query("""select case when o_orderkey % 7 = 0 then '9-MOVED' else o_orderpriority end as priority, count(*) as n,
  cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from orders where o_orderkey % 13 <> 0 group by 1""")
def reduce_move_between_units(spark, sf_dir):
    per = Node("per", "priority string, n long, cents long", ("priority",), Reduce("orders", ("priority", "o_orderpriority"), {"count": "n", "sum": ["cents"]}))
    engine = engine_of(spark, ORDER_LEAF, per)
    apply_changes(engine, "orders", orders(spark, sf_dir), "o_orderkey", {"o_orderpriority": F.lit("9-MOVED")})
    return engine.table("per")


CUSTOMERS = Node("customers", "c_custkey long, c_nationkey int, segment string, cents long", ("c_custkey",), leaf=True)


def _customers(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"), cents("c_acctbal").alias("cents"))


@query("""select c_mktsegment as segment, count(*) as n, cast(sum(cast(round(c_acctbal * 100) as bigint)) as bigint) as cents from customer
  where c_mktsegment <> 'BUILDING' group by 1""")
def reduce_delete_retires(spark, sf_dir):
    per = Node("per", "segment string, n long, cents long", ("segment",), Reduce("customers", "segment", {"count": "n", "sum": ["cents"]}))
    engine, rows = engine_of(spark, CUSTOMERS, per), _customers(spark, sf_dir)
    engine.write("customers", rows)
    engine.drain()
    engine.write("customers", deletes=rows.where("segment = 'BUILDING'").select("c_custkey"))
    engine.drain()
    return engine.table("per")


@query(f"select 'prio|' || o_orderpriority as key, count(*) as n from {ORDERS_SQL} group by 1")
def reduce_key_prefix(spark, sf_dir):
    per = Node("per", "key string, n long", ("key",), Reduce("orders", ("priority", "o_orderpriority"), {"count": "n"}, key_prefix="prio"))
    return maintained(spark, sf_dir, [ORDER_LEAF, per])


@query(f"select o_custkey, count(*) as n, cast(sum(cents) as bigint) as cents from {ORDERS_SQL} where o_orderpriority = '1-URGENT' group by 1")
def reduce_named_read(spark, sf_dir):
    from dataclasses import replace

    leaf = replace(ORDER_LEAF, reads={"urgent": lambda rows: rows.where("o_orderpriority = '1-URGENT'")})
    per = Node("per", "o_custkey long, n long, cents long", ("o_custkey",), Reduce("orders", "o_custkey", {"count": "n", "sum": ["cents"]}, read="urgent"))
    return maintained(spark, sf_dir, [leaf, per])


@query(f"select o_custkey, count(*) as n, cast(sum(cents) as bigint) as cents from {ORDERS_SQL} where cents > 5000000 group by 1")
def reduce_query_shape(spark, sf_dir):
    per = Node("per", "o_custkey long, n long, cents long", ("o_custkey",), Reduce("orders", "o_custkey", {"count": "n", "sum": ["cents"]}, query=lambda rows, claimed: rows.where("cents > 5000000")))
    return maintained(spark, sf_dir, [ORDER_LEAF, per])


@query(f"select o_custkey, cast(max(cents) - min(cents) as bigint) as spread, count(distinct o_orderpriority) as kinds from {ORDERS_SQL} group by 1")
def reduce_into_function(spark, sf_dir):
    per = Node("per", "o_custkey long, spread long, kinds long", ("o_custkey",), Reduce("orders", "o_custkey", into=lambda: {"spread": F.max("cents") - F.min("cents"), "kinds": F.count_distinct("o_orderpriority")}))
    return maintained(spark, sf_dir, [ORDER_LEAF, per])


def _by_type(rows, group):
    made = rows.groupBy(*group, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return made.withColumn("key", F.concat_ws("|", *group, "event_type"))


@query(f"select {_LABEL_SQL['day']} || '|' || event_type as key, {_LABEL_SQL['day']} as day, event_type, count(*) as n, cast(sum(cents) as bigint) as cents from {EVENTS_SQL} group by 1, 2, 3")
def expand_buckets(spark, sf_dir):
    per = Node("per", "key string, day string, event_type string, n long, cents long", ("key",), Reduce("events", "day", expand=_by_type))
    return on_events(spark, sf_dir, per)


@query(f"""select {_LABEL_SQL['month']} || '|' || event_type as key, {_LABEL_SQL['month']} as month, event_type, count(*) as n, cast(sum(cents) as bigint) as cents
  from {EVENTS_SQL} where event_type <> 'error' group by 1, 2, 3""")
def expand_skip(spark, sf_dir):
    per = Node("per", "key string, month string, event_type string, n long, cents long", ("key",), Reduce("events", "month", expand=lambda rows, group: _by_type(rows, group).withColumn("__skip", F.col("event_type") == "error")))
    return on_events(spark, sf_dir, per)


# -- joins, relations, unions -----------------------------------------------------------------------

_VIEWS = Join(Side("user_id", {"event_type": "click"}), Side("user_id", {"event_type": "view"}), {"left": {"cents": "click"}, "right": {"cents": "view"}}, over="events")
_SIDES_SQL = f"""with c as (select user_id, arg_max(cents, event_id) as click from {EVENTS_SQL} where event_type = 'click' group by 1),
  v as (select user_id, arg_max(cents, event_id) as view from {EVENTS_SQL} where event_type = 'view' group by 1)
  select 'u|' || cast(KEY as varchar) as key, click, view from c KIND join v on c.user_id = v.user_id"""


@query(_SIDES_SQL.replace("KEY", "c.user_id").replace("KIND", "left"))
def join_one_input_left(spark, sf_dir):
    from dataclasses import replace

    return on_events(spark, sf_dir, Node("per", "key string, click long, view long", ("key",), replace(_VIEWS, key_prefix="u")))


@query(_SIDES_SQL.replace("KEY", "coalesce(c.user_id, v.user_id)").replace("KIND", "full"))
def join_one_input_outer(spark, sf_dir):
    from dataclasses import replace

    return on_events(spark, sf_dir, Node("per", "key string, click long, view long", ("key",), replace(_VIEWS, key_prefix="u", outer=True)))


_LINE_TOTALS = Node("line_totals", "l_orderkey long, qty long, cents long", ("l_orderkey",), Reduce("lines", "l_orderkey", {"sum": ["qty", "cents"]}))
_TWO_SQL = f"""select cast(coalesce(o.o_orderkey, l.l_orderkey) as varchar) as key, o.cents as order_cents, l.cents as line_cents
  from {ORDERS_SQL} o KIND join (select l_orderkey, cast(sum(cents) as bigint) as cents from {LINEITEM_SQL} group by 1) l on o.o_orderkey = l.l_orderkey"""


def _two(outer: bool) -> list[Node]:
    join = Join(Side("o_orderkey"), Side("l_orderkey"), {"left": {"cents": "order_cents"}, "right": {"cents": "line_cents"}}, left_over="orders", right_over="line_totals", outer=outer)
    return [ORDER_LEAF, LINES, _LINE_TOTALS, Node("both", "key string, order_cents long, line_cents long", ("key",), join)]


@query(_TWO_SQL.replace("KIND", "left"))
def join_two_node(spark, sf_dir):
    return maintained(spark, sf_dir, _two(False))


SUPPLIERS = Node("suppliers", "s_suppkey long, s_nationkey int, cents long", ("s_suppkey",), leaf=True)


def _suppliers(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", cents("s_acctbal").alias("cents"))


@query("""with c as (select c_nationkey as k, count(*) as n from customer where c_custkey % 13 <> 0 and c_nationkey < 20 group by 1),
  s as (select s_nationkey as k, count(*) as n from supplier where s_suppkey % 13 <> 0 and s_nationkey > 5 group by 1)
  select cast(coalesce(c.k, s.k) as varchar) as key, c.n as customers, s.n as suppliers from c full join s on c.k = s.k""")
def join_two_node_outer(spark, sf_dir):
    per_c = Node("per_c", "c_nationkey int, n long", ("c_nationkey",), Reduce("customers", "c_nationkey", {"count": "n"}))
    per_s = Node("per_s", "s_nationkey int, n long", ("s_nationkey",), Reduce("suppliers", "s_nationkey", {"count": "n"}))
    both = Node("both", "key string, customers long, suppliers long", ("key",), Join(Side("c_nationkey"), Side("s_nationkey"), {"left": {"n": "customers"}, "right": {"n": "suppliers"}}, left_over="per_c", right_over="per_s", outer=True))
    engine = engine_of(spark, CUSTOMERS, SUPPLIERS, per_c, per_s, both)
    apply_changes(engine, "customers", _customers(spark, sf_dir).where("c_nationkey < 20"), "c_custkey")
    apply_changes(engine, "suppliers", _suppliers(spark, sf_dir).where("s_nationkey > 5"), "s_suppkey")
    return engine.table("both")


@query(f"""with e as (select *, event_id as k from {EVENTS_SQL}),
  l as (select user_id, arg_max(cents, k) as cents from e where event_type = 'purchase' group by 1), r as (select user_id, arg_max(cents, k) as cents from e where event_type = 'signup' group by 1)
  select cast(l.user_id as varchar) as key, l.cents + coalesce(r.cents, 0) as both_cents from l left join r on l.user_id = r.user_id""")
def join_duplicate_last_wins(spark, sf_dir):
    made = Join(Side("user_id", {"event_type": "purchase"}), Side(lambda: F.when(F.col("event_type") == "signup", F.col("user_id"))), lambda key, left, right: {"both_cents": left("cents") + F.coalesce(right("cents"), F.lit(0))}, over="events")
    return on_events(spark, sf_dir, Node("per", "key string, both_cents long", ("key",), made))


@query(f"""select c_custkey, c_name as name, count(o.o_orderkey) as n, cast(sum(o.cents) as bigint) as cents, cast(max(o.o_date) as varchar) as latest
  from customer left join {ORDERS_SQL} o on c_custkey = o.o_custkey group by 1, 2""")
def aggregate_relationship(spark, sf_dir):
    per = Node("per", "c_custkey long, name string, n long, cents long, latest date", ("c_custkey",), Aggregate("orders", "o_custkey", {"count": "n", "sum": ["cents"], "max": {"o_date": "latest"}}), refs=("orders",))
    engine = engine_of(spark, ORDER_LEAF, per)
    engine.write("per", load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")))
    apply_changes(engine, "orders", orders(spark, sf_dir), "o_orderkey", {"cents": F.col("cents") + 1000})
    return engine.table("per").withColumn("latest", F.col("latest").cast("string"))


def _health(over: str, column: str, key: str, limit: int):
    return Node(f"{over}_health", f"{key} long, status string, amount long", (key,), Reduce(over, key, into=lambda: {"status": F.when(F.max(column) > limit, "failing").otherwise("present"), "amount": F.max(column).cast("long")}))


PARTS = Node("parts", "p_partkey long, p_size int", ("p_partkey",), leaf=True)


@query("""select 'parts_health|' || cast(p_partkey as varchar) as check_key, 'parts_health' as input, case when p_size > 25 then 'failing' else 'present' end as status from part where p_partkey % 13 <> 0
  union all select 'suppliers_health|' || cast(s_suppkey as varchar), 'suppliers_health', case when round(s_acctbal * 100) + (case when s_suppkey % 7 = 0 then 100000 else 0 end) > 500000 then 'failing' else 'present' end from supplier where s_suppkey % 13 <> 0""")
def union_verdicts(spark, sf_dir):
    every = Node("every", "check_key string, input string, status string", ("check_key",), Union(["parts_health", "suppliers_health"], {"input": "cell", "status": "status"}))
    engine = engine_of(spark, PARTS, SUPPLIERS, _health("parts", "p_size", "p_partkey", 25), _health("suppliers", "cents", "s_suppkey", 500_000), every)
    apply_changes(engine, "parts", load(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    apply_changes(engine, "suppliers", _suppliers(spark, sf_dir), "s_suppkey", {"cents": F.col("cents") + 100_000})
    return engine.table("every")


# -- calls --------------------------------------------------------------------------------------------

DOCS = Node("docs", "doc_id long, text string, lang string", ("doc_id",), leaf=True)
DOCS_SQL = "(select doc_id, case when doc_id % 7 = 0 then lang || ': ' || text else text end as text, lang from documents where doc_id % 13 <> 0)"


def on_docs(spark, sf_dir, node: Node) -> DataFrame:
    engine = engine_of(spark, DOCS, node)
    apply_changes(engine, "docs", load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", {"text": F.concat("lang", F.lit(": "), "text")})
    return engine.table(node.id)


@query(f"select doc_id, length(text) as chars, cast(len(string_split(text, ' ')) as integer) as words from {DOCS_SQL}")
def per_key_fingerprint(spark, sf_dir):
    call = PerKey(lambda body: {"c": F.length(body), "w": F.size(F.split(body, " "))}, over="docs", args={"body": "text"}, into={"chars": "c", "words": "w"}, fingerprint=["text"])
    out = on_docs(spark, sf_dir, Node("stats", "doc_id long, chars long, words int, fingerprint string", ("doc_id",), call))
    return out.select("doc_id", "chars", "words")


@query(f"select doc_id, cast(len(text) - len(replace(text, 'e', '')) as bigint) as e_count from {DOCS_SQL}")
def per_key_pandas(spark, sf_dir):
    call = PerKey(lambda pdf: pdf.assign(e=pdf["text"].str.count("e"))[["e"]], over="docs", args={"text": "text"}, into={"e_count": "e"}, returns="e long", fingerprint=["text"], max_concurrency=4, timeout=600)
    out = on_docs(spark, sf_dir, Node("stats", "doc_id long, e_count long, fingerprint string", ("doc_id",), call))
    return out.select("doc_id", "e_count")


@query("select vec_id, len(embedding) as dim, list_max(embedding) as peak from embeddings where vec_id % 13 <> 0")
def per_key_embedding(spark, sf_dir):
    leaf = Node("vectors", "vec_id long, embedding array<float>", ("vec_id",), leaf=True)
    call = PerKey(lambda embedding: {"dim": F.size(embedding).cast("long"), "peak": F.array_max(embedding)}, over="vectors", args={"embedding": "embedding"}, fingerprint=["embedding"])
    stats = Node("stats", "vec_id long, dim long, peak float, fingerprint string", ("vec_id",), call)
    engine = engine_of(spark, leaf, stats)
    apply_changes(engine, "vectors", load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return engine.table("stats").select("vec_id", "dim", "peak")


@query("select o_custkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from orders where o_orderkey % 13 <> 0 group by 1")
def run_action(spark, sf_dir):
    def refold(engine, claims):
        rows = claims.scope(engine.rows("orders").withColumn("__unit", F.col("o_custkey").cast("string")))
        return rows.groupBy("o_custkey").agg(F.sum("cents").alias("cents"))

    per = Node("per", "o_custkey long, cents long", ("o_custkey",), Run(refold), refs=("orders",), key_rule=lambda child, images, node: images.select(F.col("o_custkey").cast("string").alias("key")))
    engine = engine_of(spark, ORDER_LEAF, per)
    apply_changes(engine, "orders", orders(spark, sf_dir), "o_orderkey")
    gone = engine.table("per").join(engine.table("orders"), "o_custkey", "left_anti")
    engine.write("per", deletes=gone)  # a function that writes for itself also retires for itself
    return engine.table("per")


# -- change detection and reconciliation -----------------------------------------------------------


@query("select lang, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents where doc_id % 13 <> 0 group by 1")
def compare_suppresses(spark, sf_dir):
    leaf = Node("docs", "doc_id long, lang string, chars long, ordinal long", ("doc_id",), leaf=True)
    seen = Node("seen", "doc_id long, lang string, chars long, ordinal long", ("doc_id",), Reduce("docs", "doc_id", {"first": ["lang", "chars", "ordinal"]}), compare=["lang", "chars"])
    per = Node("per", "lang string, n long, chars long", ("lang",), Reduce("seen", "lang", {"count": "n", "sum": ["chars"]}))
    engine = engine_of(spark, leaf, seen, per)
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("chars"), F.lit(0).cast("long").alias("ordinal"))
    apply_changes(engine, "docs", rows, "doc_id", {"ordinal": F.col("doc_id")})
    return engine.table("per")


@query("select lang, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents group by 1")
def leaf_fingerprint(spark, sf_dir):
    leaf = Node("docs", "doc_id long, lang string, chars long, md5 string, seen_at long, fingerprint string", ("doc_id",), leaf=True, fingerprint=["md5"])
    per = Node("per", "lang string, n long, chars long", ("lang",), Reduce("docs", "lang", {"count": "n", "sum": ["chars"]}))
    engine = engine_of(spark, leaf, per)
    scan = load(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("chars"), F.md5("text").alias("md5"))
    reconcile(engine, "docs", scan.withColumn("seen_at", F.lit(1).cast("long")))
    engine.drain()
    again = reconcile(engine, "docs", scan.withColumn("seen_at", F.lit(2).cast("long")))
    if again.counts["updated"] or engine.drain().steps:
        raise AssertionError("a scan that moved only bookkeeping was reported")
    return engine.table("per")


SCANNED = "s_suppkey long, cents long, status string"


def _scans(spark, sf_dir):
    first = _suppliers(spark, sf_dir).select("s_suppkey", "cents", F.lit("live").alias("status"))
    second = first.where("s_suppkey % 13 <> 0").withColumn("cents", F.when(F.col("s_suppkey") % 7 == 0, F.col("cents") + 1000).otherwise(F.col("cents")))
    return first.where("s_suppkey % 10 <> 0"), second


def _reconciled(spark, sf_dir, **options):
    node = Node("scan", SCANNED, ("s_suppkey",), leaf=True, **options.pop("node", {}))
    engine = engine_of(spark, node)
    first, second = _scans(spark, sf_dir)
    reconcile(engine, "scan", first)
    reconcile(engine, "scan", second, **options)
    return engine, second


_BASE_SQL = "cast(round(s_acctbal * 100) as bigint)"
_NEW_SQL = f"{_BASE_SQL} + case when s_suppkey % 7 = 0 then 1000 else 0 end"
_KEPT_SQL = f"case when s_suppkey % 13 <> 0 then {_NEW_SQL} else {_BASE_SQL} end"


@query(f"select s_suppkey, {_NEW_SQL} as cents, 'live' as status from supplier where s_suppkey % 13 <> 0")
def reconcile_all(spark, sf_dir):
    return _reconciled(spark, sf_dir)[0].table("scan")


@query(f"select s_suppkey, {_KEPT_SQL} as cents, 'live' as status from supplier where s_suppkey % 13 <> 0 or s_suppkey % 10 <> 0")
def reconcile_partial(spark, sf_dir):
    return _reconciled(spark, sf_dir, observed="partial")[0].table("scan")


@query(f"select s_suppkey, {_KEPT_SQL} as cents, 'live' as status from supplier where s_suppkey % 13 <> 0 or s_suppkey % 10 <> 0")
def reconcile_keep(spark, sf_dir):
    return _reconciled(spark, sf_dir, node={"retain_if_vanished": True})[0].table("scan")


def _tombstone(rows):
    return rows.select("s_suppkey", F.lit("gone").alias("status"))


_MARKING = {"retain_if_vanished": _tombstone, "live": lambda: F.col("status") != "gone"}


@query(f"""select s_suppkey, {_KEPT_SQL} as cents, case when s_suppkey % 13 <> 0 then 'live' else 'gone' end as status
  from supplier where s_suppkey % 13 <> 0 or s_suppkey % 10 <> 0""")
def reconcile_mark(spark, sf_dir):
    return _reconciled(spark, sf_dir, node=_MARKING)[0].table("scan")


@query("""select 'created' as kind, count(*) filter (where s_suppkey % 13 = 0 and s_suppkey % 10 = 0) as n from supplier
  union all select 'revived', count(*) filter (where s_suppkey % 13 = 0 and s_suppkey % 10 <> 0) from supplier""")
def reconcile_revived(spark, sf_dir):
    engine, second = _reconciled(spark, sf_dir, node=_MARKING)
    whole = _suppliers(spark, sf_dir).select("s_suppkey", "cents").where("s_suppkey % 13 = 0").unionByName(second.select("s_suppkey", "cents"))
    counts = reconcile(engine, "scan", whole).counts
    return spark.createDataFrame([(k, counts[k]) for k in ("created", "revived")], "kind string, n long")


@query(f"select s_nationkey, count(*) as n, cast(sum({_NEW_SQL}) as bigint) as cents from supplier where s_suppkey % 13 <> 0 group by 1")
def source_refresh(spark, sf_dir):
    class Suppliers(Source):
        def poll(self, engine, cell, part):
            rows = _suppliers(spark, sf_dir)
            if part == "first":
                return reconcile(engine, cell, rows.where("s_suppkey % 10 <> 0"))
            return reconcile(engine, cell, rows.where("s_suppkey % 13 <> 0").withColumn("cents", F.when(F.col("s_suppkey") % 7 == 0, F.col("cents") + 1000).otherwise(F.col("cents"))))

    leaf = Node("suppliers", "s_suppkey long, s_nationkey int, cents long", ("s_suppkey",), leaf=True, poll=Poll(Suppliers(), {"part": "first"}))
    per = Node("per", "s_nationkey int, n long, cents long", ("s_nationkey",), Reduce("suppliers", "s_nationkey", {"count": "n", "sum": ["cents"]}))
    engine = engine_of(spark, leaf, per)
    for part in ("first", "second"):
        result = refresh(engine, "suppliers", part=part)
        if result.error:
            raise result.error
        engine.drain()
    return engine.table("per")


# -- human marks ------------------------------------------------------------------------------------


def _lapsing(spark, sf_dir, lapses, columns: str, second=None, more: tuple = (), primary=("year",), group=("year", "year"), mark_rows=None):
    years = Node("years", columns, primary, Reduce("orders", [group] if isinstance(group, tuple) else group, {"count": "n", "sum": ["cents"]}), lapses=lapses, augmented_by=("approved",), recompute_by=None)
    engine, rows = engine_of(spark, ORDER_LEAF, years, *more), orders(spark, sf_dir)
    engine.write("orders", rows)
    engine.drain()
    engine.annotate("years", engine.table("years").select(*primary, F.lit("ok").alias("approved")))
    return engine, rows


_YEARS_SQL = """select strftime(o_orderdate, '%Y') as year, count(*) as n,
  cast(sum(cast(round(o_totalprice * 100) as bigint) + case when o_orderkey % 7 = 0 and year(o_orderdate) = 1996 then 1000 else 0 end) as bigint) as cents,
  case when year(o_orderdate) = 1996 and count(*) filter (where o_orderkey % 7 = 0) > 0 then MARK else 'ok' end as approved from orders group by year(o_orderdate), 1"""


def _touch_1996(engine, rows):
    engine.write("orders", rows.where("o_orderkey % 7 = 0 and year(o_date) = 1996").withColumn("cents", F.col("cents") + 1000))
    engine.drain()


@query(_YEARS_SQL.replace("MARK", "null"))
def lapse_attr(spark, sf_dir):
    engine, rows = _lapsing(spark, sf_dir, (Lapse("approved"),), "year string, n long, cents long, approved string")
    _touch_1996(engine, rows)
    return engine.table("years")


@query(_YEARS_SQL.replace("MARK", "'ok'"))
def lapse_narrow(spark, sf_dir):
    engine, rows = _lapsing(spark, sf_dir, (Lapse("approved", ["n"]),), "year string, n long, cents long, approved string")
    _touch_1996(engine, rows)
    return engine.table("years")


@query("""with o as (select strftime(o_orderdate, '%Y') as year, o_orderpriority as priority, o_orderkey,
    cast(round(o_totalprice * 100) as bigint) + case when o_orderkey % 7 = 0 and year(o_orderdate) = 1996 and o_orderpriority = '1-URGENT' then 1000 else 0 end as cents from orders),
  hit as (select count(*) as c from o where o_orderkey % 7 = 0 and year = '1996' and priority = '1-URGENT')
  select year, priority, count(*) as n, cast(sum(cents) as bigint) as cents, case when year = '1996' and (select c from hit) > 0 then null else 'ok' end as approved from o group by 1, 2""")
def lapse_set_grain(spark, sf_dir):
    years = Node("years", "year string, priority string, n long, cents long, approved string", ("year", "priority"), Reduce(folds={"count": "n", "sum": ["cents"]}), recompute_by=RecomputeBy({"year": "year", "priority": "o_orderpriority"}, from_="orders"), lapses=(Lapse("approved", over="year"),), augmented_by=("approved",))
    engine, rows = engine_of(spark, ORDER_LEAF, years), orders(spark, sf_dir)
    engine.write("orders", rows)
    engine.drain()
    engine.annotate("years", engine.table("years").select("year", "priority", F.lit("ok").alias("approved")))
    engine.write("orders", rows.where("o_orderkey % 7 = 0 and year(o_date) = 1996 and o_orderpriority = '1-URGENT'").withColumn("cents", F.col("cents") + 1000))
    engine.drain()
    return engine.table("years")


@query("""select strftime(o_orderdate, '%Y') as year, 'checked' as note from orders
  group by year(o_orderdate), 1 having year(o_orderdate) <> 1996 or count(*) filter (where o_orderkey % 7 = 0) = 0""")
def lapse_child(spark, sf_dir):
    notes = Node("notes", "year string, note string", ("year",), leaf=True)
    engine, rows = _lapsing(spark, sf_dir, (Lapse("notes", key="year"),), "year string, n long, cents long, approved string", more=(notes,))
    engine.write("notes", engine.table("years").select("year", F.lit("checked").alias("note")))
    engine.drain()
    _touch_1996(engine, rows)
    return engine.table("notes")


# -- roll-ups, digests, functions --------------------------------------------------------------------


def _month_health(spark, sf_dir):
    months = Node("months", "month string, n long, status string", ("month",), Reduce("orders", "month", into=lambda: {"n": F.count(F.lit(1)), "status": F.when(F.max("cents") > 44_000_000, "failing").when(F.max("cents") > 40_000_000, "pending").otherwise("present")}))
    engine = engine_of(spark, ORDER_LEAF, months)
    apply_changes(engine, "orders", orders(spark, sf_dir), "o_orderkey", {"cents": F.col("cents") + 1000})
    return engine


_HEALTH_SQL = f"""(select strftime(o_date, '%Y-%m') as month, case when max(cents) > 44000000 then 'failing' when max(cents) > 40000000 then 'pending' else 'present' end as status
  from {ORDERS_SQL} group by 1)"""


@query(f"select status, count(*) as n from {_HEALTH_SQL} group by 1", "status_histogram")
def _status_histogram(spark, sf_dir):
    return status_histogram(_month_health(spark, sf_dir).table("months"))


@query(f"""select case when count(*) = 0 then 'unknown' when count(*) filter (where status = 'failing') > 0 then 'findings' when count(*) filter (where status in ('pending', 'stale')) > 0 then 'pending' else 'green' end as verdict,
  count(*) filter (where status = 'failing') as failing, count(*) filter (where status in ('pending', 'stale')) as pending from {_HEALTH_SQL}""")
def verdict(spark, sf_dir):
    return _month_health(spark, sf_dir).table("months").agg(*verdict_columns())


@query("""select n_regionkey, '1:' || sha256(array_to_string(list_transform(list_sort(list([cast(n_nationkey as varchar), n_name])), lambda r: r[1] || '\\x1F' || r[2]), chr(10))) as digest
  from nation group by 1""")
def basis_digest(spark, sf_dir):
    leaf = Node("nations", "n_nationkey int, n_name string, n_regionkey int", ("n_nationkey",), leaf=True)
    per = Node("per", "n_regionkey int, digest string", ("n_regionkey",), Reduce("nations", "n_regionkey", into=lambda: {"digest": basis_column(["n_nationkey", "n_name"])}))
    engine = engine_of(spark, leaf, per)
    engine.write("nations", load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    engine.drain()
    return engine.table("per")


#: pairs whose values, joined by bars, are the same, and pairs with null, empty and marked values
_PAIRS_SQL = """(select n_name || '|x' as a, 'y' as b, cast(n_nationkey as bigint) as n from nation
  union all select n_name, 'x|y', n_nationkey + 100 from nation
  union all select null, n_name, n_nationkey + 200 from nation union all select '', n_name, n_nationkey + 300 from nation
  union all select '\\N', n_name, n_nationkey + 400 from nation union all select n_name || '\\', '|', n_nationkey + 500 from nation)"""


def _pairs(spark, sf_dir) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("n"))
    name, none = F.col("n_name"), F.lit(None).cast("string")
    parts = [(F.concat(name, F.lit("|x")), F.lit("y")), (name, F.lit("x|y")), (none, name), (F.lit(""), name), (F.lit("\\N"), name), (F.concat(name, F.lit("\\")), F.lit("|"))]
    frames = [nation.select(a.alias("a"), b.alias("b"), (F.col("n") + 100 * i).alias("n")) for i, (a, b) in enumerate(parts)]
    return reduce(DataFrame.unionByName, frames)


_PAIR_LEAF = Node("pairs", "a string, b string, n long", ("a", "b"), leaf=True)


def _on_pairs(spark, sf_dir, *nodes: Node) -> DataFrame:
    """Pairs written one kind after the other, then all again with the larger half raised by one and withdrawn."""
    engine = engine_of(spark, _PAIR_LEAF, *nodes)
    pairs = _pairs(spark, sf_dir)
    for odd in (0, 1):
        engine.write("pairs", pairs.where(F.col("n") % 2 == odd))
        engine.drain()
    engine.write("pairs", pairs.withColumn("n", F.col("n") + 1))
    engine.drain()
    engine.write("pairs", pairs)
    engine.drain()
    return engine.table(nodes[-1].id if nodes else "pairs")


@query(f"select a, b, n from {_PAIRS_SQL}")
def keys_with_bars(spark, sf_dir):
    return _on_pairs(spark, sf_dir)


@query(f"select a, count(*) as n, cast(sum(n) as bigint) as total from {_PAIRS_SQL} group by a")
def keys_with_nulls(spark, sf_dir):
    return _on_pairs(spark, sf_dir, Node("per", "a string, n long, total long", ("a",), Reduce("pairs", "a", {"count": "n", "sum": {"n": "total"}})))


@query(f"select a, b, n, n * 2 as twice from {_PAIRS_SQL}")
def per_key_composite(spark, sf_dir):
    call = PerKey(lambda n: {"twice": n * 2, "n": n}, over="pairs", args={"n": "n"})
    return _on_pairs(spark, sf_dir, Node("doubles", "a string, b string, n long, twice long", ("a", "b"), call)).select("a", "b", "n", "twice")


@query(f"select o_orderkey, cents + 7 as cents from {ORDERS_SQL}")
def write_same_key_twice(spark, sf_dir):
    """Each key comes twice in one write; the later one by ``v`` counts."""
    engine = engine_of(spark, ORDER_LEAF)
    rows = orders(spark, sf_dir).where(F.col("o_orderkey") % 13 != 0).withColumn("cents", F.col("cents") + F.when(F.col("o_orderkey") % 7 == 0, 1000).otherwise(0))
    first, last = rows.withColumn("v", F.lit(1)), rows.withColumn("cents", F.col("cents") + 7).withColumn("v", F.lit(2))
    engine.write("orders", last.unionByName(first), order="v")
    return engine.table("orders").select("o_orderkey", "cents")


@query(f"select o_custkey, count(*) as n, cast(sum(cents) as bigint) as cents from {ORDERS_SQL} group by 1")
def two_writers(spark, sf_dir):
    """Two engines on one state, each with a copy of it that the other's commits make old."""
    node = Node("customers", "o_custkey long, n long, cents long", ("o_custkey",), Reduce("orders", "o_custkey", {"count": "n", "sum": ["cents"]}))
    root = state_root(spark)
    one, two = (Engine(spark, [ORDER_LEAF, node], root, trace=0) for _ in range(2))
    rows = orders(spark, sf_dir)
    one.write("orders", rows.where(F.col("o_orderkey") % 2 == 0))
    two.write("orders", rows.where(F.col("o_orderkey") % 2 == 1))
    one.drain()
    raised = rows.where(F.col("o_orderkey") % 7 == 0).withColumn("cents", F.col("cents") + 1000)
    two.write("orders", raised, rows.where(F.col("o_orderkey") % 13 == 0).select("o_orderkey"))
    one.write("orders", raised.where(F.col("o_orderkey") % 13 != 0))  # not moved
    two.drain()
    return one.table("customers")


@query("""select s_suppkey, sha256('{"f0":' || cast(s_suppkey as varchar) || ',"f1":"' || s_name || '"}') as print from supplier""")
def fingerprint_fields(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", fingerprint(["s_suppkey", "s_name"]).alias("print"))


@query("select event_id, " + ", ".join(f"{v} as {k}" for k, v in _LABEL_SQL.items()) + " from events")
def calendar_labels(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", *(Bucket(k, "ts")().alias(k) for k in _LABEL_SQL))


# -- graphs -------------------------------------------------------------------------------------------


@query(f"""with o as (select l_orderkey, sum(cents) as cents from {LINEITEM_SQL} group by 1),
  c as (select o_custkey, sum(o.cents) as cents from o join {ORDERS_SQL} on o_orderkey = l_orderkey group by 1)
  select c_nationkey as nation, count(*) as customers, cast(sum(c.cents) as bigint) as cents from c join customer on c_custkey = o_custkey group by 1""")
def chain_three_levels(spark, sf_dir):
    order = Node("order_values", "key string, o_custkey long, cents long", ("key",), Join(Side("o_orderkey"), Side("l_orderkey"), {"left": ["o_custkey"], "right": ["cents"]}, left_over="orders", right_over="line_totals"))
    customer = Node("customer_values", "o_custkey long, cents long", ("o_custkey",), Reduce("order_values", "o_custkey", {"sum": ["cents"]}, query=lambda rows, claimed: rows.where("cents is not null")))
    placed = Node("placed", "key string, nation int, cents long", ("key",), Join(Side("o_custkey"), Side("c_custkey"), {"left": ["cents"], "right": {"c_nationkey": "nation"}}, left_over="customer_values", right_over="customers"))
    nation = Node("nation_values", "nation int, customers long, cents long", ("nation",), Reduce("placed", "nation", {"count": "customers", "sum": ["cents"]}))
    engine = engine_of(spark, ORDER_LEAF, LINES, CUSTOMERS, _LINE_TOTALS, order, customer, placed, nation)
    engine.write("customers", _customers(spark, sf_dir))
    apply_changes(engine, "orders", orders(spark, sf_dir), "o_orderkey", {"cents": F.col("cents") + 1000}, drain=False)
    apply_changes(engine, "lines", lineitem(spark, sf_dir), "l_orderkey", {"cents": F.col("cents") + 1000})
    return engine.table("nation_values")


@query(f"""with p as (select o_orderpriority as k, count(*) as n, sum(cents) as cents from {ORDERS_SQL} group by 1)
  select k as key, n, cast(cents as bigint) as cents from p""")
def diamond(spark, sf_dir):
    left = Node("counts", "priority string, n long", ("priority",), Reduce("orders", ("priority", "o_orderpriority"), {"count": "n"}))
    right = Node("sums", "priority string, cents long", ("priority",), Reduce("orders", ("priority", "o_orderpriority"), {"sum": ["cents"]}))
    both = Node("both", "key string, n long, cents long", ("key",), Join(Side("priority"), Side("priority"), {"left": ["n"], "right": ["cents"]}, left_over="counts", right_over="sums", outer=True))
    return maintained(spark, sf_dir, [ORDER_LEAF, left, right, both])


@query("select c_mktsegment as segment, count(*) as n, 100 as bar from customer where c_custkey % 13 <> 0 group by 1")
def context_edge(spark, sf_dir):
    bars = Node("bars", "name string, bar int", ("name",), leaf=True)
    per = Node("per", "segment string, n long, bar int", ("segment",), Reduce("customers", "segment", {"count": "n", "max": ["bar"]}, query=lambda rows, claimed: rows.crossJoin(F.broadcast(engine.table("bars").where("name = 'all'").select("bar").limit(1)))), context=("bars",))
    engine = engine_of(spark, CUSTOMERS, bars, per)
    bar = lambda n: spark.createDataFrame([("all", n)], "name string, bar int")
    engine.write("bars", bar(100))
    apply_changes(engine, "customers", _customers(spark, sf_dir), "c_custkey")
    engine.write("bars", bar(200))
    engine.drain()  # what is read as context wakes nobody
    return engine.table("per")


@query("select c_mktsegment as segment, count(*) as n, 2 as runs from customer group by 1")
def force(spark, sf_dir):
    runs = []
    per = Node("per", "segment string, n long", ("segment",), Reduce("customers", "segment", {"count": "n"}))
    seen = Node("seen", "segment string, n long, runs int", ("segment",), Reduce("per", "segment", into=lambda: {"n": F.max("n"), "runs": F.lit(len(runs))}))
    engine = engine_of(spark, CUSTOMERS, per, seen)
    engine.write("customers", _customers(spark, sf_dir))
    runs.append(1)
    engine.drain()
    runs.append(2)
    engine.mark("per", [r[0] for r in engine.table("per").select("segment").collect()])
    engine.drain(force="per")  # no value of per moved, and yet its consumer runs
    return engine.table("seen")


@query("""select n_regionkey as region, count(*) as n, cast(sum(cast(round(c_acctbal * 100) as bigint)) as bigint) as cents from customer join nation on n_nationkey = c_nationkey
  where c_custkey % 13 <> 0 group by 1""")
def tenants_isolated(spark, sf_dir):
    per = Node("per", "region int, n long, cents long", ("region",), Reduce("customers", ("region", "region"), {"count": "n", "sum": ["cents"]}))
    leaf = Node("customers", "c_custkey long, region int, cents long", ("c_custkey",), leaf=True)
    root, parts = state_root(spark), []
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"), cents("c_acctbal").alias("cents"))
    for region in range(5):
        engine = Engine(spark, [leaf, per], root, tenant=f"r{region}", trace=0)
        apply_changes(engine, "customers", rows.where(F.col("region") == region), "c_custkey")
        parts.append(engine.table("per"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("select o_custkey, case when o_custkey % 2 = 0 then 2 else 1 end as version, count(*) as n from orders group by 1, 2")
def reprocess_slice(spark, sf_dir):
    version = [1]
    per = Node("per", "o_custkey long, even boolean, version int, n long", ("o_custkey",), Reduce("orders", "o_custkey", into=lambda: {"even": F.max(F.col("o_custkey") % 2) == 0, "version": F.lit(version[0]), "n": F.count(F.lit(1))}))
    engine = engine_of(spark, ORDER_LEAF, per)
    engine.write("orders", orders(spark, sf_dir))
    engine.drain()
    version[0] = 2
    reprocess(engine, "per", where={"even": True})
    return engine.table("per").select("o_custkey", "version", "n")


@query(f"select {_LABEL_SQL['day']} as day, event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by 1, 2")
def streaming_leaf(spark, sf_dir):
    import os
    import shutil

    per = Node("per", "day string, event_type string, n long, cents long", ("day", "event_type"), Reduce("events", ["day", "event_type"], {"count": "n", "sum": ["cents"]}))
    engine = engine_of(spark, EVENT_LEAF, per)
    folder = f"{state_root(spark)}-stream"
    rows = _events(spark, sf_dir)
    rows.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = stream.writeStream.foreachBatch(writes_of(engine, "events")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if os.path.isdir(folder):
        shutil.rmtree(folder, ignore_errors=True)
    return engine.table("per")


def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a leaf, monthly totals by unit, and a status of each month, through inserts, updates and deletes."""
    months = Node("monthly_revenue", "month string, cents long, n long", ("month",), Reduce(folds={"sum": ["cents"], "count": "n"}), recompute_by=RecomputeBy("month", from_="orders"))
    health = Node("month_health", "month string, status string", ("month",), Reduce("monthly_revenue", "month", into=lambda: {"status": F.when(F.max("n") > 0, "present").otherwise("failing")}))
    return maintained(spark, sf_dir, [ORDER_LEAF, months, health], "monthly_revenue")


query(f"select strftime(o_date, '%Y-%m') as month, cast(sum(cents) as bigint) as cents, count(*) as n from {ORDERS_SQL} group by 1")(monthly_revenue)

__all__ = ["ORACLES", "QUERIES", "T", "monthly_revenue"]
