"""What each kind of computation makes of its inputs: lazy DataFrames of rows with key and unit.

All of them read their inputs through ``Context.input``, restricted by a semi-join to the claimed units;
Catalyst prunes columns and picks the join. Nothing here runs a job, except where a caller asked for counts.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field
from functools import reduce as fold_left
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import Bucket, bounds, bucket_of_key_column, parse
from ..functions.keys import BAR, fingerprint, first_segment, identity_of, value_of
from ..plans.model import Aggregate, CellFailed, Join, Node, NodeError, PerKey, Reduce, Union, fold_items, group_items, picks
from ..runtime.store import KEY, UNIT

SKIP = "__skip"


@dataclass
class Claims:
    """What is to be recomputed: everything, or the units in ``units`` (one column). legs: union inputs among them.

    values: the units themselves where they are few, so that scans can be pruned by them.
    """

    whole: bool
    units: DataFrame | None = None
    legs: set[str] | None = None
    values: list[str] | None = None

    def scope(self, rows: DataFrame) -> DataFrame:
        return rows if self.whole else rows.join(self.units, UNIT, "left_semi")


@dataclass
class Produced:
    """rows: KEY, UNIT, the emitted columns, and perhaps SKIP. forced: report every row whatever its value."""

    rows: DataFrame
    emitted: list[str]
    forced: bool = False
    meta: dict = field(default_factory=dict)


@dataclass
class Context:
    engine: Any
    cell: str
    node: Node
    claims: Claims

    def input(self, name: str, read: str | None = None, query=None, unit: Column | None = None, hull: tuple[str, str] | None = None, column: str | None = None) -> DataFrame:
        """A node's rows: named read, calculations, the node's query, and only then the scope, which it cannot undo."""
        source = self.engine.node(name)
        rows = self.engine.rows(name)
        if read:
            rows = source.reads[read](rows)
        rows = with_calculations(source, rows)
        if query:
            rows = query(rows, None if self.claims.whole else self.claims.units)
        if unit is None:
            return rows
        if hull and not self.claims.whole:
            rows = self.in_hull(rows, *hull)
        if column in source.names and not self.claims.whole and self.claims.values is not None:
            rows = self.among(rows, source.schema[column])
        return self.claims.scope(rows.withColumn(UNIT, unit))

    def among(self, rows: DataFrame, column: T.StructField) -> DataFrame:
        """Few claimed values as a filter on the column itself, which reaches the files; the semi-join makes it exact."""
        values = [value_of(v) for v in self.claims.values]
        if None in values or not isinstance(column.dataType, (T.StringType, T.LongType, T.IntegerType, T.ShortType)):
            return rows
        if not isinstance(column.dataType, T.StringType):
            values = [int(v) for v in values if v.lstrip("-").isdigit()]
        return rows.where(F.col(column.name).isin(values) if values else F.lit(False))

    def in_hull(self, rows: DataFrame, kind: str, column: str) -> DataFrame:
        """A range of dates around the claimed labels, which prunes the scan; the semi-join makes it exact."""
        low, high = self.claims.units.agg(F.min(UNIT), F.max(UNIT)).first()
        try:
            if low is None or {parse(low)[0], parse(high)[0]} != {kind}:
                return rows
        except ValueError:
            return rows
        return rows.where((F.col(column) >= F.lit(bounds(kind, low)[0])) & (F.col(column) < F.lit(bounds(kind, high)[1])))


def with_calculations(node: Node, rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: f() for name, f in node.calculations.items()}) if node.calculations else rows


def column_of(spec) -> Column:
    return F.col(spec) if isinstance(spec, str) else spec()


def group_exprs(node: Node, c: Reduce) -> list[tuple[str, Column]]:
    """Own column and expression over the input of each part of the group."""
    by = node.recompute_by
    items = group_items(c.group_by)
    if by and by.from_key:
        kind = by.from_key
        head = bucket_of_key_column(kind, F.col(KEY)) if isinstance(kind, str) else first_segment(F.col(KEY))
        return [(items[0][0], head)]
    return [(dest, column_of(source)) for dest, source in items]


def key_order(node: Node) -> Column:
    """The order of a node's rows: by the values of their identity, not by their text."""
    return F.struct(*node.primary_key) if node.primary_key and node.columns is not None else F.col(KEY)


def fold_column(kind: str, source: str | None, order: Column) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "first":  # in the order of the input's keys, nulls left out
        return F.min_by(source, F.when(F.col(source).isNotNull(), order))
    return getattr(F, kind)(source)


def keyed(node: Node, rows: DataFrame, group: list[str], prefix: str | None = None, key=None) -> DataFrame:
    """Add KEY: the primary key's columns where the rows have them, else the group's values in one key column."""
    pk = list(node.primary_key)
    if key is not None:
        return rows.withColumn(KEY, key().cast("string")).withColumn(pk[0], F.col(KEY))
    if all(k in rows.columns for k in pk) and not prefix:
        return rows.withColumn(KEY, identity_of(pk))
    if len(pk) != 1:
        raise NodeError(f"{node.id!r}: identity column {next(k for k in pk if k not in rows.columns)!r} is not produced")
    return rows.withColumn(KEY, identity_of(group, prefix)).withColumn(pk[0], F.col(KEY))


def reduce_rows(ctx: Context, c: Reduce) -> Produced:
    node = ctx.node
    exprs = group_exprs(node, c)
    source = ctx.engine.node(c.over)
    hull = None
    if len(exprs) == 1 and not (node.recompute_by and node.recompute_by.from_key):
        calculation = source.calculations.get(group_items(c.group_by)[0][1])
        hull = (calculation.kind, calculation.column) if isinstance(calculation, Bucket) else None
    plain = group_items(c.group_by)[0][1] if len(exprs) == 1 and not (node.recompute_by and node.recompute_by.from_key) else None
    column = plain if isinstance(plain, str) and plain not in source.calculations else None
    rows = ctx.input(c.over, c.read, c.query, identity_of([e for _, e in exprs]), hull, column)
    names = [f"__g{i}" for i in range(len(exprs))]
    rows = rows.withColumns({n: e for n, (_, e) in zip(names, exprs, strict=True)})
    dests = [d for d, _ in exprs]
    if c.expand:
        clash = [d for d in dests if d in rows.columns]
        made = c.expand(rows.drop(*clash).withColumnsRenamed(dict(zip(names, dests, strict=True))), dests)
        if not isinstance(made, DataFrame):
            raise TypeError(f"{node.id!r}: expand returns a DataFrame of rows")
        missing = [k for k in [*node.primary_key, *dests] if k not in made.columns]
        if missing:
            raise NodeError(f"{node.id!r}: expand made rows without {missing[0]!r}")
        made = made.withColumn(KEY, identity_of(node.primary_key, c.key_prefix)).withColumn(UNIT, identity_of(dests))
        return Produced(made, [x for x in made.columns if x in node.names])
    folds = [e.alias(n) for n, e in c.into().items()] if c.into else [fold_column(k, s, key_order(source)).alias(d) for k, s, d in fold_items(c.folds)]
    made = rows.groupBy(UNIT, *names).agg(*folds).withColumnsRenamed(dict(zip(names, dests, strict=True)))
    made = keyed(node, made, dests, c.key_prefix, c.key)
    return Produced(made, [x for x in made.columns if x in node.names])


def join_key(side) -> Column:
    return column_of(side.key)


def on_side(rows: DataFrame, side) -> DataFrame:
    for column, value in side.where.items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows.where(join_key(side).isNotNull())


def join_rows(ctx: Context, c: Join) -> Produced:
    node = ctx.node

    def side_rows(side, name):
        rows = on_side(ctx.input(name, c.read, c.query), side).withColumn("__jk", join_key(side)).withColumn(UNIT, identity_of([F.col("__jk")]))
        # of rows with one side key the last in key order counts
        kept = [x for x in rows.columns if x not in (UNIT, KEY)]
        return ctx.claims.scope(rows).groupBy(UNIT).agg(F.max_by(F.struct(*kept), key_order(ctx.engine.node(name))).alias("r"))

    left, right = side_rows(c.left, c.left_over or c.over), side_rows(c.right, c.right_over or c.over)
    both = left.withColumnRenamed("r", "l").join(right, UNIT, "full" if c.outer else "left")
    jk = F.coalesce(F.col("l.__jk").cast("string"), F.col("r.__jk").cast("string"))
    if callable(c.into):
        made = c.into(jk, lambda name: F.col(f"l.{name}"), lambda name: F.col(f"r.{name}"))
    else:
        made = {d: F.col(f"l.{s}") for s, d in picks(c.into.get("left")).items()} | {d: F.col(f"r.{s}") for s, d in picks(c.into.get("right")).items()}
    rows = both.select(UNIT, jk.alias("__jk"), *(e.alias(d) for d, e in made.items()))
    rows = keyed(node, rows, ["__jk"], c.key_prefix, c.key)
    return Produced(rows, [x for x in rows.columns if x in node.names])


def union_rows(ctx: Context, c: Union) -> Produced:
    legs = [i for i in c.from_ if ctx.claims.whole or ctx.claims.legs is None or i in ctx.claims.legs]
    parts = []
    for name in legs:
        rows = ctx.engine.rows(name)
        sources = {"cell": F.lit(name), "key": F.col(KEY)}
        made = rows.select(F.concat_ws(BAR, F.lit(name), F.col(KEY)).alias(KEY), *((sources[s] if s in sources else F.col(s)).alias(d) for d, s in c.into.items()))
        parts.append(made.withColumn(UNIT, F.col(KEY)))
    rows = fold_left(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    pk = list(ctx.node.primary_key)
    if len(pk) == 1 and pk[0] not in c.into:
        rows = rows.withColumn(pk[0], F.col(KEY))
    return Produced(ctx.claims.scope(rows), [x for x in rows.columns if x in ctx.node.names], meta={"inputs_read": len(legs)})


def aggregate_rows(ctx: Context, c: Aggregate) -> Produced:
    keys = [c.key] if isinstance(c.key, str) else list(c.key)
    own = ctx.claims.scope(ctx.engine.rows(ctx.cell).select(KEY, F.col(KEY).alias(UNIT)))
    child = ctx.claims.scope(ctx.input(c.over).withColumn(UNIT, identity_of(keys)))
    folds = fold_items(c.folds)
    sums = child.groupBy(UNIT).agg(*(fold_column(k, s, key_order(ctx.engine.node(c.over))).alias(d) for k, s, d in folds))
    rows = own.join(sums, UNIT, "left").withColumns({d: F.coalesce(d, F.lit(0).cast("long")) for k, _, d in folds if k == "count"})
    return Produced(rows, [d for _, _, d in folds])


def per_key_rows(ctx: Context, c: PerKey) -> Produced:
    node, engine = ctx.node, ctx.engine
    attribute = c.fingerprint_attribute or "fingerprint"
    wanted = fingerprint(c.fingerprint) if c.fingerprint is not None else None
    over = c.over or engine.inputs(ctx.cell)[0]
    rows = ctx.input(over, unit=F.col(KEY))
    pk = identity_columns(node, engine.node(over))
    rows = rows.withColumns({f"__pk{i}": e for i, e in enumerate(pk)})
    own = [f"__pk{i}" for i in range(len(pk))]
    rows = rows.withColumn("__want", wanted if wanted is not None else F.lit(None).cast("string"))
    if wanted is not None:
        stored = engine.rows(ctx.cell).select(KEY, F.col(attribute).alias("__stored"))
        rows = rows.join(stored, KEY, "left").withColumn("__call", F.col("__want").isNull() | ~F.col("__want").eqNullSafe(F.col("__stored")))
    else:
        rows = rows.withColumn("__call", F.lit(True))
    called, skipped = rows.agg(F.count_if("__call"), F.count_if(~F.col("__call"))).first()
    calls = rows.where("__call")
    sources = c.args or {n: n for n in engine.node(over).names}
    if c.returns:
        made = _call_pandas(calls.select(KEY, "__want", *own, *(F.col(s).alias(a) for a, s in sources.items())), c)
    else:
        made = calls.withColumns({f"__r_{n}": e for n, e in c.action(**{a: F.col(s) for a, s in sources.items()}).items()})
        made = made.select(KEY, "__want", *own, *(F.col(x).alias(x.removeprefix("__r_")) for x in made.columns if x.startswith("__r_")))
    into = dict(c.into) if c.into else {x: x for x in made.columns if x not in (KEY, "__want", *own) and x in node.names}
    made = made.select(KEY, *own, F.col(KEY).alias(UNIT), *(F.col(s).alias(d) for d, s in into.items()), *([F.col("__want").alias(attribute)] if wanted is not None else []), F.lit(False).alias(SKIP))
    left_alone = rows.where(~F.col("__call")).select(KEY, *own, F.col(KEY).alias(UNIT), F.lit(True).alias(SKIP))
    made = made.unionByName(left_alone, allowMissingColumns=True)
    made = made.withColumns({k: F.col(o).cast(node.schema[k].dataType) for k, o in zip(node.primary_key, own, strict=True) if k not in made.columns})
    return Produced(made, [x for x in made.columns if x in node.names], forced=True, meta={"called": called, "skipped": skipped})


def identity_columns(node: Node, source: Node) -> list[Column]:
    """The input's identity, column for column, or its key where the node has a single one of its own."""
    if len(node.primary_key) == len(source.primary_key):
        return [F.col(k) for k in source.primary_key]
    if len(node.primary_key) == 1:
        return [F.col(KEY)]
    raise NodeError(f"{node.id!r}: has {len(node.primary_key)} identity columns, its input {source.id!r} has {len(source.primary_key)}")


def _call_pandas(rows: DataFrame, c: PerKey) -> DataFrame:
    """The action on batches of arguments, on at most ``max_concurrency`` tasks at once.

    With a timeout each call has one row, and a call that takes longer fails the job at once.
    """
    own = [f for f in rows.schema if f.name in (KEY, "__want") or f.name.startswith("__pk")]
    schema = T.StructType([*own, *T._parse_datatype_string(c.returns)])
    names, action, limit = [f.name for f in own], c.action, c.timeout

    def call(args):
        if limit is None:
            return action(args)
        import threading

        done: list = []

        def work():
            try:
                done.append((action(args), None))
            except Exception as e:
                done.append((None, e))

        thread = threading.Thread(target=work, daemon=True)  # one that hangs dies with the worker
        thread.start()
        thread.join(limit)
        if not done:
            raise TimeoutError(f"a call took longer than {limit} seconds")
        if done[0][1]:
            raise done[0][1]
        return done[0][0]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            args = pdf.drop(columns=names)
            if limit is None:
                made = call(args)
            else:
                made = pd.concat([call(args.iloc[i : i + 1]) for i in range(len(args))], ignore_index=True) if len(args) else call(args)
            yield made.assign(**{n: pdf[n].to_numpy() for n in names})[schema.names]

    return rows.repartition(c.max_concurrency).mapInPandas(run, schema)


def run_rows(ctx: Context, action):
    """Call a function with those of engine, cell, node, claims and plan that it names."""
    have = {"engine": ctx.engine, "cell": ctx.cell, "node": ctx.node, "claims": ctx.claims, "plan": ctx.engine.plan}
    wanted = inspect.signature(action).parameters
    return action(**{k: v for k, v in have.items() if k in wanted})


def produce(ctx: Context):
    """Rows (``Produced``), or what a computation that writes for itself returned."""
    c = ctx.node.computation
    if isinstance(c, Reduce):
        return reduce_rows(ctx, c)
    if isinstance(c, Join):
        return join_rows(ctx, c)
    if isinstance(c, Union):
        return union_rows(ctx, c)
    if isinstance(c, Aggregate):
        return aggregate_rows(ctx, c)
    if isinstance(c, PerKey):
        return per_key_rows(ctx, c)
    if hasattr(c, "op"):
        return c.op.recompute(ctx.engine, ctx.cell, ctx.claims)
    return run_rows(ctx, c.action)


__all__ = ["CellFailed", "Claims", "Context", "Produced", "produce"]
