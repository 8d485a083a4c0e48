"""Change detection: new rows against stored ones, as one full outer join on the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import Node
from .store import BEFORE, HIDDEN, KEY, OP, UNIT


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def moved(columns: list[str]) -> Column:
    """Whether any of the columns differs between the joined structs N (new) and P (stored)."""
    return any_of([~F.col(f"N.{c}").eqNullSafe(F.col(f"P.{c}")) for c in columns])


def reported(node: Node, emitted: list[str]) -> Column:
    """Whether a row that both sides have counts as changed: by fingerprint, else by compare, else by all it carries."""
    columns = [c for c in node.compare if c in emitted] if node.compare else emitted
    attribute = node.fingerprint_attribute or "fingerprint"
    if node.fingerprint is not None and attribute in emitted:
        rest = columns if node.compare else [c for c in columns if c != attribute]
        by_print = ~F.col(f"N.{attribute}").eqNullSafe(F.col(f"P.{attribute}"))
        return F.when(F.col(f"N.{attribute}").isNotNull(), by_print).otherwise(moved(rest))
    return moved(columns)


def diff(node: Node, new: DataFrame, prior: DataFrame, emitted: list[str], *, forced: bool = False, retire: bool = True, lapses: bool = True) -> DataFrame:
    """Change rows: hidden columns, own columns, OP (created, changed, touched, retired) and BEFORE.

    new: KEY, UNIT, emitted columns and perhaps __skip. Columns that are not emitted keep their stored value.
    touched: written, because a column that does not count or a mark moved, but not reported.
    """
    types = {f.name: f.dataType for f in node.schema}
    skip = F.col("__skip") if "__skip" in new.columns else F.lit(False)
    new = new.select(KEY, F.struct(UNIT, *(F.col(c).cast(types[c]).alias(c) for c in emitted)).alias("N"), F.coalesce(skip, F.lit(False)).alias("S"))
    prior = prior.select(KEY, F.struct(UNIT, *node.names).alias("P"))
    both = new.join(prior, KEY, "full_outer")
    there, here = F.col("P").isNotNull(), F.col("N").isNotNull()
    values = {c: F.when(here, F.col(f"N.{c}")).otherwise(F.col(f"P.{c}")) if c in emitted else F.col(f"P.{c}") for c in node.names}
    lapsed = F.lit(False)
    for lapse in node.lapses if lapses else ():
        if lapse.target in node.names and not lapse.over:
            hit = there & here & moved(watched(node, lapse, emitted))
            lapsed = lapsed | (hit & F.col(f"P.{lapse.target}").isNotNull())
            values[lapse.target] = F.when(~hit, values[lapse.target])
    op = (
        F.when(F.coalesce("S", F.lit(False)), None)
        .when(~here, F.lit("retired") if retire else F.lit(None))
        .when(~there, "created")
        .when(F.lit(True) if forced else reported(node, emitted), "changed")
        .when(moved([UNIT, *emitted]) | lapsed, "touched")
    )
    unit = F.coalesce(F.col(f"N.{UNIT}"), F.col(f"P.{UNIT}"))
    before = F.when(there, F.struct(F.col(f"P.{UNIT}").alias(UNIT), *(F.col(f"P.{c}").alias(c) for c in node.names)))
    out = both.select(KEY, unit.alias(UNIT), *(e.cast(types[c]).alias(c) for c, e in values.items()), op.alias(OP), before.alias(BEFORE))
    return out.where(F.col(OP).isNotNull())


def watched(node: Node, lapse, emitted: list[str]) -> list[str]:
    skip = {node.fingerprint_attribute or "fingerprint"} if node.fingerprint is not None else set()
    return [c for c in emitted if c not in skip] if lapse.when_changed == "any" else list(lapse.when_changed)


def moved_since(columns: list[str]) -> Column:
    """Whether a change row's columns differ from what they were before."""
    return F.col(BEFORE).isNotNull() & (F.col(OP) != "retired") & any_of([~F.col(c).eqNullSafe(F.col(f"{BEFORE}.{c}")) for c in columns])


def lapse_units(node: Node, change: DataFrame, stored: DataFrame, emitted: list[str]) -> DataFrame:
    """Clear marks that lapse for a whole unit: in all change rows of the unit, and in stored rows that did not change."""
    for lapse in node.lapses:
        if lapse.target not in node.names or not lapse.over:
            continue
        over = [lapse.over] if isinstance(lapse.over, str) else list(lapse.over)
        units = change.where(moved_since(watched(node, lapse, emitted))).select(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(over))).distinct()
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(over)))
        own = change.join(units.withColumn("__hit", F.lit(True)), same, "left")
        own = own.withColumn(lapse.target, F.when(F.col("__hit").isNull(), F.col(lapse.target))).select(change.columns)
        rest = stored.join(change.select(KEY), KEY, "left_anti").where(F.col(lapse.target).isNotNull()).join(units, same, "left_semi")
        before = F.struct(F.col(UNIT), *node.names)
        rest = rest.select(*HIDDEN, *node.names, F.lit("touched").alias(OP), before.alias(BEFORE))
        rest = rest.withColumn(lapse.target, F.lit(None).cast(node.schema[lapse.target].dataType))
        change = own.unionByName(rest.select(change.columns))
    return change
