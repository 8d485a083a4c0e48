"""Reconcile a leaf with what a scan observed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import NodeError
from ..runtime.diff import diff
from ..runtime.store import BEFORE, HIDDEN, KEY, OP, UNIT


@dataclass
class Reconciled:
    """Keys that changed (sorted; at most the engine's trace of them), and how many of each kind."""

    changed: list[str]
    counts: dict[str, int] = field(default_factory=dict)


def reconcile(engine, cell: str, want: DataFrame, observed: str = "all", retire: str | Callable | None = None, current: DataFrame | None = None, mark: bool = True) -> Reconciled:
    """Bring a leaf to the rows of a scan, in one commit with its marks.

    want: the node's columns, or its primary key and ``verdict`` (created, changed, unchanged, or null for not observed) where the
    caller has written the rows itself. observed: "partial" means that absent keys are not vanished.
    retire: "destroy", "keep", or a function from vanished rows to rows that mark them; by default the node's
    ``retain_if_vanished``. current: the live baseline; by default all rows, or those that the node calls live.
    """
    if observed not in ("all", "partial"):
        raise ValueError(f'observed is "all" or "partial", not {observed!r}')
    node = engine.node(cell)
    policy = retire if retire is not None else {True: "keep", False: "destroy"}.get(node.retain_if_vanished, node.retain_if_vanished)
    if policy not in ("destroy", "keep") and not callable(policy):
        raise ValueError(f"{cell!r}: retire is destroy, keep or a function, not {policy!r}")
    stored = engine.rows(cell)
    live = current.withColumn(KEY, _key(node)) if current is not None else stored.where(node.live()) if node.live else stored
    parts = []
    if "verdict" in want.columns:
        seen = want.where("verdict is not null").select(_key(node).alias(KEY), "verdict")
        bad = seen.where(~F.col("verdict").isin("created", "changed", "unchanged")).limit(1).collect()
        if bad:
            raise ValueError(f"{cell!r}: unusable verdict {bad[0].verdict!r}")
        rows = stored.join(seen, KEY)
        before = F.when(F.col("verdict") == "changed", F.struct(UNIT, *node.names))
        judged = rows.select(*HIDDEN, *node.names, F.when(F.col("verdict") == "unchanged", "touched").otherwise(F.col("verdict")).alias(OP), before.alias(BEFORE))
        observed_keys = want.select(_key(node).alias(KEY))
        verdicts = judged.withColumn("__revived", F.lit(False))
    else:
        extra = [c for c in want.columns if c not in node.names]
        if extra:
            raise NodeError(f"{cell!r}: scanned rows with unknown column {extra[0]!r}")
        new = engine._with_fingerprint(node, engine._keyed(node, want))
        emitted = [c for c in new.columns if c in node.names]
        observed_keys = new.select(KEY)
        change = diff(node, new, stored.join(observed_keys, KEY, "left_semi"), emitted, retire=False, lapses=False)
        verdicts = change.withColumn("__revived", F.lit(False))
        if callable(policy) and observed == "all":
            # in the scan, marked as vanished before, and otherwise as it was: it has come back
            asleep = stored.join(live.select(KEY), KEY, "left_anti").join(observed_keys, KEY, "left_semi").select(KEY, F.lit(True).alias("__asleep"))
            unmoved = new.join(asleep, KEY).join(change.where(F.col(OP) != "touched").select(KEY), KEY, "left_anti")
            was = stored.select(KEY, F.struct(UNIT, *node.names).alias("__was"))
            value = lambda c: F.col(f"N.{c}") if c in emitted else F.col(f"__was.{c}")
            back = unmoved.select(KEY, F.struct(*emitted).alias("N")).join(was, KEY)
            back = back.select(KEY, F.col(f"__was.{UNIT}").alias(UNIT), *(value(c).alias(c) for c in node.names), F.lit("changed").alias(OP), F.col("__was").alias(BEFORE), F.lit(True).alias("__revived"))
            verdicts = verdicts.join(back.select(KEY), KEY, "left_anti").unionByName(back)
    parts.append(verdicts)
    gone_keep = 0
    if observed == "all":
        vanished = live.select(KEY).join(observed_keys, KEY, "left_anti")
        rows = stored.join(vanished, KEY, "left_semi")
        before = F.struct(UNIT, *node.names)
        if policy == "destroy":
            parts.append(rows.select(*HIDDEN, *node.names, F.lit("retired").alias(OP), before.alias(BEFORE), F.lit(False).alias("__revived")))
        elif callable(policy):
            marked = engine._keyed(node, policy(rows.select(node.names)))
            names = [c for c in marked.columns if c in node.names and c not in node.primary_key]
            old = rows.select(KEY, F.struct(UNIT, *node.names).alias("__was"))
            marked = marked.select(KEY, F.struct(*names).alias("N")).join(old, KEY)
            parts.append(marked.select(KEY, F.col(f"__was.{UNIT}").alias(UNIT), *((F.col(f"N.{c}") if c in names else F.col(f"__was.{c}")).alias(c) for c in node.names), F.lit("changed").alias(OP), F.col("__was").alias(BEFORE), F.lit(False).alias("__revived")).withColumn("__marked", F.lit(True)))
    change = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "__marked" not in change.columns:
        change = change.withColumn("__marked", F.lit(False))
    change = change.withColumn("__marked", F.coalesce("__marked", F.lit(False)))
    extra = engine.store.new_path(cell, "scan")
    change.write.parquet(extra)
    change = engine.spark.read.parquet(extra)
    counts = change.agg(
        F.count_if(F.col(OP) == "created").alias("created"),
        F.count_if((F.col(OP) == "changed") & ~F.col("__revived") & ~F.col("__marked")).alias("updated"),
        F.count_if("__revived").alias("revived"),
        F.count_if((F.col(OP) == "retired") | F.col("__marked")).alias("retired"),
    ).first().asDict()
    draft = engine.store.draft()
    added = engine._add(draft, cell, change.drop("__revived", "__marked").select(*HIDDEN, *node.names, OP, BEFORE))
    n = sum(counts.values()) + gone_keep
    if n and mark:
        engine._mark(draft, cell, ref={"from": cell, "kind": "change", "path": added["path"]}, reason="scan")
    if added["rows"]:
        engine.store.commit(draft)
        engine.store.compact(cell, node.schema)
    changed = engine._sample(change.where(F.col(OP) != "touched"), KEY) if n else []
    return Reconciled(changed, counts)


def _key(node):
    from ..functions.keys import identity_of

    return identity_of(node.primary_key)


def invalidate(engine, cell: str, keys=None) -> list[str]:
    """Clear the stored fingerprint of rows, so that their next recompute calls again; the keys that had one."""
    node = engine.node(cell)
    c = node.computation
    attribute = getattr(c, "fingerprint_attribute", None) or node.fingerprint_attribute or "fingerprint"
    if attribute not in node.names:
        return []
    rows = engine.rows(cell).where(F.col(attribute).isNotNull())
    if keys is not None:
        wanted = keys.select(F.col("key").alias(KEY)) if isinstance(keys, DataFrame) else engine.spark.createDataFrame([(k,) for k in keys], f"{KEY} string")
        rows = rows.join(wanted, KEY, "left_semi")
    before = F.struct(UNIT, *node.names)
    change = rows.select(*HIDDEN, *(F.lit(None).cast(f.dataType).alias(f.name) if f.name == attribute else F.col(f.name) for f in node.schema), F.lit("touched").alias(OP), before.alias(BEFORE))
    draft = engine.store.draft()
    added = engine._add(draft, cell, change)
    if added["rows"]:
        engine.store.commit(draft)
    return engine._sample(engine.store.changes(added["path"], node.schema), KEY) if added["rows"] else []
