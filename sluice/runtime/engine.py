"""The engine: writes, the dirty set, claims, and the drain.

The dirty set lists, per cell, references to what changed (a child's change file or a file of keys), never
keys themselves, so marking a cell costs no job and the driver holds names only. A claim is worked out from
the references when the cell's turn comes: the units of the rows before and after the change. So a row that moved
from one unit to another, or was deleted, dirties exactly the units concerned.
"""

from __future__ import annotations

import copy
import logging
import threading
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import BAR, WHOLE, fingerprint, identity_of
from ..operators.produce import Claims, Context, Produced, group_exprs, join_key, on_side, produce, with_calculations
from ..plans.graph import graph
from ..plans.model import CELL, Aggregate, CellFailed, Join, Node, NodeError, PerKey, Plan, Reduce, Union
from .diff import diff, lapse_units, moved_since, watched
from .report import Events, Report, Step
from .store import BEFORE, HIDDEN, KEY, OP, UNIT, Busy, Store, rebased

log = logging.getLogger(__name__)
FEW = 4000  # claimed units that are worked with as values
DIFFER = "rows that differ have the key "
REPORTED = ("created", "changed", "retired")


class Runaway(RuntimeError):
    """A drain that does not end; ``report`` has what it did."""

    def __init__(self, report: Report, passes: int):
        super().__init__(f"the drain did not end within {passes} passes; is a cell dirtying itself?")
        self.report = report


class Engine:
    """One tenant's tables.

    trace: most keys a report lists per cell; 0 to skip the small jobs that list them. escalate_whole: a cell
    recomputed whole dirties its consumers wholly, rather than by what changed.
    """

    def __init__(self, spark: SparkSession, nodes: Iterable[Node] | Plan, root: str, tenant: str = "*", trace: int = 100, escalate_whole: bool = False, for_each=None, key_rule=None):
        self.spark = spark
        self.plan = nodes if isinstance(nodes, Plan) else graph(nodes, for_each, tenant)
        self.tenant = self.plan.tenant if tenant == "*" else tenant
        self.store = Store(spark, root, self.tenant)
        self.trace, self.escalate_whole, self.key_rule = trace, escalate_whole, key_rule
        self.events = Events()
        self.on_schedule = None
        self.running: set[tuple[str, int]] = set()  # cells at work, and their threads

    # -- reading --

    def node(self, name: str) -> Node:
        cell = self.plan.cells.get(name)
        if cell is None:
            raise NodeError(f"no cell {name!r} in this plan")
        return cell.meta["node"]

    def inputs(self, cell: str) -> tuple[str, ...]:
        return self.plan.cells[cell].inputs

    def owner(self, cell: str) -> str:
        """The cell that holds a cell's rows: a view shows those of its set."""
        c = self.plan.cells[cell]
        return c.inputs[0] if c.op == "view" else cell

    def rows(self, cell: str) -> DataFrame:
        """A cell's rows with hidden key and unit."""
        node = self.node(cell)
        if node.columns is None:
            raise NodeError(f"{cell!r} has no rows of its own")
        return self.store.rows(self.owner(cell), node.schema)

    def table(self, cell: str) -> DataFrame:
        self.store.refresh()
        return self.rows(cell).select(self.node(cell).names)

    # -- the dirty set --

    def _mark(self, draft: dict, cell: str, whole: bool = False, ref: dict | None = None, reason: str = "") -> None:
        found = draft["dirty"].setdefault(cell, {"whole": False, "refs": [], "causes": [], "since": time.time(), "reason": reason})
        found["whole"] |= whole
        if ref and ref not in found["refs"]:
            found["refs"].append(ref)
        cause = ref["from"] if ref and ref["from"] != cell else reason
        if cause and cause not in found["causes"]:
            found["causes"].append(cause)

    def mark(self, cell: str, keys: str | Iterable[str] | DataFrame = WHOLE, reason: str = "") -> None:
        """Dirty a cell: wholly, or by keys (strings, or a DataFrame with a column ``key``). No keys: nothing happens."""
        self.store.refresh()
        base, draft = self.store.state, self.store.draft()
        if self._mark_keys(draft, cell, cell, keys, reason):
            self.store.commit(draft, base)

    def _mark_keys(self, draft: dict, cell: str, source: str, keys, reason: str = "") -> bool:
        if (cell, threading.get_ident()) in self.running:  # what a cell marks of itself while it runs is taken up with its claim
            return False
        if isinstance(keys, DataFrame):
            frame = keys.select(F.col("key").cast("string").alias(KEY)).distinct()
        else:
            keys = [keys] if isinstance(keys, str) else sorted(set(keys))
            if not keys:
                return False
            if WHOLE in keys:
                self._mark(draft, cell, whole=True, reason=reason)
                return True
            frame = self.spark.createDataFrame([(k,) for k in keys], f"{KEY} string")
        path = self.store.new_path(source, "keys")
        frame.write.parquet(path)
        self._mark(draft, cell, ref={"from": source, "kind": "keys", "path": path}, reason=reason)
        return True

    def mark_parents(self, cell: str, keys: str | Iterable[str] | DataFrame = WHOLE) -> list[str]:
        """Dirty a cell's consumers as if its ``keys`` had changed; returns the consumers."""
        self.store.refresh()
        base, draft = self.store.state, self.store.draft()
        parents = self.plan.parents.get(cell, ())
        hit = [p for p in parents if self._mark_keys(draft, p, cell, keys)]
        if hit:
            self.store.commit(draft, base)
        return hit

    @property
    def pending_drain(self) -> bool:
        """Whether a write has asked for a drain that has not begun; part of the write's commit."""
        self.store.refresh()
        return bool(self.store.state.get("scheduled"))

    def dirty_cells(self) -> list[str]:
        """Dirty cells, the shallowest first, those unknown to the plan last."""
        self.store.refresh()
        depth = lambda c: (c not in self.plan.depths, self.plan.depths.get(c, 0), c)
        return sorted(self.store.state["dirty"], key=depth)

    def next_cell(self, but: Iterable[str] = ()) -> str | None:
        return next((c for c in self.dirty_cells() if c not in set(but)), None)

    def is_clean(self) -> bool:
        self.store.refresh()
        return not self.store.state["dirty"]

    # -- writes --

    def _keyed(self, node: Node, rows: DataFrame, order: str | None = None) -> DataFrame:
        missing = [k for k in node.primary_key if k not in rows.columns]
        if missing:
            raise NodeError(f"{node.id!r}: rows without identity column {missing[0]!r}")
        extra = [c for c in rows.columns if c not in node.names and c != order]
        if extra:
            raise NodeError(f"{node.id!r}: rows with unknown column {extra[0]!r}")
        rows = rows.withColumn(KEY, identity_of(node.primary_key))
        return rows.withColumn(UNIT, F.col(KEY))

    def _one_per_key(self, node: Node, rows: DataFrame, order: str | None = None) -> DataFrame:
        """One row per key, the last by ``order``; without one, a key with rows that differ fails the job."""
        kept = [c for c in rows.columns if c not in (KEY, order)]
        pick = F.max_by(F.struct(*kept), order) if order else F.any_value(F.struct(*kept))
        one = rows.groupBy(KEY).agg(pick.alias("r"), *([] if order else [(F.min(F.xxhash64(*kept)) != F.max(F.xxhash64(*kept))).alias("d")]))
        if not order:
            one = one.where(F.when(F.col("d"), F.raise_error(F.concat(F.lit(DIFFER), F.col(KEY))).cast("boolean")).otherwise(True))
        return one.select(KEY, *(F.col(f"r.{c}").alias(c) for c in kept))

    def write(self, cell: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, mark: bool = True, reason: str = "write", order: str | None = None) -> dict:
        """Ordinary writes to a node: rows and marks in one commit. deletes: rows with the primary key's columns.

        Returns how many rows were created, changed and retired. Without the matching entry in
        ``dirties_on`` a kind of change is written but marks nothing. Of several rows with one key that with the largest
        ``order`` (a further column of ``upserts``) counts; without one, such rows must be equal, or nothing is written. A key that is
        deleted in the same write is gone. A write beside
        another writer of the same cell is worked out again on that one's rows.
        """
        for again in range(8):
            self.store.refresh()
            try:
                return self._write(cell, upserts, deletes, mark, reason, order)
            except Busy:
                if again == 7:
                    raise
                time.sleep(0.1 * (again + 1))
        raise AssertionError

    def _write(self, cell: str, upserts: DataFrame | None, deletes: DataFrame | None, mark: bool, reason: str, order: str | None) -> dict:
        node, base = self.node(cell), self.store.state
        prior, parts = self.rows(cell), []
        if upserts is not None:
            new = self._one_per_key(node, self._keyed(node, upserts, order), order)
            if deletes is not None:
                new = new.join(deletes.select(identity_of(node.primary_key).alias(KEY)), KEY, "left_anti")
            new = self._with_fingerprint(node, new)
            emitted = [c for c in new.columns if c in node.names]
            parts.append(diff(node, new, prior.join(new.select(KEY), KEY, "left_semi"), emitted, retire=False, lapses=False))
        if deletes is not None:
            gone = deletes.select(identity_of(node.primary_key).alias(KEY)).distinct()
            old = prior.join(gone, KEY, "left_semi")
            before = F.struct(UNIT, *node.names)
            parts.append(old.select(*HIDDEN, *node.names, F.lit("retired").alias(OP), before.alias(BEFORE)))
        if not parts:
            return {}
        change = reduce(DataFrame.unionByName, parts)
        draft = self.store.draft()
        counts = self._add(draft, cell, change)
        kinds = {"created": "create", "changed": "update", "retired": "destroy"}
        if mark and any(counts[k] and v in node.dirties_on for k, v in kinds.items()):
            ops = [k for k, v in kinds.items() if v in node.dirties_on]
            self._mark(draft, cell, ref={"from": cell, "kind": "change", "path": counts["path"], "ops": ops}, reason=reason)
        if mark and node.schedule_drain:
            draft["scheduled"] = True
        if counts["rows"] or draft.get("scheduled") != base.get("scheduled"):
            self.store.commit(draft, base)
        if counts["rows"]:
            self.store.compact(cell, node.schema)
        if mark and node.schedule_drain:
            try:
                if self.on_schedule:
                    self.on_schedule(self)
            except Exception:
                log.exception("scheduling a drain failed")
        return {k: counts[k] for k in REPORTED}

    def annotate(self, cell: str, rows: DataFrame) -> dict:
        """Human marks on a computed node: the primary key and columns of ``augmented_by``. Only rows that exist take them."""
        self.store.refresh()
        node, base = self.node(cell), self.store.state
        names = [c for c in rows.columns if c not in node.primary_key]
        refused = [c for c in names if c not in node.augmented_by]
        if refused:
            raise NodeError(f"{cell!r}: {refused[0]!r} is not among its augmented_by columns")
        known = self._keyed(node, rows).join(self.rows(cell).select(KEY), KEY, "left_semi")
        change = diff(node, known.join(self.rows(cell).select(KEY, F.col(UNIT).alias("u")), KEY).withColumn(UNIT, F.col("u")).drop("u"), self.rows(cell).join(known.select(KEY), KEY, "left_semi"), names, retire=False, lapses=False)
        draft = self.store.draft()
        counts = self._add(draft, cell, change)
        if counts["rows"]:
            ref = {"from": cell, "kind": "change", "path": counts["path"]}
            for p in self.plan.parents.get(cell, ()):
                self._mark(draft, p, ref=ref, reason="annotate")
            self.store.commit(draft, base)
        return {k: counts[k] for k in REPORTED}

    def _with_fingerprint(self, node: Node, rows: DataFrame) -> DataFrame:
        made = fingerprint(node.fingerprint) if node.fingerprint is not None else None
        if made is None:
            return rows
        attribute = node.fingerprint_attribute or "fingerprint"
        if not callable(node.fingerprint) and any(f not in rows.columns for f in node.fingerprint):
            return rows
        return rows.withColumn(attribute, made)

    def _add(self, draft: dict, cell: str, change: DataFrame) -> dict:
        """Write a change file (one job) and put it in the draft; counts come with the write."""
        seen = Observation()
        path = self.store.new_path(cell, "change")
        ops = (*REPORTED, "touched")
        try:
            self._observed(change, seen, ops, path)
        except Exception as e:
            if DIFFER in str(e):
                key = str(e).partition(DIFFER)[2].split("\n")[0].split("'")[0]
                raise NodeError(f"{cell!r}: rows that differ have one key, {key.strip()!r}; give a write an order") from None
            raise
        counts = {k: v or 0 for k, v in seen.get.items()} | {"path": path}
        if counts["rows"]:
            self.store.add_change(draft, cell, path, counts["rows"], counts["created"], counts["retired"])
        else:
            draft["cells"].setdefault(cell, {"base": None, "base_rows": 0, "changes": [], "changed_rows": 0, "rows": 0})
        return counts

    @staticmethod
    def _observed(change: DataFrame, seen: Observation, ops: tuple, path: str) -> None:
        change.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(OP) == k).alias(k) for k in ops)).write.parquet(path)

    # -- claims --

    def _images(self, ref: dict) -> DataFrame | None:
        """Rows of a child before and after a change, or its rows with some keys; None where a key has no row."""
        child = ref["from"]
        node = self.node(child)
        if ref["kind"] == "change":
            changes = self.store.changes(ref["path"], node.schema).where(F.col(OP).isin(ref.get("ops") or list(REPORTED)))
            after = changes.where(F.col(OP) != "retired").select(*HIDDEN, *node.names)
            before = changes.where(F.col(BEFORE).isNotNull()).select(KEY, f"{BEFORE}.*").select(*HIDDEN, *node.names)
            return after.unionByName(before)
        keys = self.spark.read.parquet(ref["path"])
        rows = self.rows(child)
        if not keys.join(rows.select(KEY), KEY, "left_anti").isEmpty():
            return None
        return rows.join(keys, KEY, "left_semi")

    def _units(self, cell: str, ref: dict) -> DataFrame | str:
        """What a reference claims of a cell: units, or everything."""
        node = self.node(cell)
        c = node.computation
        child = ref["from"]
        if child == cell:
            if ref["kind"] == "change":
                return self.store.changes(ref["path"], node.schema).where(F.col(OP).isin(ref.get("ops") or list(REPORTED))).select(F.col(KEY).alias(UNIT))
            keys, prefix = self.spark.read.parquet(ref["path"]), getattr(c, "key_prefix", None)
            plain = F.col(KEY)
            if prefix:
                plain = F.when(plain.startswith(prefix + BAR), F.substr(plain, F.lit(len(prefix) + 2))).otherwise(plain)
            return keys.select(plain.alias(UNIT))
        rule = node.key_rule if node.key_rule is not None else self.key_rule
        if rule == "all" or node.recompute_by and node.recompute_by.unit == CELL:
            return WHOLE
        whole_group = isinstance(c, Reduce) and node.recompute_by and node.recompute_by.from_key
        images = self._images(ref) if not whole_group else self._changed_keys(ref)
        if images is None:
            return WHOLE
        if callable(rule):
            made = rule(child, with_calculations(self.node(child), images), node)
            return made if isinstance(made, str) else made.select(F.col("key").alias(UNIT))
        if rule == "identity":
            return images.select(F.col(KEY).alias(UNIT))
        if isinstance(c, Reduce) and child == c.over:
            if not whole_group:
                images = with_calculations(self.node(child), images)
            units = images.select(identity_of([e for _, e in group_exprs(node, c)]).alias(UNIT), *(e.isNull().alias(f"__n{i}") for i, (_, e) in enumerate(group_exprs(node, c))))
            if whole_group and not units.where("__n0").isEmpty():
                return WHOLE
            return units.select(UNIT)
        if isinstance(c, Join):
            images = with_calculations(self.node(child), images)
            sides = [s for s, name in ((c.left, c.left_over or c.over), (c.right, c.right_over or c.over)) if name == child]
            if not sides:
                return WHOLE
            parts = [on_side(images, s).select(identity_of([join_key(s)]).alias(UNIT)) for s in sides]
            return reduce(DataFrame.unionByName, parts)
        if isinstance(c, Union):
            return images.select(F.concat_ws(BAR, F.lit(child), F.col(KEY)).alias(UNIT))
        if isinstance(c, Aggregate):
            if child != c.over:
                return WHOLE
            images = with_calculations(self.node(child), images)
            return images.select(identity_of([c.key] if isinstance(c.key, str) else c.key).alias(UNIT))
        if isinstance(c, PerKey) or c is None or child in self.inputs(cell):
            return images.select(F.col(KEY).alias(UNIT))
        return WHOLE

    def _changed_keys(self, ref: dict) -> DataFrame:
        if ref["kind"] == "keys":
            return self.spark.read.parquet(ref["path"])
        return self.store.changes(ref["path"], self.node(ref["from"]).schema).where(F.col(OP).isin(list(REPORTED))).select(KEY)

    def claims(self, cell: str) -> Claims:
        """What the dirty set claims of a cell; ``*`` subsumes all else."""
        found = self.store.state["dirty"].get(cell, {"whole": False, "refs": []})
        if found["whole"]:
            return Claims(True)
        units, legs = [], set()
        for ref in found["refs"]:
            made = self._units(cell, ref)
            if isinstance(made, str):
                return Claims(True)
            units.append(made)
            legs.add(ref["from"])
        if not units:
            return Claims(False, self.spark.createDataFrame([], f"{UNIT} string"), set())
        claimed = reduce(DataFrame.unionByName, units).distinct()
        if cell in legs and isinstance(self.node(cell).computation, Union):
            legs = None
        few = [r[0] for r in claimed.limit(FEW + 1).collect()]
        if len(few) > FEW:
            return Claims(False, claimed, legs)
        table = pa.table({UNIT: pa.array(few, pa.string())})
        return Claims(False, self.spark.createDataFrame(table, f"{UNIT} string"), legs, few)

    # -- one cell --

    def recompute(self, cell: str, keys: str | Iterable[str] | None = None, draft: dict | None = None) -> Step:
        """Recompute a cell for its claim in the dirty set (or for ``keys``), and commit rows, marks and claim together."""
        if keys is not None:
            self.mark(cell, keys)
        return self._recompute(cell, ())

    def _recompute(self, cell: str, force: Iterable[str]) -> Step:
        began = time.perf_counter()
        node, state = self.node(cell), self.store.state
        found = state["dirty"].get(cell, {"whole": False, "refs": [], "causes": []})
        base, draft = state, self.store.draft()
        draft["dirty"].pop(cell, None)
        causes = list(found["causes"])
        meta: dict = {}
        if node.computation is None:
            step = self._pass_through(draft, cell, node, found)
        else:
            claims, own = self.claims(cell), (cell, threading.get_ident())
            self.running.add(own)
            try:
                made = produce(Context(self, cell, node, claims))
            finally:
                self.running.discard(own)
            if self.store.state is not state:  # it wrote for itself: those commits are kept, and the claim goes with ours
                draft = rebased(base, draft, self.store.state)
                base = self.store.state
            if isinstance(made, Produced):
                meta = made.meta
                step = self._materialize(draft, cell, node, claims, made, force)
            else:
                step = self._own_writes(draft, cell, node, claims, made)
        self.store.commit(draft, base)
        if node.columns is not None and node.computation is not None:
            self.store.compact(cell, node.schema)
        step.causes, step.meta = [c for c in causes if c in self.plan.cells], {**step.meta, **meta}
        step.depth, step.duration_us = self.plan.depths[cell], int((time.perf_counter() - began) * 1e6)
        return step

    def _pass_through(self, draft: dict, cell: str, node: Node, found: dict) -> Step:
        """A leaf, or a node without computation: what was claimed is what changed."""
        for p in self.plan.parents.get(cell, ()):
            if found["whole"] or not self.store.known(self.owner(p)) and self.node(p).columns is not None:
                self._mark(draft, p, whole=True, ref=None, reason=cell)
            else:
                for ref in found["refs"]:
                    own = {**ref, "from": cell} if node.columns is not None else ref
                    self._mark(draft, p, ref=own, reason=cell)
            if found["whole"] and cell not in draft["dirty"][p]["causes"]:
                draft["dirty"][p]["causes"].append(cell)
        keys = [WHOLE] if found["whole"] else self._sample(reduce(DataFrame.unionByName, [self._changed_keys(r) if r["kind"] == "keys" or r["from"] in self.plan.cells and self.node(r["from"]).columns is not None else self.spark.createDataFrame([], f"{KEY} string") for r in found["refs"]]), KEY) if found["refs"] and self.trace else []
        return Step(cell, None, keys, keys, len(keys), [])

    def _sample(self, rows: DataFrame, column: str) -> list[str]:
        if not self.trace:
            return []
        return [r[0] for r in rows.select(column).distinct().orderBy(column).limit(self.trace).collect()]

    def _materialize(self, draft: dict, cell: str, node: Node, claims: Claims, made: Produced, force: Iterable[str]) -> Step:
        new, emitted = made.rows, list(made.emitted)
        if node.fingerprint is not None:
            new = self._with_fingerprint(node, new)
            attribute = node.fingerprint_attribute or "fingerprint"
            emitted += [attribute] if attribute in new.columns and attribute not in emitted else []
        prior = self.rows(cell)
        change = diff(node, new, claims.scope(prior), emitted, forced=made.forced, retire=not isinstance(node.computation, Aggregate))
        if any(x.over and x.target in node.names for x in node.lapses):
            change = lapse_units(node, change, prior, emitted)
        counts = self._add(draft, cell, change)
        n = sum(counts[k] for k in REPORTED)
        ref = {"from": cell, "kind": "change", "path": counts["path"]}
        forced_keys = None
        if (cell in force or force == "all") and not claims.whole:
            forced_keys = self.store.new_path(cell, "keys")
            claims.scope(prior).select(KEY).unionByName(new.select(KEY)).distinct().write.parquet(forced_keys)
        for p in self.plan.parents.get(cell, ()):
            unseen = not self.store.known(self.owner(p)) and self.node(p).columns is not None
            if claims.whole and (self.escalate_whole or unseen or cell in force or force == "all"):
                self._mark(draft, p, whole=True, reason=cell)
            elif n:
                self._mark(draft, p, whole=unseen, ref=ref, reason=cell)
            if forced_keys:
                self._mark(draft, p, ref={"from": cell, "kind": "keys", "path": forced_keys}, reason=cell)
            if p in draft["dirty"] and cell not in draft["dirty"][p]["causes"] and (n or forced_keys or claims.whole and self.escalate_whole):
                draft["dirty"][p]["causes"].append(cell)
        self._lapse_children(draft, cell, node, counts, emitted)
        changed = self._sample(self.store.changes(counts["path"], node.schema).where(F.col(OP).isin(list(REPORTED))), KEY) if n else []
        claimed = [WHOLE] if claims.whole else self._sample(claims.units, UNIT)
        prefix = getattr(node.computation, "key_prefix", None)
        if prefix and not claims.whole:
            claimed = [f"{prefix}{BAR}{k}" for k in claimed]
        return Step(cell, None, claimed, changed, n, [], meta={k: counts[k] for k in (*REPORTED, "touched")})

    def _lapse_children(self, draft: dict, cell: str, node: Node, counts: dict, emitted: list[str]) -> None:
        """Delete another node's rows that hang on keys (or units) whose watched columns moved. A failure is logged, and the recompute goes on."""
        for lapse in node.lapses:
            if lapse.target in node.names or not counts["changed"] + counts["touched"]:
                continue
            before = copy.deepcopy(draft)
            try:
                self._lapse_child(draft, cell, node, lapse, counts, emitted)
            except Exception as e:
                draft.clear()
                draft.update(before)
                log.exception("clearing %r of %r failed", lapse.target, cell)
                self.events.emit("lapse.failed", cell=cell, target=lapse.target, error=e)

    def _lapse_child(self, draft: dict, cell: str, node: Node, lapse, counts: dict, emitted: list[str]) -> None:
        child = self.node(lapse.target)
        hit = self.store.changes(counts["path"], node.schema).where(moved_since(watched(node, lapse, emitted)))
        over = [lapse.over] if isinstance(lapse.over, str) else list(lapse.over or ())
        keys = hit.select((identity_of(over) if over else F.col(KEY)).alias("__k")).distinct()
        own = identity_of([lapse.key]) if len(over or node.primary_key) == 1 else F.col(lapse.key).cast("string")
        old = self.rows(lapse.target).join(keys, own == F.col("__k"), "left_semi")
        before = F.struct(UNIT, *child.names)
        gone = self._add(draft, lapse.target, old.select(*HIDDEN, *child.names, F.lit("retired").alias(OP), before.alias(BEFORE)))
        if gone["rows"]:
            for p in self.plan.parents.get(lapse.target, ()):
                self._mark(draft, p, ref={"from": lapse.target, "kind": "change", "path": gone["path"]}, reason=lapse.target)

    def _own_writes(self, draft: dict, cell: str, node: Node, claims: Claims, made) -> Step:
        """A computation that returned rows to upsert, or the keys that it changed by its own writes."""
        claimed = [WHOLE] if claims.whole else self._sample(claims.units, UNIT)
        if made is None or not isinstance(made, (DataFrame, list, tuple, set)):
            raise TypeError(f"{cell!r}: its computation returned {type(made).__name__}; it returns changed keys (a list, or a DataFrame with a column key) or rows")
        if isinstance(made, DataFrame) and node.columns is not None and len(made.columns) > 1:
            rows = self._one_per_key(node, self._keyed(node, made))
            return self._materialize_rows(draft, cell, node, claims, rows, claimed)
        if isinstance(made, DataFrame):
            made = made.select("key")
        elif any(not isinstance(k, str) for k in made):
            raise TypeError(f"{cell!r}: its computation returned keys that are no strings")
        for p in self.plan.parents.get(cell, ()):
            if claims.whole:
                self._mark(draft, p, whole=True, reason=cell)
            else:
                self._mark_keys(draft, p, cell, made)
        keys = self._sample(made, "key") if isinstance(made, DataFrame) else sorted(set(made))[: self.trace or None]
        return Step(cell, None, claimed, keys, len(keys), [])

    def _materialize_rows(self, draft: dict, cell: str, node: Node, claims: Claims, rows: DataFrame, claimed: list[str]) -> Step:
        emitted = [c for c in rows.columns if c in node.names]
        prior = self.rows(cell).join(rows.select(KEY), KEY, "left_semi")
        counts = self._add(draft, cell, diff(node, rows, prior, emitted, retire=False))
        n = counts["created"] + counts["changed"]
        for p in self.plan.parents.get(cell, ()) if n else ():
            self._mark(draft, p, ref={"from": cell, "kind": "change", "path": counts["path"]}, reason=cell)
        changed = self._sample(self.store.changes(counts["path"], node.schema).where(F.col(OP).isin(list(REPORTED))), KEY) if n else []
        return Step(cell, None, claimed, changed, n, [])

    # -- the drain --

    def drain(self, max_passes: int = 100_000, force: str | Iterable[str] = (), workers: int = 1) -> Report:
        """Recompute dirty cells, the shallowest first, until none is left that can be.

        CellFailed leaves its cell dirty and goes on; any other exception ends the drain. Either way that cell has
        committed nothing. force: cells ("all" for every one) whose claimed keys reach their consumers though no value moved.
        workers: how many cells of one depth, which cannot read each other, are at work at once.
        """
        force = force if force == "all" else {force} if isinstance(force, str) else set(force)
        report, failed, began = Report(), set(), time.perf_counter()
        self.store.refresh()
        if self.store.state.get("scheduled"):
            base, draft = self.store.state, self.store.draft()
            draft["scheduled"] = False
            self.store.commit(draft, base)
        self.events.emit("drain.start", tenant=self.tenant)
        try:
            while (cell := self.next_cell(failed)) is not None:
                if report.passes >= max_passes:
                    raise Runaway(report, max_passes)
                report.passes += 1
                if cell not in self.plan.cells:
                    log.warning("dropping the marks of %r, which is not in the plan", cell)
                    base, draft = self.store.state, self.store.draft()
                    draft["dirty"].pop(cell)
                    self.store.commit(draft, base)
                    continue
                depth = self.plan.depths[cell]
                level = [c for c in self.dirty_cells() if c not in failed and self.plan.depths.get(c) == depth][: min(workers, max_passes - report.passes + 1)]
                report.passes += len(level) - 1
                if len(level) == 1:
                    outcomes = [self._attempt(cell, force)]
                else:
                    with ThreadPoolExecutor(len(level)) as pool:
                        outcomes = list(pool.map(lambda c: self._attempt(c, force), level))
                for c, (step, error) in zip(level, outcomes, strict=True):
                    if error is None:
                        report.steps.append(step)
                        self.events.emit("drain.step", step=step)
                    elif isinstance(error, CellFailed):
                        failed.add(c)
                        causes = list(self.store.state["dirty"].get(c, {}).get("causes", []))
                        report.steps.append(Step(c, depth, [], [], 0, causes, meta={"error": str(error)}, status="failed"))
                        self.events.emit("drain.cell_failed", cell=c, error=error)
                broken = next((e for _, e in outcomes if e is not None and not isinstance(e, CellFailed)), None)
                if broken:
                    raise broken
        except Exception as e:
            report.duration_us = int((time.perf_counter() - began) * 1e6)
            self.events.emit("drain.exception", error=e, report=report)
            raise
        report.duration_us = int((time.perf_counter() - began) * 1e6)
        self.events.emit("drain.stop", report=report)
        return report

    def _attempt(self, cell: str, force) -> tuple[Step | None, Exception | None]:
        try:
            return self._recompute(cell, force), None
        except Exception as e:
            return None, e

    def locked_drain(self, **options) -> Report:
        """A drain that no other holder of the lock runs beside; raises Busy if one does."""
        with self.store.lock():
            return self.drain(**options)

    def seed(self) -> Report:
        """Dirty all leaves wholly and drain."""
        self.store.refresh()
        base, draft = self.store.state, self.store.draft()
        for c in self.plan.cells.values():
            if c.leaf or not c.inputs:
                self._mark(draft, c.id, whole=True, reason="seed")
        self.store.commit(draft, base)
        return self.drain()


__all__ = ["CellFailed", "Engine", "Runaway", "T"]
