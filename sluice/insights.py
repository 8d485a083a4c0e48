"""What is in the graph, how it stands, and what ran; status roll-ups."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime.store import KEY

FAILING, WAITING = ("failing",), ("pending", "stale")


@dataclass(frozen=True)
class Verdict:
    status: str
    failing: int = 0
    pending: int = 0
    sample: tuple[str, ...] = ()


def rollup(histogram: Mapping[str | None, int], sample: Iterable[str] = ()) -> Verdict:
    """findings if anything fails, pending if anything waits, unknown if there is nothing, else green."""
    failing = sum(histogram.get(s, 0) for s in FAILING)
    waiting = sum(histogram.get(s, 0) for s in WAITING)
    total = sum(histogram.values())
    status = "unknown" if not total else "findings" if failing else "pending" if waiting else "green"
    return Verdict(status, failing, waiting, tuple(sample))


def roll_group(statuses: Iterable[str]) -> str:
    """The gravest: findings, then pending, then green; unknown if there is none of them."""
    rank = {"findings": 3, "pending": 2, "green": 1}
    return max(statuses, key=lambda s: rank.get(s, 0), default="unknown")


def verdict_columns(status: str = "status") -> list:
    """The roll-up as aggregates, for use inside a plan."""
    failing, waiting = F.count_if(F.col(status).isin(*FAILING)), F.count_if(F.col(status).isin(*WAITING))
    verdict = F.when(F.count(F.lit(1)) == 0, "unknown").when(failing > 0, "findings").when(waiting > 0, "pending").otherwise("green")
    return [verdict.alias("verdict"), failing.alias("failing"), waiting.alias("pending")]


def status_histogram(rows: DataFrame, column: str = "status") -> DataFrame:
    """status, n; one null status where there is no such column."""
    status = F.col(column) if column in rows.columns else F.lit(None).cast("string")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def key_count(engine, cell: str) -> int:
    return engine.rows(cell).count()


def keys_by_status(engine, cell: str, statuses: Iterable[str | None], limit: int | None = None) -> DataFrame:
    """Sorted keys (column ``key``) of rows with one of the statuses, null among them if asked for."""
    statuses = list(statuses)
    rows = engine.rows(cell)
    if not statuses or "status" not in engine.node(cell).names:
        return rows.where(F.lit(False)).select(F.col(KEY).alias("key"))
    named = [s for s in statuses if s is not None]
    wanted = F.col("status").isin(named) if named else F.lit(False)
    rows = rows.where(wanted | F.col("status").isNull() if None in statuses else wanted).select(F.col(KEY).alias("key")).orderBy("key")
    return rows.limit(limit) if limit else rows


def keys_where(engine, cell: str, limit: int | None = None, **equal) -> DataFrame:
    """Sorted keys (column ``key``) of rows whose columns equal the given values."""
    rows = engine.rows(cell)
    for c, v in equal.items():
        rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
    rows = rows.select(F.col(KEY).alias("key")).orderBy("key")
    return rows.limit(limit) if limit else rows


def verdict_for(engine, cell: str, sample: int = 5) -> Verdict:
    """A cell's verdict, with the first failing keys."""
    histogram = {r.status: r.n for r in status_histogram(engine.rows(cell)).collect()}
    return rollup(histogram, [r.key for r in keys_by_status(engine, cell, FAILING, sample).collect()])


def levels(plan) -> list[list[str]]:
    out: dict[int, list[str]] = {}
    for c in plan.order:
        out.setdefault(plan.depths[c], []).append(c)
    return [out[d] for d in sorted(out)]


def edges(plan) -> list[tuple[str, str]]:
    return sorted((i, c.id) for c in plan.cells.values() for i in c.inputs)


def cell_status(engine, cell: str, sample: int = 10) -> dict:
    """rows: stored, elsewhere (no table of its own) or unreadable."""
    node, plan = engine.node(cell), engine.plan
    out = {"cell": cell, "depth": plan.depths[cell], "leaf": plan.cells[cell].leaf, "inputs": list(plan.cells[cell].inputs), "dirty": cell in engine.store.state["dirty"]}
    if node.columns is None:
        return out | {"rows": "elsewhere"}
    try:
        histogram = {r.status: r.n for r in status_histogram(engine.rows(cell)).collect()}
        failing = [r.key for r in keys_by_status(engine, cell, FAILING, sample).collect()]
    except Exception as e:  # noqa: BLE001 - a status page shows what it can
        return out | {"rows": "unreadable", "error": str(e)[:200]}
    return out | {"rows": "stored", "count": sum(histogram.values()), "histogram": histogram, "verdict": rollup(histogram, failing)}


def summary(engine) -> list[dict]:
    """Status of all cells by depth and id; for graphs of some tens of cells."""
    return [cell_status(engine, c) for c in engine.plan.order]


def pending(engine) -> list[dict]:
    return [{"cell": c, **{k: v for k, v in engine.store.state["dirty"][c].items() if k in ("whole", "causes", "since", "reason")}} for c in engine.dirty_cells()]


@dataclass
class ScanRun:
    """A scan: what the polls found, and what the drain made of it."""

    results: dict = field(default_factory=dict)
    report: object = None

    @property
    def changed(self) -> bool:
        return any(getattr(r.changed, "counts", None) and sum(r.changed.counts.values()) or (r.changed if not hasattr(r.changed, "counts") else False) for r in self.results.values())

    @property
    def drained(self) -> bool:
        return self.report is not None

    @property
    def complete(self) -> bool:
        return all(r.ok and not r.unreachable for r in self.results.values()) and self.drained and all(s.status == "ok" for s in self.report.steps)

    def total(self, name: str) -> float:
        from .sources.polling import detail_total

        return detail_total(self.results.values(), name) + (self.report.total(name) if self.report else 0)

    def by(self, name: str) -> dict:
        from .sources.polling import detail_by

        out = detail_by(self.results.values(), name)
        for k, v in (self.report.by(name) if self.report else {}).items():
            out[k] = out.get(k, 0) + v
        return out


class Runs:
    """The last runs, newest first."""

    def __init__(self, keep: int = 20):
        self.kept: deque = deque(maxlen=keep)

    def record(self, run) -> None:
        self.kept.appendleft(run)

    def recent(self, n: int | None = None) -> list:
        return list(self.kept)[:n]

    def last(self):
        return self.kept[0] if self.kept else None

    def forget(self) -> None:
        self.kept.clear()
