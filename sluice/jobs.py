"""Jobs that a scheduler may run: a scan, a sweep, a drain, a reprocess; and their configuration."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from contextlib import nullcontext
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import functions as F

from .insights import ScanRun, keys_where
from .runtime.store import KEY, Busy
from .sources.polling import NoScanner, refresh, scanners
from .sources.reconcile import invalidate


@dataclass
class Config:
    """root: where state is kept; plan: a function that makes the plan; around_poll: a wrapper of polls; keep: runs kept."""

    root: str | None = None
    plan: Callable | None = None
    around_poll: Callable | None = None
    on_schedule: Callable | None = None
    insights_keep: int = 20
    trace: int = 100

    def problems(self) -> list[str]:
        """All that is wrong, not just the first."""
        found = []
        if not self.root or not isinstance(self.root, str):
            found.append("root is not set: a folder for state is needed")
        if self.plan is not None and not callable(self.plan):
            found.append("plan is no function")
        for name in ("around_poll", "on_schedule"):
            if getattr(self, name) is not None and not callable(getattr(self, name)):
                found.append(f"{name} is no function")
        for name in ("insights_keep", "trace"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 0:
                found.append(f"{name} is no count")
        return found

    def validate(self) -> Config:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

    @classmethod
    def of(cls, values: Mapping[str, Any]) -> Config:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown configuration {sorted(unknown)[0]!r}")
        return cls(**values).validate()


def plan_of(config: Config, *args):
    if config.plan is None:
        raise ValueError("no plan function is configured")
    return config.plan(*args)


def scan(engine, cell: str, around_poll: Callable | None = None, runs=None, **args) -> tuple[str, Any]:
    """("ok", ScanRun), ("cancel", reason) where the cell cannot be scanned, or ("error", what failed)."""
    engine.events.emit("scan.start", cell=cell)
    try:
        with around_poll(cell) if around_poll else nullcontext():
            result = refresh(engine, cell, **args)
    except NoScanner as e:
        return "cancel", str(e)
    if not result.ok:
        engine.events.emit("scan.exception", cell=cell, error=result.error)
        return "error", result.error
    run = ScanRun({cell: result}, engine.drain())
    if runs is not None:
        runs.record(run)
    engine.events.emit("scan.stop", cell=cell, run=run)
    return "ok", run


def sweep(engine, every=None, around_poll: Callable | None = None, runs=None, **args) -> tuple[str, Any]:
    """Refresh all sources (of one cadence, if given), then drain once, under the lock; ("busy", None) if it is held."""
    wanted = [c for c in scanners(engine.plan) if every is None or engine.node(c).poll.every == every]
    try:
        with engine.store.lock():
            results = {}
            for c in wanted:
                with around_poll(c) if around_poll else nullcontext():
                    results[c] = refresh(engine, c, **args)
            run = ScanRun(results, engine.drain())
    except Busy:
        return "busy", None
    if runs is not None:
        runs.record(run)
    failed = {c: r.error for c, r in results.items() if not r.ok}
    return ("error", failed) if failed else ("ok", run)


def drain_job(engine, **options) -> tuple[str, Any]:
    """One drain under the lock; one that is already at work is no error."""
    engine.events.emit("drain_job.start")
    try:
        report = engine.locked_drain(**options)
    except Busy:
        return "busy", None
    engine.events.emit("drain_job.stop", report=report)
    return "ok", report


def reprocess(engine, cell: str, keys: Iterable[str] | None = None, where: Mapping[str, Any] | None = None):
    """The code changed, the data did not: forget fingerprints of rows (by key, by value, or all), dirty them and their consumers, drain."""
    engine.events.emit("reprocess.start", cell=cell)
    chosen = list(keys) if keys is not None else keys_where(engine, cell, **where) if where else None
    cleared = invalidate(engine, cell, chosen)
    if chosen is None:
        engine.mark(cell, reason="reprocess")
    elif isinstance(chosen, list):
        engine.mark(cell, chosen, reason="reprocess")
    else:
        units = engine.rows(cell).join(chosen.select(F.col("key").alias(KEY)), KEY, "left_semi")
        engine.mark(cell, units.select(F.col("__unit").alias("key")), reason="reprocess")
    report = engine.drain(force=[cell])
    engine.events.emit("reprocess.stop", cell=cell, invalidated=cleared, report=report)
    return report
