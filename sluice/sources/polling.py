"""Sources, and what is done with what they report. Nothing here is called from inside a drain."""

from __future__ import annotations

import inspect
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..plans.graph import verify_poll
from ..plans.model import Plan
from .reconcile import Reconciled


class NoScanner(LookupError):
    """The cell has no source of its own."""


@dataclass
class PollResult:
    """changed: keys of the polled leaf, or {leaf: keys}; a ``Reconciled`` is marked already."""

    changed: Any = ()
    unreachable: list = field(default_factory=list)
    detail: Mapping = field(default_factory=dict)
    error: Exception | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


class Source(ABC):
    """Something to poll. ``poll`` gets ``engine``, ``cell``, ``progress`` and its declared arguments, those it names."""

    @property
    def id(self) -> str:
        return type(self).__name__

    def origin(self) -> str | None:
        return None

    @abstractmethod
    def poll(self, **options): ...


def resolve_args(args: Mapping[str, Any]) -> dict[str, Any]:
    """Functions without parameters are called now; all other values pass as they are."""
    return {k: v() if callable(v) and not isinstance(v, type) and _arity(v) == 0 else v for k, v in args.items()}


def _arity(f) -> int:
    try:
        return len(inspect.signature(f).parameters)
    except (TypeError, ValueError):
        return -1


def scanners(plan: Plan, order: Callable | None = None) -> list[str]:
    """Polled cells by depth and id, or by ``order`` (a key function)."""
    found = [c for c in plan.cells if plan.cells[c].meta["node"].poll]
    return sorted(found, key=order or (lambda c: (plan.depths[c], c)))


def cells_of(plan: Plan, source) -> list[str]:
    return [c for c in scanners(plan) if plan.cells[c].meta["node"].poll.source is source]


def standing_args(plan: Plan, cell: str) -> dict:
    """A cell's declared arguments, unresolved."""
    return dict(plan.cells[cell].meta["node"].poll.args)


def controls(plan: Plan) -> list[dict]:
    """What an operator can scan: cell, source, cadence, slices and argument names."""
    out = []
    for c in scanners(plan):
        node = plan.cells[c].meta["node"]
        out.append({"cell": c, "source": getattr(node.poll.source, "id", type(node.poll.source).__name__), "origin": getattr(node.poll.source, "origin", lambda: None)(), "every": node.poll.every, "args": sorted(node.poll.args), "slices": slices(plan, c)})
    return out


def scan_jobs(plan: Plan) -> list[dict]:
    return [{"cell": c, "tenant": plan.tenant} if plan.tenant != "*" else {"cell": c} for c in scanners(plan)]


def crontab(plan: Plan, per_cell: bool = False, args: Mapping | None = None) -> list[tuple[Any, dict]]:
    """(cadence, job arguments): one sweep for each distinct cadence, or one entry a cell. Never schedules anything."""
    tenant = {"tenant": plan.tenant} if plan.tenant != "*" else {}
    timed = [c for c in scanners(plan) if plan.cells[c].meta["node"].poll.every is not None]
    every = {c: plan.cells[c].meta["node"].poll.every for c in timed}
    if per_cell:
        return [(every[c], {**(args or {}), "cell": c, **tenant}) for c in timed]
    return [(cadence, {**(args or {}), "sweep": True, "every": cadence, **tenant}) for cadence in dict.fromkeys(every.values())]


def slices(plan: Plan, cell: str) -> list[dict]:
    node = plan.cells[cell].meta["node"]
    return [{"column": s.column, "label": s.label or s.column, "values": s.values() if callable(s.values) else s.values, "poll_as": s.poll_as} for s in node.slices]


def poll_opts(plan: Plan, cell: str, chosen: Mapping[str, Any]) -> dict:
    """A choice by column as poll arguments; columns that are no slice are left out."""
    known = {s["column"]: s["poll_as"] or s["column"] for s in slices(plan, cell)}
    return {known[c]: v for c, v in chosen.items() if c in known}


def normalise(result) -> PollResult:
    """Keys, a mapping, a ``Reconciled`` or a ``PollResult``, as a ``PollResult``."""
    if isinstance(result, PollResult):
        return result
    if isinstance(result, (Reconciled, list, tuple, set)):
        return PollResult(result if isinstance(result, Reconciled) else list(result))
    if isinstance(result, Mapping):
        return PollResult(result.get("changed", ()), list(result.get("unreachable", ())), result.get("detail", {}))
    raise TypeError(f"a poll returned {type(result).__name__}; it returns keys, a mapping, Reconciled or PollResult")


def poll_cell(engine, cell: str, **args) -> PollResult:
    """Poll a cell's source; a failure is in the result, not raised."""
    node = engine.node(cell)
    if not node.poll:
        raise NoScanner(f"{cell!r} has no source")
    source = node.poll.source
    source = source() if isinstance(source, type) else source
    verify_poll(source)
    have = {**resolve_args(node.poll.args), **args, "engine": engine, "cell": cell, "progress": lambda **what: engine.events.emit("scan.progress", cell=cell, **what)}
    wanted = inspect.signature(source.poll).parameters
    takes_all = any(p.kind is p.VAR_KEYWORD for p in wanted.values())
    try:
        return normalise(source.poll(**(have if takes_all else {k: v for k, v in have.items() if k in wanted})))
    except Exception as e:  # noqa: BLE001 - a source's failure is its own
        engine.events.emit("scan.source_stop", cell=cell, error=e)
        return PollResult(error=e)


def poll_all(engine, order: Callable | None = None, **args) -> dict[str, PollResult]:
    """Poll every source, one after another; one that fails does not stop the rest. Marks nothing."""
    return {c: poll_cell(engine, c, **args) for c in scanners(engine.plan, order)}


def refresh(engine, cell: str, **args) -> PollResult:
    """Poll a cell and dirty what it reports: the leaves and, with them, their consumers."""
    result = poll_cell(engine, cell, **args)
    if result.ok:
        _mark(engine, cell, result)
    return result


def _mark(engine, cell: str, result: PollResult) -> None:
    changed = result.changed
    if isinstance(changed, Reconciled):
        return  # its rows and marks were one commit
    for leaf, keys in (changed if isinstance(changed, Mapping) else {cell: changed}).items():
        if isinstance(keys, Reconciled):
            continue
        if keys:
            engine.mark(leaf, keys, reason="scan")


def detail_total(results: Iterable[PollResult], name: str) -> float:
    from ..runtime.report import meta_total

    return meta_total((r.detail for r in results), name)


def detail_by(results: Iterable[PollResult], name: str) -> dict:
    from ..runtime.report import meta_by

    return meta_by((r.detail for r in results), name)


def now() -> float:
    return time.time()
