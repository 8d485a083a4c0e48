"""What a drain did, why, and what changed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.keys import WHOLE


@dataclass
class Step:
    cell: str
    depth: int | None
    claimed: list[str]
    changed: list[str]
    changed_count: int
    causes: list[str]
    duration_us: int = 0
    meta: dict = field(default_factory=dict)
    status: str = "ok"


@dataclass
class Report:
    steps: list[Step] = field(default_factory=list)
    passes: int = 0
    duration_us: int = 0

    def cells(self) -> list[str]:
        return [s.cell for s in self.steps]

    def total(self, name: str) -> float:
        """Sum of a meta entry over all steps: numbers, and the numbers in mappings."""
        return meta_total((s.meta for s in self.steps), name)

    def by(self, name: str) -> dict:
        return meta_by((s.meta for s in self.steps), name)

    def changed_total(self) -> int:
        return sum(s.changed_count for s in self.steps)

    def causes(self) -> dict[str, list[str]]:
        return {s.cell: s.causes for s in self.steps}

    def step(self, cell: str) -> Step | None:
        return next((s for s in self.steps if s.cell == cell), None)

    def to_df(self, spark):
        rows = [(s.cell, s.depth, s.claimed, s.changed, s.changed_count, s.causes, s.duration_us, s.status) for s in self.steps]
        return spark.createDataFrame(rows, "cell string, depth int, claimed array<string>, changed array<string>, changed_count long, causes array<string>, duration_us long, status string")

    @property
    def whole(self) -> list[str]:
        return [s.cell for s in self.steps if s.claimed == [WHOLE]]


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def meta_total(metas, name: str) -> float:
    total = 0
    for m in metas:
        v = m.get(name, 0)
        total += sum(x for x in v.values() if _number(x)) if isinstance(v, dict) else v if _number(v) else 0
    return total


def meta_by(metas, name: str) -> dict:
    """Per bucket; a bare number counts as unattributed."""
    out: dict = defaultdict(int)
    for m in metas:
        v = m.get(name)
        for k, x in v.items() if isinstance(v, dict) else [("unattributed", v)]:
            if _number(x):
                out[k] += x
    return dict(out)


class Events:
    """Named events, and who listens. A listener's failure is its own."""

    def __init__(self):
        self.listeners: dict[str, list[Callable]] = defaultdict(list)
        self.failures: list[tuple[str, Exception]] = []

    def subscribe(self, name: str, listener: Callable) -> None:
        """``name`` may end in * to take all events that begin so."""
        self.listeners[name].append(listener)

    def emit(self, name: str, **what) -> None:
        for wanted, listeners in list(self.listeners.items()):
            if wanted == name or wanted.endswith("*") and name.startswith(wanted[:-1]):
                for f in listeners:
                    try:
                        f(name, what)
                    except Exception as e:  # noqa: BLE001
                        self.failures.append((name, e))
