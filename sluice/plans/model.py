"""Nodes and their computations, as plain data; nothing here touches Spark data."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from pyspark.sql import types as T

CELL = "cell"
FOLDS = ("count", "sum", "avg", "min", "max", "first")


class NodeError(ValueError):
    """A declaration that cannot work."""


class CellFailed(Exception):
    """A computation's refusal: this cell is rolled back and left dirty; the drain goes on."""


@dataclass(frozen=True)
class Cell:
    """One place in the plan. ``cell["x"]`` is a core field, else an entry of meta."""

    id: str
    op: str
    inputs: tuple[str, ...] = ()
    leaf: bool = False
    meta: Mapping[str, Any] = field(default_factory=dict)

    def __getitem__(self, name: str):
        return getattr(self, name) if name in ("id", "op", "inputs", "leaf", "meta") else self.meta.get(name)

    def __setitem__(self, name: str, value) -> None:
        raise TypeError("a cell is read-only")


@dataclass(frozen=True)
class Plan:
    """cells by id, the consumers of each cell, and each cell's longest distance from a leaf."""

    cells: Mapping[str, Cell]
    parents: Mapping[str, tuple[str, ...]]
    depths: Mapping[str, int]
    tenant: str = "*"

    @property
    def order(self) -> list[str]:
        return sorted(self.cells, key=lambda c: (self.depths[c], c))


@dataclass(frozen=True)
class RecomputeBy:
    """The unit that a change invalidates: columns (own name or {own: input's}), or the whole cell."""

    unit: str | tuple | list | Mapping[str, str]
    to: str | None = None
    from_: str | None = None
    from_key: str | bool | None = None
    read: str | None = None


@dataclass(frozen=True)
class Reduce:
    """One row per group of the input's rows.

    group_by: a column, a pair (own, input's), a pair (own, function to a Column), or a list of these.
    folds: {"count": "n", "sum": {"amount": "total"} or ["amount"], ...}; into: function to a dict of
    aggregate Columns instead; expand: function (rows, group columns) to rows with a key of their own each.
    """

    over: str | None = None
    group_by: Any = None
    folds: Mapping[str, Any] = field(default_factory=dict)
    into: Callable[[], Mapping] | None = None
    expand: Callable | None = None
    read: str | None = None
    query: Callable | None = None
    key: Callable | None = None
    key_prefix: str | None = None


@dataclass(frozen=True)
class Side:
    """A side of a join: its key (a column or a function to a Column) and what its rows must equal."""

    key: Any
    where: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Join:
    """One row per key of the left side (and of the right side only, if outer). One input, or one for each side.

    into: {"left": {input's: own} or [names], "right": ...}, or function (key, left, right) to a dict of Columns.
    """

    left: Side
    right: Side
    into: Any
    over: str | None = None
    left_over: str | None = None
    right_over: str | None = None
    outer: bool = False
    read: str | None = None
    query: Callable | None = None
    key_prefix: str | None = None
    key: Callable | None = None


@dataclass(frozen=True)
class Union:
    """One row per row of each input. into: {own: input's}, where cell and key are also to be had."""

    from_: tuple[str, ...] | list[str]
    into: Mapping[str, str]


@dataclass(frozen=True)
class Aggregate:
    """Folds over the rows that belong to each of the node's own rows. ``key`` is the child's column."""

    over: str
    key: str | tuple[str, ...]
    folds: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class PerKey:
    """A call for each row of the input. action: function to a dict of Columns, or (with ``returns``) from and to pandas frames.

    args: {argument: input's column}; into: {own: result's}; rows whose fingerprint is stored are not called.
    """

    action: Callable
    over: str | None = None
    args: Mapping[str, str] | None = None
    into: Mapping[str, str] | None = None
    returns: str | None = None
    fingerprint: Iterable[str] | Callable | None = None
    fingerprint_attribute: str | None = None
    max_concurrency: int = 1
    timeout: float | None = None


@dataclass(frozen=True)
class Run:
    """A function that writes for itself: (engine=, claims=, cell=, plan=), those it names, to changed keys."""

    action: Callable


@dataclass(frozen=True)
class Compute:
    """An ``Op``: recompute(engine, cell, claims) to changed keys."""

    op: Any


@dataclass(frozen=True)
class Poll:
    source: Any
    args: Mapping[str, Any] = field(default_factory=dict)
    every: Any = None


@dataclass(frozen=True)
class Slice:
    column: str
    values: list | Callable | None = None
    label: str | None = None
    poll_as: str | None = None


@dataclass(frozen=True)
class Lapse:
    """A mark that no longer holds when watched columns move.

    target: own column, or another node whose rows go; when_changed: "any" or columns; over: clear it for the
    whole unit; key: the other node's column that holds this node's key (or unit, with over).
    """

    target: str
    when_changed: str | list[str] = "any"
    over: str | list[str] | None = None
    key: str | None = None


@dataclass(frozen=True)
class Compose:
    """A computation inside another: legs become cells of their own."""

    op: str
    legs: tuple = ()
    compute: Any = None
    as_: str | None = None
    key_rule: Any = None
    leaf: bool = False
    inputs: tuple[str, ...] = ()
    meta: Mapping[str, Any] = field(default_factory=dict)


Computation = Reduce | Join | Union | Aggregate | PerKey | Run | Compute


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name.rpartition(".")[2]).lower()


@dataclass(frozen=True)
class Node:
    """A table and what fills it."""

    id: str
    columns: str | T.StructType | None = None
    primary_key: tuple[str, ...] | list[str] = ("key",)
    compute: Any = None
    leaf: bool = False
    recompute_by: RecomputeBy | None = None
    key_rule: Any = None
    op: str | None = None
    refs: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    compose: tuple[Compose, ...] = ()
    calculations: Mapping[str, Callable] = field(default_factory=dict)
    reads: Mapping[str, Callable] = field(default_factory=dict)
    fingerprint: Any = None
    fingerprint_attribute: str | None = None
    compare: list[str] | None = None
    retain_if_vanished: Any = False
    live: Callable | None = None
    dirties_on: tuple[str, ...] = ("create", "update", "destroy")
    augmented_by: tuple[str, ...] = ()
    schedule_drain: bool = False
    slices: tuple[Slice, ...] = ()
    lapses: tuple[Lapse, ...] = ()
    poll: Poll | None = None
    for_each: str | None = None
    companion: bool = False
    meta: Mapping[str, Any] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType | None:
        if self.columns is None or isinstance(self.columns, T.StructType):
            return self.columns
        return T._parse_datatype_string(self.columns)

    @property
    def names(self) -> list[str]:
        return self.schema.names if self.columns is not None else []

    @property
    def computations(self) -> list:
        c = self.compute
        return [] if c is None else list(c) if isinstance(c, (list, tuple)) else [c]

    @property
    def computation(self):
        found = self.computations
        return found[0] if found else None


def frozen(meta: Mapping) -> Mapping:
    return MappingProxyType(dict(meta))


def group_items(group_by) -> list[tuple[str, Any]]:
    """(own column, input's column or function) of each part of a group."""
    if group_by is None:
        return []
    if isinstance(group_by, Mapping):
        return list(group_by.items())
    if isinstance(group_by, str):
        return [(group_by, group_by)]
    if isinstance(group_by, tuple) and len(group_by) == 2 and (callable(group_by[1]) or isinstance(group_by[1], str)) and isinstance(group_by[0], str):
        return [group_by]
    return [x for part in group_by for x in group_items(part)]


def fold_items(folds: Mapping) -> list[tuple[str, str | None, str]]:
    """(kind, input's column or None, own column) of each fold."""
    out: list[tuple[str, str | None, str]] = []
    for kind, spec in folds.items():
        if kind not in FOLDS:
            raise NodeError(f"unknown fold {kind!r}; one of {', '.join(FOLDS)}")
        if kind == "count":
            if not isinstance(spec, str):
                raise NodeError("count: takes the name of one own column")
            out.append((kind, None, spec))
        elif isinstance(spec, str):
            out.append((kind, spec, spec))
        elif isinstance(spec, Mapping):
            out += [(kind, source, dest) for source, dest in spec.items()]
        elif isinstance(spec, (list, tuple)) and all(isinstance(x, str) for x in spec):
            out += [(kind, x, x) for x in spec]
        else:
            raise NodeError(f"{kind}: takes a column, a list of columns or {{input's: own}}")
    return out


def picks(spec) -> dict[str, str]:
    """{input's: own} of a join's or union's picks."""
    return dict(spec) if isinstance(spec, Mapping) else {x: x for x in ([spec] if isinstance(spec, str) else spec or ())}
