"""Checks that need only the node itself."""

from __future__ import annotations

from .model import CELL, Aggregate, Join, Node, NodeError, PerKey, Reduce, Run, Union, fold_items, group_items, picks


def check_node(node: Node) -> None:
    """Raise NodeError with the first thing that cannot work."""
    for problem in problems(node):
        raise NodeError(f"{node.id!r}: {problem}")


def problems(node: Node):
    """All problems of a declaration, as texts."""
    own, comps = set(node.names), node.computations
    if len(comps) > 1:
        yield "more than one computation"
    if not comps and not (node.leaf or node.compose or node.poll or node.companion):
        yield "no computation, and it is no leaf"
    if comps and node.columns is None and not node.companion:
        yield "it computes but has no columns"
    if node.leaf and comps:
        yield "a leaf has no computation"
    missing = [k for k in node.primary_key if node.columns is not None and k not in own]
    if missing:
        yield f"primary key column {missing[0]!r} is not in the schema"
    yield from _change_detection(node, own)
    yield from _marks(node, own)
    for c in comps[:1]:
        kind = {Reduce: _reduce, Join: _join, Union: _union, Aggregate: _aggregate, PerKey: _per_key, Run: _run}.get(type(c))
        if kind:
            try:
                yield from kind(node, c, own)
            except NodeError as e:
                yield str(e)
    if node.recompute_by is not None:
        yield from _unit(node)
    if node.key_rule is not None and node.recompute_by is not None:
        yield "both recompute_by and a key rule"
    if node.retain_if_vanished not in (True, False) and not callable(node.retain_if_vanished):
        yield "retain_if_vanished is True, False or a function"
    if any(x not in ("create", "update", "destroy") for x in node.dirties_on):
        yield "dirties_on takes create, update and destroy"
    if not isinstance(node.depends_on, (tuple, list)) or not all(isinstance(x, str) for x in node.depends_on):
        yield "depends_on takes node ids"


def _change_detection(node: Node, own: set[str]):
    if node.compare is not None:
        if not node.compare:
            yield "compare is empty: it would report nothing"
        for c in node.compare:
            if own and c not in own:
                yield f"compare names unknown column {c!r}"
    if node.fingerprint is not None and not callable(node.fingerprint):
        for c in node.fingerprint:
            if own and c not in own:
                yield f"fingerprint names unknown column {c!r}"
    attribute = node.fingerprint_attribute or "fingerprint"
    if node.fingerprint is not None and own and attribute not in own:
        yield f"a fingerprint needs a column {attribute!r} to hold it"
    if node.fingerprint_attribute and node.fingerprint is None and not any(isinstance(c, PerKey) for c in node.computations):
        yield "a fingerprint column that nothing fills"


def _marks(node: Node, own: set[str]):
    for name in node.augmented_by:
        if name not in own:
            yield f"augmented_by names unknown column {name!r}"
        if name in emitted(node):
            yield f"augmented_by names {name!r}, which the computation writes: it would never end"
    unit = {d for c in node.computations if isinstance(c, Reduce) for d, _ in group_items(c.group_by)}
    for lapse in node.lapses:
        over = [lapse.over] if isinstance(lapse.over, str) else list(lapse.over or ())
        if over and node.recompute_by is None:
            yield "lapse over a unit needs recompute_by"
        for c in over:
            if unit and c not in unit and c not in own:
                yield f"lapse over {c!r}, which is not part of the unit"
        watched = [] if lapse.when_changed == "any" else lapse.when_changed
        if not isinstance(watched, (list, tuple)) or lapse.when_changed != "any" and not watched:
            yield 'lapse when_changed is "any" or a list of columns'
        else:
            for c in watched:
                if own and c not in own:
                    yield f"lapse watches unknown column {c!r}"


def emitted(node: Node) -> set[str]:
    """Own columns that the computation writes, as far as the declaration tells."""
    c = node.computation
    if isinstance(c, Reduce):
        return {d for d, _ in group_items(c.group_by)} | ({d for _, _, d in fold_items(c.folds)} if not c.into else set())
    if isinstance(c, Join) and not callable(c.into):
        return {d for side in ("left", "right") for d in picks(c.into.get(side)).values()}
    if isinstance(c, Union):
        return set(c.into)
    if isinstance(c, PerKey):
        return set(c.into or ())
    if isinstance(c, Aggregate):
        return {d for _, _, d in fold_items(c.folds)}
    return set()


def _reduce(node: Node, c: Reduce, own: set[str]):
    by = node.recompute_by
    if c.over and by and by.from_ and c.over != by.from_:
        yield "the input is named twice"
    slots = bool(c.folds) + (c.into is not None) + (c.expand is not None)
    if slots == 0:
        yield "reduce needs folds, into or expand"
    if slots > 1:
        yield "reduce has more than one of folds, into and expand"
    if c.group_by is None and not (by and by.unit != CELL):
        yield "reduce has no group"
    if c.key and c.key_prefix:
        yield "both a key function and a key prefix"
    for _, _, dest in fold_items(c.folds):
        if own and dest not in own:
            yield f"fold writes unknown column {dest!r}"
    group = [d for d, _ in group_items(c.group_by)] or ([by.to or by.unit] if by and isinstance(by.unit, str) else list(by.unit) if by else [])
    pk = list(node.primary_key)
    if len(pk) > 1 and not c.expand and not c.into:
        made = {*group, *(d for _, _, d in fold_items(c.folds))}
        for k in pk:
            if k not in made:
                yield f"identity column {k!r} is not produced"


def _join(node: Node, c: Join, own: set[str]):
    two = (c.left_over is not None) + (c.right_over is not None)
    if c.over and two:
        yield "join has one input and an input for a side"
    if two == 1:
        yield "join has an input for one side only"
    if not c.over and not two:
        yield "join has no input"
    for name, side in (("left", c.left), ("right", c.right)):
        if side is None or side.key is None:
            yield f"join's {name} side has no key"
        elif not hasattr(side.where, "items"):
            yield f"join's {name} side: where takes {{column: value}}"
    if not callable(c.into):
        extra = set(c.into) - {"left", "right"}
        if extra:
            yield f"join picks for {sorted(extra)[0]!r}; only left and right are sides"
        for dest in emitted(node):
            if own and dest not in own:
                yield f"join writes unknown column {dest!r}"
    if c.key and c.key_prefix:
        yield "both a key function and a key prefix"


def _union(node: Node, c: Union, own: set[str]):
    if not c.from_:
        yield "union has no inputs"
    for dest in c.into:
        if own and dest not in own:
            yield f"union writes unknown column {dest!r}"


def _aggregate(node: Node, c: Aggregate, own: set[str]):
    if not c.folds:
        yield "aggregate has no folds"
    for _, _, dest in fold_items(c.folds):
        if own and dest not in own:
            yield f"aggregate writes unknown column {dest!r}"


def _per_key(node: Node, c: PerKey, own: set[str]):
    if not callable(c.action):
        yield "per_key's action is no function"
    for dest in c.into or ():
        if own and dest not in own:
            yield f"per_key writes unknown column {dest!r}"
    attribute = c.fingerprint_attribute or "fingerprint"
    if c.fingerprint is not None and own and attribute not in own:
        yield f"per_key's fingerprint needs a column {attribute!r}"
    if c.max_concurrency < 1:
        yield "max_concurrency is at least 1"


def _run(node: Node, c: Run, own: set[str]):
    if not callable(c.action):
        yield "run's action is no function"


def _unit(node: Node):
    by, c = node.recompute_by, node.computation
    if by.unit == CELL:
        if by.from_key:
            yield "from_key with the whole cell as unit"
        if isinstance(c, Reduce) and c.group_by is None:
            yield "a unit of the whole cell needs a group"
    elif not isinstance(by.unit, str):
        if not by.unit or not (hasattr(by.unit, "items") or all(isinstance(x, (str, tuple)) for x in by.unit)):
            yield "a composite unit is a list of columns or pairs, or {own: input's}"
        if by.to or by.from_key:
            yield "a composite unit takes neither to nor from_key"
    if by.from_key not in (None, True, False, "day", "week", "month", "quarter", "year"):
        yield "from_key is a calendar kind"
    if isinstance(c, Reduce) and not (c.over or by.from_):
        yield "recompute_by has no input"
