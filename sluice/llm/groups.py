"""Exhaustive comparison inside many small groups of rows that may overlap, without all pairs.

Sets of ids that overlap are one group and are compared together, each content being read once. A group beyond
a stated size is cut into blocks, and what is still apart after these is compared by pairs of blocks, so no task
holds more than two blocks and no pair of ids goes uncompared. Ids that are
already connected are not compared again, so a group of n copies takes about n comparisons
and yields at most n - 1 links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, is_empty, materialize, returning


BROADCAST_ROWS = 500_000  # of 16 bytes
_NEAR = 16


class Links:
    """Union-find over positions in a group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.find(y)] = self.find(x)


def compare_nodes(nodes: DataFrame, contents: DataFrame, prepare: Callable, link: Callable, many: bool = False) -> DataFrame:
    """Links ``a, b`` found in groups.

    nodes: ``node, id``; contents: ``id, content``, one row per id; prepare turns a content
    into what ``link`` compares, or with ``many`` a column of them, one after the other; link takes a group's list of these and yields pairs of positions.
    """

    def run(batches):
        node, ids, items, a, b = None, [], [], [], []

        def flush():
            for x, y in link(items):
                a.append(ids[x])
                b.append(ids[y])

        for batch in batches:
            prepared = prepare(batch.column(2)) if many else map(prepare, batch.column(2).to_pylist())
            for n, i, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), prepared, strict=True):
                if n != node:
                    flush()
                    node, ids, items = n, [], []
                ids.append(i)
                items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear(), b.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = nodes.join(contents, "id").select("node", "id", "content").repartition("node").sortWithinPartitions("node", "id")
    return rows.mapInArrow(returning(run), "a long, b long")


def connect(key: np.ndarray, item: np.ndarray, label: np.ndarray, close: Callable) -> np.ndarray:
    """``label`` (of items) with items joined that are ``close`` and have equal keys.

    ``key`` is sorted, ``item`` has the item at each of its places, and ``close(a, b)`` tells for arrays of items which pairs are.
    All pairs of places that are up to ``_NEAR`` apart are looked at first, which joins most of what is alike. The places of
    longer keys are then put in order of what is joined, the largest part first, and all pairs of different parts are
    looked at; keys all of whose items are joined already need no more.
    """

    def joined(found):
        nonlocal label
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                return
            root = np.arange(len(label))
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            label = root[label]

    def starts():
        return np.flatnonzero(np.append(True, key[1:] != key[:-1]))

    def open_keys(first):
        now = label[item]
        return np.minimum.reduceat(now, first) != np.maximum.reduceat(now, first)

    def hits(a, b):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        hit = close(a, b) if len(a) else np.zeros(0, bool)
        if hit.any():
            found.append((a[hit], b[hit]))
        return int(hit.sum())

    same = key[1:] == key[:-1]
    inside = np.append(False, same) | np.append(same, False)
    key, item = key[inside], item[inside]
    at, found = np.arange(len(key)), []
    for gap in range(1, _NEAR + 1):
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        hits(item[at], item[at + gap])
        if gap & (gap - 1) == 0 and found:  # early, as most is joined by the first
            joined(found)
            found = []
    if found:
        joined(found)
        found = []
    if not len(key):
        return label
    first = starts()
    n = np.diff(np.append(first, len(key)))
    more = np.repeat(open_keys(first) & (n > _NEAR + 1), n)
    key, item = key[more], item[more]
    if not len(key):
        return label

    def runs(now):
        begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (now[1:] != now[:-1])))
        return begins, np.diff(np.append(begins, len(now)))

    order = np.lexsort((label[item], key))
    key, item = key[order], item[order]
    n = runs(label[item])[1]
    order = np.lexsort((label[item], -np.repeat(n, n), key))
    key, item = key[order], item[order]
    begins, n = runs(label[item])
    after = np.repeat(begins + n, n)  # each place's first one of another part
    first, at, gap, count = starts(), np.arange(len(key)), 0, 0
    while len(at):
        at = at[after[at] + gap < len(key)]
        at = at[key[at] == key[after[at] + gap]]
        count += hits(item[at], item[after[at] + gap])
        gap += 1
        if (gap % 16 == 0 or count > 1 << 20) and found:
            joined(found)
            found, count = [], 0
        if gap % 16 == 0 and len(at):
            at = at[open_keys(first)[np.searchsorted(first, at, side="right") - 1]]
    if found:
        joined(found)
    return label


def link_sets(sets: DataFrame, contents: DataFrame, prepare: Callable, link: Callable, max_ids: int, max_weight: int, many: bool = False) -> DataFrame:
    """Links ``a, b`` that connect what ``link`` connects among ids that share a set.

    sets: ``node, id, root, weight``, a row for each member of a set; root is a member of the same set. Sets that
    overlap, directly or through others, are one group. A group within the two limits is compared as it is, each content being
    read once. A larger one is compared in blocks first, and what that has joined is then one class; of its sets only those
    of more than one class and block are compared on, without the pairs inside the set's largest class. Where sets overlap
    so much that this would read more than comparing the whole group by pairs of blocks, the latter is done.
    """
    sets = materialize(sets, "sets")
    ids = sets.groupBy("id").agg(F.max("weight").alias("weight"))
    groups = components(sets.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), "component")
    ids = materialize(groups.join(ids, "id"), "grouped")
    sizes = ids.groupBy("component").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / max_ids), F.ceil(F.col("w") / max_weight)).cast("long").alias("blocks")
    blocked = materialize(ids.join(sizes.select("component", blocks), "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")), "blocked")
    nodes = blocked.select(F.xxhash64("component", "block").alias("node"), "id")
    if blocked.count() <= BROADCAST_ROWS:  # so few are sent to the contents; else both are dealt by id
        nodes = F.broadcast(nodes)
    links = materialize(compare_nodes(nodes, contents, prepare, link, many), "links")
    large = blocked.where("blocks > 1")
    if is_empty(large):
        return links
    classes = components(links).select(F.col("node").alias("id"), F.col("component").alias("class"))
    large = large.select("component", "id", "block", "blocks", "weight").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    members = materialize(sets.select("node", "id").join(large, "id"), "members")
    kinds = members.groupBy("node", "class").agg(F.count("*").alias("k"), F.sum("weight").alias("kw"), F.min("block").alias("low"), F.max("block").alias("high"), F.first("component").alias("component"))
    nodes = kinds.groupBy("node").agg(
        F.count("*").alias("classes"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("class", "k").alias("main"), F.max("k").alias("k"),
        F.sum("k").alias("n"), F.max_by("kw", "k").alias("kw"), F.sum("kw").alias("w"), F.first("component").alias("component"),
    )
    nodes = nodes.where("classes > 1 and low < high")

    def parts(n, w):
        return F.greatest(F.lit(1), F.ceil(2 * n / max_ids), F.ceil(2 * w / max_weight)).cast("long")

    rest = parts(F.col("n") - F.col("k"), F.col("w") - F.col("kw"))
    nodes = nodes.select("component", "node", "main", "n", "k", rest.alias("rest"), parts(F.col("k"), F.col("kw")).alias("mains"))
    nodes = materialize(nodes, "open")
    if is_empty(nodes):
        return links
    reads = nodes.groupBy("component").agg(F.sum(((F.col("n") - F.col("k")) * (F.col("rest") + F.col("mains")) + F.col("k") * F.col("rest")).cast("double")).alias("reads"))
    whole = large.groupBy("component").agg((F.count("*") * (F.first("blocks") - 1)).alias("whole")).join(reads, "component").where("whole <= reads")
    whole = materialize(whole.select("component"), "whole")
    rows = large.join(whole, "component", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
    pairs = rows.select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "id")
    nodes = nodes.join(whole, "component", "left_anti")
    rows = members.select("node", "id", "class").join(nodes, "node")
    block = F.when(F.col("class") == F.col("main"), F.col("rest") + F.pmod(F.xxhash64("node", "id"), "mains")).otherwise(F.pmod(F.xxhash64("node", "id"), "rest"))
    rows = rows.withColumn("own", block)
    others = F.when(F.col("own") < F.col("rest"), F.sequence(F.lit(0), F.col("rest") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") - 1))
    rows = rows.withColumn("other", F.explode(others))
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    more = compare_nodes(pairs.unionByName(rows.select(pair.alias("node"), "id")), contents, prepare, link, many)
    return links.unionByName(more)
