"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame functions only.

Shards own virtual nodes on a ring of 2**32 positions. A key belongs to the first node
clockwise from its hash; a shard that is full passes the rest of its keys on to the next
node clockwise whose shard has room. Rows are only counted by ring arc, so what reaches
the driver is bounded by the number of virtual nodes, whatever the input's size.

Cases: a null text counts as no bytes; null keys hash like any other value; equal rows may
take either of their slots; an empty table gives an empty result; input columns other than
the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CELLS = 1024
RING = 1 << 32


def ring_tokens(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node, clockwise. A shard's nodes do not depend on the others."""
    return sorted(
        (int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=4).digest(), "big"), s)
        for s in range(n_shards)
        for v in range(vnodes)
    )


def capacities(total: int, n_shards: int, load_factor: float) -> list[int]:
    """Most rows a shard may hold. A factor of 1 gives sizes at most one apart."""
    if load_factor < 1:
        raise ValueError("load_factor must be at least 1")
    if load_factor == 1:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [ceil(load_factor * total / n_shards)] * n_shards


def walk_ring(owners: list[int], demand: list[int], room: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """Deal each arc's keys to shards: per arc a list of (from rank, to rank, shard, first slot).

    Every shard takes the keys of its own arcs first, so a key moves only if its own shard is
    full; then the overflow goes clockwise, oldest first, to the first shard with room.
    """
    if sum(room) < sum(demand):
        raise ValueError("the shards have no room for all keys")
    free, filled = list(room), [0] * len(room)
    dealt: list[list[tuple[int, int, int, int]]] = [[] for _ in demand]

    def take(arc: int, start: int, end: int, shard: int) -> int:
        n = min(end - start, free[shard])
        if n:
            dealt[arc].append((start, start + n, shard, filled[shard]))
            free[shard] -= n
            filled[shard] += n
        return start + n

    over = {}
    for arc, n in enumerate(demand):
        start = take(arc, 0, n, owners[arc])
        if start < n:
            over[arc] = start
    for arc, start in over.items():
        node = arc
        while start < demand[arc]:
            node = (node + 1) % len(owners)
            start = take(arc, start, demand[arc], owners[node])
    return dealt


def _arc(pos, tokens: list[int]):
    """Index of the first node at or after ``pos``: a cell of the ring gives all but a few comparisons."""
    width = RING // CELLS
    below = [sum(t < c * width for t in tokens) for c in range(CELLS + 1)]
    starts, sorted_tokens = F.lit(below), F.lit(tokens)
    cell = F.floor(pos / width).cast("int")
    first = F.get(starts, cell)
    inside = F.slice(sorted_tokens, first + 1, F.get(starts, cell + 1) - first)
    return F.pmod(first + F.size(F.filter(inside, lambda t: t < pos)), F.lit(len(tokens))).cast("int")


def consistent_shards(
    rows: DataFrame,
    key: list[str],
    order: list[str],
    n_shards: int = 8,
    vnodes: int = 64,
    load_factor: float = 1.0,
    rows_per_block: int = 100_000,
) -> DataFrame:
    """Add ``shard`` int and ``slot`` long (gapless from 0 in each shard) to ``rows``.

    key: columns that are hashed onto the ring; order: columns that identify a row, used to
    rank rows of one arc. One hot key lies in one arc, so an arc is split into blocks by a hash
    of ``order``: no task sorts much more than ``rows_per_block`` rows.
    """
    ring = ring_tokens(n_shards, vnodes)
    tokens, owners = [p for p, _ in ring], [s for _, s in ring]
    placed = materialize(
        rows.withColumn("_pos", F.xxhash64(*key).bitwiseAND(F.lit(RING - 1))).withColumn("_arc", _arc(F.col("_pos"), tokens)), "ring"
    )
    total = placed.count()
    blocks = max(1, ceil(total / rows_per_block))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64(F.lit(7), *order), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("_arc", "_block").agg(F.count("*").alias("_n"))
    in_arc = Window.partitionBy("_arc").orderBy("_block")
    offsets = counts.withColumn("_before", F.sum("_n").over(in_arc) - F.col("_n")).drop("_n")
    demand = [0] * len(ring)
    for arc, n in counts.groupBy("_arc").agg(F.sum("_n")).collect():  # one row per virtual node at most
        demand[arc] = n
    dealt = walk_ring(owners, demand, capacities(total, n_shards, load_factor))
    flat = [p for parts in dealt for p in parts] or [(0, 0, 0, 0)]
    at = [0]
    for parts in dealt:
        at.append(at[-1] + len(parts))
    plan = F.lit([p[0] for p in flat]).cast("array<bigint>"), F.lit([p[2] for p in flat]), F.lit([p[3] for p in flat]).cast("array<bigint>")
    by_block = Window.partitionBy("_arc", "_block").orderBy("_pos", *order)
    ranked = placed.withColumn("_rank", F.row_number().over(by_block).cast("long")).join(offsets, ["_arc", "_block"])
    rank = F.col("_rank") - 1 + F.col("_before")
    first = F.get(F.lit(at), F.col("_arc"))
    n_parts = F.get(F.lit(at), F.col("_arc") + 1) - first
    ranked = ranked.withColumn("_rank", rank).withColumn(
        "_part", first - 1 + F.size(F.filter(F.slice(plan[0], first + 1, n_parts), lambda start: start <= F.col("_rank")))
    )
    return ranked.select(
        *rows.columns,
        F.get(plan[1], F.col("_part")).cast("int").alias("shard"),
        (F.get(plan[2], F.col("_part")) + F.col("_rank") - F.get(plan[0], F.col("_part"))).alias("slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, **options) -> DataFrame:
    """``documents`` dealt to shards by consistent hashing of their text, so that equal texts stay
    together as far as a shard has room; under the default load factor of 1 the law is ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_key"),
    )
    out = consistent_shards(rows, ["_key"], ["doc_id", "_key"], n_shards, **options)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_consistent_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
