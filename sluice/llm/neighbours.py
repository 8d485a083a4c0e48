"""Near-duplicate vectors by NN-descent.

A K-neighbour graph starts from random-projection trees and is refined by joining the neighbours of
each vector with each other, until few lists change. Links at the threshold or over connect vectors
into components. A vector whose whole list is links is saturated: others it is linked with may be in no list, but
then they are saturated too. So components of more vectors than a list holds are bridged exactly, by pivots and
radii and, where these leave it open, by all members that can be linked. In a component all links are counted exactly.
A component too large for one task is counted in blocks: vectors within half the threshold's angle of
its pivot are all linked with each other and need no comparison, the others are held against every block.
Recall is audited against brute force on a bounded sample, and more trees are grown until it suffices.

Cases: vectors with a null label, null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of different
lengths are never compared; of rows that share an id the smallest vector counts, for all of them; an
empty table gives an empty result; only id, embedding and label are read, so other columns cannot clash.
"""

from __future__ import annotations

import logging

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

THRESHOLD = 0.98
_SURE = 1e-9  # radians by which an angle must clear the threshold to count without a comparison


log = logging.getLogger(__name__)


def usable(vectors: DataFrame) -> DataFrame:
    """id, part (what is compared with each other), vec (unit vector, packed doubles)."""

    def run(batches):
        for b in batches:
            ids, parts, out = [], [], []
            for i, label, v in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if i is None or label is None or not v or any(x is None for x in v):
                    continue
                a = np.array(v, np.float64)
                if not np.isfinite(a).all():
                    continue
                a = a / (np.abs(a).max() or 1.0)  # so that no square overflows or vanishes
                norm = np.sqrt(a @ a)
                if norm > 0:
                    ids.append(i)
                    parts.append(f"{label}/{len(a)}")
                    out.append((a / norm).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(out, pa.binary())], ["id", "part", "vec"])

    vectors = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    found = vectors.mapInArrow(run, "id long, part string, vec binary")
    return found.groupBy("id").agg(F.min(F.struct("part", "vec")).alias("v")).select("id", "v.part", "v.vec")


def _groups(batches, columns: list[str]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _links_batch(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "sim"])


def _best(vecs: np.ndarray, k: int):
    """Each row's k most similar other rows: (rows, columns, similarities)."""
    sim = vecs @ vecs.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(vecs) - 1)
    col = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < len(vecs) - 1 else np.argsort(-sim, axis=1)[:, :k]
    row = np.repeat(np.arange(len(vecs)), k)
    return row, col.reshape(-1), sim[row, col.reshape(-1)]


def tree_neighbours(points: DataFrame, trees: range, leaf: int, k: int, chunk: int = 512) -> DataFrame:
    """``a, b, sim``: each point's best neighbours in its leaf of each random-projection tree.

    The depth follows the number of points, so leaves hold about ``leaf``; a leaf that is larger, as of many near copies,
    is worked on in chunks, which later rounds of the descent connect.
    """
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))

    def code(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, parts, raw = (b.column(c).to_pylist() for c in range(3))
            out: tuple[list, list, list] = ([], [], [])
            for i, part, data in zip(ids, parts, raw, strict=True):
                v = np.frombuffer(data)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([len(v), trees.start]).normal(size=(len(v), len(trees) * depth)) if depth else np.zeros((len(v), 0))
                bits = ((v @ planes[len(v)]) > 0).reshape(len(trees), depth)
                for t, row in zip(trees, bits, strict=True):
                    out[0].append(f"{part}/{t}/{np.packbits(row).tobytes().hex()}")
                    out[1].append(i)
                    out[2].append(data)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["leaf", "id", "vec"])

    def best(batches):
        a, b, s = [], [], []
        for rows in _groups(batches, ["leaf", "id", "vec"]):
            for i in range(0, len(rows), chunk):
                part = rows[i : i + chunk]
                if len(part) < 2:
                    continue
                ids = np.array([r[1] for r in part])
                row, col, sim = _best(np.stack([np.frombuffer(r[2]) for r in part]), k)
                a.append(ids[row]), b.append(ids[col]), s.append(sim)
            if sum(map(len, a)) > 100_000:
                yield _links_batch(np.concatenate(a), np.concatenate(b), np.concatenate(s))
                a, b, s = [], [], []
        yield _links_batch(*(np.concatenate(x) if x else [] for x in (a, b, s)))

    leaves = points.mapInArrow(code, "leaf string, id long, vec binary")
    leaves = leaves.withColumn("salt", F.xxhash64("leaf", "id")).repartition("leaf").sortWithinPartitions("leaf", "salt")
    return leaves.select("leaf", "id", "vec").mapInArrow(best, "a long, b long, sim double")


def nearest(links: DataFrame, k: int) -> DataFrame:
    """The k best of each point's links, as one row per point: ``a, near`` (sim, b), best first."""
    top = links.distinct().groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "b")), asc=False), 1, k).alias("near"))
    return top


def descend(points: DataFrame, graph: DataFrame, k: int, chunk: int = 64) -> DataFrame:
    """One round: neighbours (forward and reverse) of each point are compared with each other.

    Yields links better than the worst in their point's list. A hub's neighbours are joined in chunks.
    """
    worst = graph.select(F.col("a").alias("id"), F.when(F.size("near") < k, -2.0).otherwise(F.element_at("near", -1)["sim"]).alias("worst"))
    known = points.select("id", "vec").join(worst, "id", "left").select("id", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    ahead = graph.select("a", F.explode("near").alias("n")).select(F.col("a").alias("at"), F.col("n.b").alias("id"))
    both = ahead.unionByName(ahead.select(F.col("id").alias("at"), F.col("at").alias("id"))).distinct()
    both = both.unionByName(graph.select(F.col("a").alias("at"), F.col("a").alias("id")))

    def join(batches):
        a, b, s, size = [], [], [], 0
        for rows in _groups(batches, ["at", "id", "vec", "worst"]):
            for i in range(0, len(rows), chunk):
                part = rows[i : i + chunk]
                if len(part) < 2:
                    continue
                ids = np.array([r[1] for r in part])
                sim = (v := np.stack([np.frombuffer(r[2]) for r in part])) @ v.T
                np.fill_diagonal(sim, -2)
                row, col = np.nonzero(sim > np.maximum(np.array([r[3] for r in part])[:, None], 0))
                a.append(ids[row]), b.append(ids[col]), s.append(sim[row, col])
                size += len(row)
            if size > 100_000:
                yield _links_batch(np.concatenate(a), np.concatenate(b), np.concatenate(s))
                a, b, s, size = [], [], [], 0
        yield _links_batch(*(np.concatenate(x) if x else [] for x in (a, b, s)))

    rows = both.join(known, "id").withColumn("salt", F.xxhash64("at", "id")).repartition("at").sortWithinPartitions("at", "salt")
    return rows.select("at", "id", "vec", "worst").mapInArrow(join, "a long, b long, sim double")


def count_links(members: DataFrame, block: int = 2000) -> DataFrame:
    """``id, n_links`` of the members (component, id, vec) of components, over all pairs of a component.

    Small components are counted in one task each. In a large one, points within half the threshold's angle of
    the pivot are counted without comparing them; the rest are copied to every block of the component.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.min_by("vec", "id").alias("pivot"))
    members = members.join(sizes, "component")
    half = np.arccos(THRESHOLD) / 2 - _SURE

    def angles(batches):
        for b in batches:
            core = [n > block and np.arccos(min(1.0, np.frombuffer(v) @ np.frombuffer(p))) <= half for n, v, p in zip(*(b.column(c).to_pylist() for c in ("n", "vec", "pivot")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "id", "vec", "n")), pa.array(core, pa.bool_())], ["component", "id", "vec", "n", "core"])

    members = materialize(members.mapInArrow(angles, "component long, id long, vec binary, n long, core boolean"), "members")
    blocks = F.ceil(F.col("n") / block)
    own = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("visits", F.lit(False))
    rim = members.where(~F.col("core") & (F.col("n") > block)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("visits", F.lit(True))
    chunked = rim.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), blocks))
    plain = own.where(F.col("n") <= block).withColumn("part", F.lit(0).cast("long"))
    split = own.where(F.col("n") > block).join(chunked.select("component", "part").distinct(), "component")
    cells = plain.unionByName(split).unionByName(chunked).repartition("component", "block", "part").sortWithinPartitions("component", "block", "part", "visits", "id")
    cells = cells.withColumn("cell", F.concat_ws("/", "component", "block", "part"))

    def compare(batches):
        ids, counts = [], []
        for rows in _groups(batches, ["cell", "id", "vec", "core", "visits"]):
            here = [r for r in rows if not r[4]]
            visiting = [r for r in rows if r[4]]
            base = np.stack([np.frombuffer(r[2]) for r in here]) if here else None
            if not visiting:
                for i in range(0, len(here), 500):
                    linked = (base[i : i + 500] @ base.T >= THRESHOLD).sum(axis=1)
                    itself = np.einsum("ij,ij->i", base[i : i + 500], base[i : i + 500]) >= THRESHOLD
                    ids += [r[1] for r in here[i : i + 500]]
                    counts += (linked - itself).tolist()
                continue
            if not here:
                continue
            at = {r[1]: j for j, r in enumerate(here)}
            core = np.array([r[3] for r in here])
            for i in range(0, len(visiting), 500):
                part = visiting[i : i + 500]
                hit = np.stack([np.frombuffer(r[2]) for r in part]) @ base.T >= THRESHOLD
                for j, r in enumerate(part):
                    if r[1] in at:
                        hit[j, at[r[1]]] = False
                ids += [r[1] for r in part]
                counts += hit.sum(axis=1).tolist()
                back = (hit.sum(axis=0) * core).tolist()  # links of core points with visitors
                ids += [r[1] for r, c in zip(here, back, strict=True) if c]
                counts += [c for c in back if c]
            if len(ids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["id", "n"])
                ids, counts = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["id", "n"])

    compared = cells.select("cell", "id", "vec", "core", "visits").mapInArrow(compare, "id long, n long")
    cores = members.where("core").groupBy("component").agg((F.count("*") - 1).alias("n"))
    sure = members.where("core").select("component", "id").join(cores, "component").select("id", "n")
    return compared.unionByName(sure).groupBy("id").agg(F.sum("n").alias("n_links"))


def _pairs(rows: DataFrame, by: str, key: str, block: int) -> DataFrame:
    """``rows`` with a ``cell``, sorted by it, so that any two rows of equal ``by`` are together in some cell of about 2 blocks."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / block).alias("blocks"))
    rows = rows.join(sizes, by).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("cell", F.concat_ws("/", by, F.least("block", "other"), F.greatest("block", "other")))
    return rows.repartition("cell").sortWithinPartitions("cell", key)


def _angle(v: bytes, w: bytes) -> float:
    return float(np.arccos(np.clip(np.frombuffer(v) @ np.frombuffer(w), -1.0, 1.0)))


def bridge(points: DataFrame, found: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """``node, component`` with components of more than k vectors joined wherever two of their vectors are linked.

    The pivot of a component is its vector of least id, which names it. Two components can have a link only if their
    pivots' angle is at most the sum of their radii and the threshold's angle; all such pairs are decided exactly.
    """
    theta = float(np.arccos(THRESHOLD)) + 1e-7  # wider than rounding near 1, so no link is ruled out
    large = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > k).select("component")
    members = found.join(large, "component").withColumnRenamed("node", "id").join(points, "id")
    pivots = points.select(F.col("id").alias("component"), F.col("vec").alias("pivot"))

    def angles(batches):
        for b in batches:
            vecs, pivot = (b.column(c).to_pylist() for c in ("vec", "pivot"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "id", "part", "vec")), pa.array([_angle(v, p) for v, p in zip(vecs, pivot, strict=True)], pa.float64())], ["component", "id", "part", "vec", "angle"])

    members = members.join(pivots, "component").select("component", "id", "part", "vec", "pivot")
    members = materialize(members.mapInArrow(angles, "component long, id long, part string, vec binary, angle double"), "bridged")
    heads = members.groupBy("component").agg(F.first("part").alias("part"), F.max("angle").alias("radius")).join(pivots, "component")
    heads = materialize(heads, "heads")

    def candidates(batches):
        for rows in _groups(batches, ["cell", "component", "pivot", "radius"]):
            ids, radius = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
            sim = (v := np.stack([np.frombuffer(r[2]) for r in rows])) @ v.T
            near = np.arccos(np.clip(sim, -1, 1)) <= radius[:, None] + radius[None, :] + theta
            row, col = np.nonzero(near & (ids[:, None] < ids[None, :]))
            yield _links_batch(ids[row], ids[col], sim[row, col])

    cells = _pairs(heads, "part", "component", block)
    pairs = materialize(cells.select("cell", "component", "pivot", "radius").mapInArrow(candidates, "a long, b long, sim double").select("a", "b", "sim").dropDuplicates(["a", "b"]), "candidates")
    sure = pairs.where(F.col("sim") >= THRESHOLD).select("a", "b")
    merged = materialize(components(sure), "merged")
    of = lambda side: merged.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
    undecided = pairs.where(F.col("sim") < THRESHOLD).join(of("a"), "a", "left").join(of("b"), "b", "left")
    undecided = materialize(undecided.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b"), "undecided")

    def within(batches):
        for b in batches:
            vecs, pivot, radius = (b.column(c).to_pylist() for c in ("vec", "pivot", "radius"))
            keep = [_angle(v, p) <= r + theta for v, p, r in zip(vecs, pivot, radius, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b", "side", "id", "vec")], ["a", "b", "side", "id", "vec"])

    sides = [undecided.select("a", "b", F.lit(s).alias("side"), F.col(own).alias("component"), F.col(other).alias("beside")) for s, own, other in ((0, "a", "b"), (1, "b", "a"))]
    sides = sides[0].unionByName(sides[1]).join(heads.select(F.col("component").alias("beside"), "pivot", "radius"), "beside").join(members.select("component", "id", "vec"), "component")
    sides = materialize(sides.select("a", "b", "side", "id", "vec", "pivot", "radius").mapInArrow(within, "a long, b long, side int, id long, vec binary"), "sides")

    def meets(batches):
        a, b = [], []
        for rows in _groups(batches, ["cell", "a", "b", "side", "vec"]):
            one, two = ([np.frombuffer(r[4]) for r in rows if r[3] == s] for s in (0, 1))
            if one and two and (np.stack(one) @ np.stack(two).T >= THRESHOLD).any():
                a.append(rows[0][1]), b.append(rows[0][2])
        yield _links_batch(a, b, [1.0] * len(a))

    cells = _pairs(sides.withColumn("pair", F.concat_ws("/", "a", "b")), "pair", "id", block)
    met = cells.select("cell", "a", "b", "side", "vec").mapInArrow(meets, "a long, b long, sim double").select("a", "b")
    merged = materialize(components(sure.unionByName(met)), "merged").withColumnRenamed("component", "whole").withColumnRenamed("node", "component")
    return found.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def audit(points: DataFrame, counted: DataFrame, sample: int) -> float:
    """The share of all links that were found, estimated by brute force on ``sample`` vectors with links and as many without.

    Each of the two kinds counts with its own size, so vectors whose links were all missed weigh as many as they are.
    """
    known = points.join(counted.select("id", "n_links"), "id", "left").withColumn("linked", F.coalesce(F.col("n_links") > 0, F.lit(False)))
    sizes = {r.linked: r["n"] for r in known.groupBy("linked").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for linked, seed in ((False, 3), (True, 4)):
        chosen += known.where(F.col("linked") == linked).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()
    if not chosen:
        return 1.0
    by_part: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for part in {r.part for r in chosen}:
        rows = [r for r in chosen if r.part == part]
        by_part[part] = np.array([r.id for r in rows]), np.stack([np.frombuffer(r.vec) for r in rows])

    def run(batches):
        total: dict[int, int] = {}
        for b in batches:
            rows: dict[str, list] = {}
            for i, part, v in zip(*(b.column(c).to_pylist() for c in ("id", "part", "vec")), strict=True):
                if part in by_part:
                    rows.setdefault(part, []).append((i, np.frombuffer(v)))
            for part, found in rows.items():
                ids, vecs = by_part[part]
                hit = vecs @ np.stack([v for _, v in found]).T >= THRESHOLD
                hit &= ids[:, None] != np.array([i for i, _ in found])[None, :]
                for i, n in zip(ids.tolist(), hit.sum(axis=1).tolist(), strict=True):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "n"])

    true = {r.id: r["n"] for r in points.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # of the sample
    there = got = 0.0
    for linked, size in sizes.items():
        rows = [r for r in chosen if r.linked == linked]
        weight = size / max(1, len(rows))
        there += weight * sum(true.get(r.id, 0) for r in rows)
        got += weight * sum(min(true.get(r.id, 0), r.n_links or 0) for r in rows)
    return got / there if there else 1.0


def near_vectors(vectors: DataFrame, k: int = 10, trees: int = 10, leaf: int = 48, rounds: int = 3, least_recall: float = 0.99, sample: int = 128, attempts: int = 3, fail_below: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for rows of ``vec_id, embedding, label``."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    points = materialize(usable(vectors), "points")
    links, counted, found = None, None, None
    for attempt in range(attempts):
        fresh = tree_neighbours(points, range(attempt * trees, (attempt + 1) * trees), leaf, k)
        graph = materialize(nearest(fresh if links is None else links.unionByName(fresh), k), "graph")
        flat = lambda g: g.select("a", F.explode("near").alias("n")).select("a", F.col("n.b").alias("b"), F.col("n.sim").alias("sim"))
        for _ in range(rounds):
            better = materialize(descend(points, graph, k), "better")
            changed = better.join(flat(graph), ["a", "b"], "left_anti").select("a").distinct().count()
            graph = materialize(nearest(flat(graph).unionByName(better), k), "graph")
            if changed <= 0.001 * graph.count():
                break
        links = flat(graph)
        found = materialize(components(links.where(F.col("sim") >= THRESHOLD).select("a", "b")), "found")
        found = materialize(bridge(points, found, k), "found")
        members = found.withColumnRenamed("node", "id").join(points.select("id", "vec"), "id")
        counted = materialize(count_links(members), "counted")
        recall = audit(points, counted, sample)
        log.info("near vectors: recall %.4f after %d trees", recall, (attempt + 1) * trees)
        if recall >= least_recall:
            break
    else:
        if recall < fail_below:
            raise RuntimeError(f"near vectors: the audited recall is {recall:.3f} after {attempts} attempts, under {fail_below}; give more trees or attempts")
        log.warning("near vectors: the audited recall is %.4f, under %.4f", recall, least_recall)
    out = vectors.select("vec_id").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left").join(counted.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def op7_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
