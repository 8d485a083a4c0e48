"""Helpers that the corpus operators share: the shared scratch folder, cut lineage, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach: ``spark.checkpoint.dir``.

    Only where the session names none (a local session, as in tests) is one made here.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    Unlike cached blocks, the files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, key: str, tag: str) -> DataFrame:
    """Write ``df``, which is partitioned by ``key`` already, as a table of that many buckets in the shared folder.

    Joins and groups by ``key`` then read it in place, and only what they bring is shuffled.
    """
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    out = df.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, tag)).option("compression", "zstd")
    out.format("parquet").saveAsTable(name)
    return spark.table(name)


HELD = 96 << 20  # bytes that a Python worker may keep when a task is done


def held_bytes() -> int:
    """Bytes of this process that no file backs; 0 where the system doesn't tell."""
    try:
        with open("/proc/self/statm") as f:
            size, resident, shared = map(int, f.read().split()[:3])
    except OSError:
        return 0
    return (resident - shared) * os.sysconf("SC_PAGESIZE")


def returning(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, which gives free memory back to the system when its batches are done.

    Workers live on from task to task, and what their allocators keep of one step's peak would stand beside all later steps.
    """

    def whole(batches):
        yield from run(batches)
        if held_bytes() > HELD:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return whole


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


SMALL_GRAPH = 250_000  # edges, of 16 bytes each


def _joined(batches):
    """``node, component`` of all edges of a small graph."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    nodes, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        x, y, root = label[a], label[b], np.arange(len(nodes))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], ["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL_GRAPH) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns ``a`` and ``b``. Returns ``node, component`` (the smallest
    node reachable) for each node on an edge between two different nodes. Each step is a
    map-side combined minimum and one equi-join, so a hub's neighbours are never gathered
    in one place; rounds grow with the logarithm of the longest path. At most ``small`` edges are one task's
    work, without rounds.
    """
    stars = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges"
    )
    if stars.count() <= small:
        return materialize(stars.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
    before = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        near = large.join(low, "v")
        small = near.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(near.select("v", F.col("m").alias("u")))
        stars = materialize(small.where("v <> u").distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.count_distinct("v")).first()
        if now[0] == now[2] and now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    roots = stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
