"""Structured Streaming as a driver of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def writes_of(engine, cell: str, deleted: str | None = None, drain: bool = True, prepare: Callable | None = None):
    """A ``foreachBatch`` function: each micro-batch is a write to a leaf, and a drain.

    Of rows with one key the batch's last by ``_order`` counts; without that column they must be equal, or the batch fails. deleted: a boolean column
    whose rows are deletes. A batch that is delivered again finds its rows unchanged and marks nothing.
    """

    def handle(batch: DataFrame, number: int) -> None:
        node = engine.node(cell)
        rows = prepare(batch) if prepare else batch
        if "_order" in rows.columns:
            rest = [c for c in rows.columns if c not in node.primary_key]
            rows = rows.groupBy(*node.primary_key).agg(F.max_by(F.struct(*rest), "_order").alias("r")).select(*node.primary_key, *(F.col(f"r.{c}").alias(c) for c in rest if c != "_order"))
        elif deleted:
            rows = rows.distinct()
        gone = rows.where(F.col(deleted)).select(*node.primary_key) if deleted else None
        kept = rows.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else rows
        engine.write(cell, kept, gone, reason=f"batch {number}")
        if drain:
            engine.drain()

    return handle


def follow(stream: DataFrame, engine, cell: str, checkpoint: str, **options):
    """Start a stream into a leaf; the query is the caller's to stop."""
    return stream.writeStream.foreachBatch(writes_of(engine, cell, **options)).option("checkpointLocation", checkpoint).start()
