"""A corpus pipeline over ``documents``: language ID, line and near-duplicate removal, passage removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents. A filtering stage keeps what it has no ground to drop: rows without an id are
passed on by the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import materialize
from sluice.llm.language import UNKNOWN, predict, train
from sluice.llm.lines import dedup_lines
from sluice.llm.near import near_duplicates
from sluice.llm.packing import pack_documents
from sluice.llm.suffixes import repeated_passages

#: A document whose best language has a lower mean probability than this is in none of them.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: without letters, or too unlike all that were learned."""
    row = F.xxhash64("doc_id", "text")  # rows may share an id, or have none
    found = predict(docs.select(row.alias("doc_id"), "text"), train(docs))
    rejected = found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SCORE)).select(F.col("doc_id").alias("__row")).distinct()
    return docs.join(materialize(rejected, "rejected"), row == F.col("__row"), "left_anti").select(*docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of all texts; a document of which nothing is left goes."""
    out = dedup_lines(docs)
    left = out.where(F.col("lines_removed").isNull() | (F.trim("text") != "")).drop("lines_removed")
    return _with_length(left).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near-duplicates stays, that with the smallest id."""
    found = near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select("doc_id")  # an id is kept if one of its rows is
    return docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that a document with a smaller id also has out of all texts; a document of which nothing is left goes."""
    changed = repeated_passages(docs, keep_text=True).where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("kept").alias("__kept"))
    changed = materialize(changed.dropDuplicates(["__id", "__row"]), "changed")
    out = docs.join(changed, (docs["doc_id"] == changed["__id"]) & (F.xxhash64(docs["text"]) == changed["__row"]), "left").withColumn("text", F.coalesce("__kept", "text"))
    out = out.where(F.col("__kept").isNull() | (F.trim("__kept") != ""))
    return _with_length(out).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_lines),
    ("near-duplicate documents", remove_near_duplicates),
    ("passage removal", remove_passages),
    ("packing", pack),
]

#: Training, set similarity and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
