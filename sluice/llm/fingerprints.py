"""Canonical exact fingerprints of whole documents.

A text's canonical form is its compatibility decomposition, recomposed, with case folded and
each run of white space made one space. Its fingerprint is the 128-bit xxhash of that form and
the form's length. Rows that share a digest with others are compared byte by byte; should two
different forms ever share one, their fingerprints get the form's number as a suffix, so equal
fingerprints of documents always mean equal canonical texts.

Cases: a null text is an empty text; a null id sorts after all others; rows that share an id
are ordered by a hash of the text, equal rows as they come; a lone row is its own next row; an empty table gives an empty result; only
the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_empty, materialize

_HELD = 32 << 20  # bytes of text that a task packs at a time
_RANGE = 24 << 20  # bytes of text in a range


def canonical(text: str) -> bytes:
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return f"{xxhash.xxh3_128_hexdigest(form)}-{len(form):x}"


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_KEY = ["none", "down", "hash", "number"]  # the order of rows: by falling id, rows without one last, then by text; the last only parts equal rows
_ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("form", pa.binary())]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, form binary"


def digests(rows: DataFrame) -> DataFrame:
    """The rows' keys with the digest of their canonical text."""

    def run(batches):
        for b in batches:
            made = pa.array([digest(canonical(t)) for t in b.column(4).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), made], [*_KEY, "digest"])

    return rows.select(*_KEY, "text").mapInArrow(run, "none int, down long, hash long, number long, digest string")


def shared_digests(rows: DataFrame, salts: int = 16) -> DataFrame:
    """Keys of the rows whose digest also another row has. A digest of very many rows is looked up in several tasks."""
    found = materialize(digests(rows), "digests")
    shared = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return found.withColumn("salt", F.pmod(F.hash("number"), F.lit(salts))).join(shared, ["digest", "salt"]).select(*_KEY)


def _dealt(edges: np.ndarray):
    """Packed stretches of rows for each range: marks (kind 0), rows (1), and each range's first row for the range before it (2)."""
    m = len(edges)

    def packed(held):
        key = np.concatenate([k for k, _, _ in held])
        kind = np.concatenate([k for _, k, _ in held])
        texts = pa.concat_arrays([t for _, _, t in held])
        both = np.concatenate([edges, key])
        row = np.append(np.zeros(m, np.int8), np.ones(len(key), np.int8))
        order = np.lexsort((row, *both.T[::-1]))
        place = np.empty(len(both), np.int64)
        place[order] = np.cumsum(row[order] == 0) - 1
        own = place[m:]
        first = (kind == 1) & (key[:, :3] == edges[own, :3]).all(axis=1)  # equal to its range's first row, but for the number
        guests = np.flatnonzero(first)
        guests = guests[np.unique(own[guests], return_index=True)[1]]
        at, to = np.append(np.arange(len(key)), guests), np.append(own, (own[guests] - 1) % m)
        what = np.append(kind, np.full(len(guests), 2, kind.dtype))
        pack = zstandard.ZstdCompressor(level=1)
        order = np.argsort(to, kind="stable")
        borders = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1], [True]]))
        rows = []
        for x, y in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            some = order[x:y]
            part = texts.take(pa.array(at[some]))
            _, offsets, data = part.buffers()
            sizes = np.diff(np.frombuffer(offsets, np.int64, len(some) + 1))
            heads = what[some].astype(np.int64).tobytes() + key[at[some]].tobytes() + sizes.tobytes()
            rows.append((int(to[some[0]]), len(some), heads, pack.compress(bytes(data)[: int(sizes.sum())] if data else b"")))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "n", "heads", "texts"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            held.append((key, b.column(4).to_numpy().astype(np.int64), b.column(5).cast(pa.large_string())))
            size += b.column(5).nbytes + 40 * b.num_rows
            if size > _HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _row(key, text: str, form: bytes, following: str, next_form: bytes, shared: bool) -> tuple:
    other = edited(text, following)
    changed = canonical(other)
    return (
        None if key[0] else ~key[1], len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), digest(form), digest(changed),
        float(form == changed), float(form == next_form), form if shared else None,
    )


def _read(batches):
    """Rows of each range in order, each with its next one; after the last comes the first of the next range."""
    names, kinds = zip(*_ROW, strict=True)
    held: dict[int, list] = {}
    for b in batches:
        for part, n, heads, texts in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            held.setdefault(part, []).append((n, heads, texts))
    while held:
        _, found = held.popitem()
        key, kind, texts = [], [], []
        for n, heads, data in found:
            kind.append(np.frombuffer(heads, np.int64, n))
            key.append(np.frombuffer(heads, np.int64, 4 * n, 8 * n).reshape(n, 4))
            ends, raw = np.cumsum(np.frombuffer(heads, np.int64, n, 40 * n)).tolist(), zstandard.decompress(data)
            texts += [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        key, kind = np.concatenate(key), np.concatenate(kind)
        marked = {tuple(k) for k in key[kind == 0][:, :3].tolist()}
        guest = int(np.flatnonzero(kind == 2)[0])
        rows = np.flatnonzero(kind == 1)
        rows = rows[np.lexsort(key[rows].T[::-1])].tolist()
        out, text = [], texts[rows[0]].decode("utf-8", "surrogatepass")
        form = canonical(text)
        for i, at in enumerate(rows):
            following = texts[rows[i + 1] if i + 1 < len(rows) else guest].decode("utf-8", "surrogatepass")
            next_form = canonical(following)
            own = tuple(key[at].tolist())
            out.append(_row(own, text, form, following, next_form, own[:3] in marked))
            text, form = following, next_form
            if len(out) == 1000 or i + 1 == len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))
                out = []


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited texts; see ``op4_fingerprints`` for the columns.

    The next document is that with the next smaller id. Rows are dealt once, packed, to ranges of their order that hold about
    ``_RANGE`` bytes of text; only one row per range, its first, also goes to the range before it. The driver holds the ranges' first keys.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.isNull().cast("int").alias("none"), F.bitwise_not(F.coalesce(doc_id, F.lit(0))).alias("down"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return spark.createDataFrame([], _SCHEMA).drop("form")
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _RANGE))
    firsts = rows.select(*_KEY).repartitionByRange(ranges, *_KEY).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*_KEY)).alias("first"))
    edges = np.array(sorted(tuple(r.first) for r in firsts.select("first").collect()), np.int64).reshape(-1, 4)
    both = rows.select(*_KEY, F.lit(1).alias("kind"), "text").unionByName(shared_digests(rows).select(*_KEY, F.lit(0).alias("kind"), F.lit("").alias("text")))
    dealt = both.mapInArrow(_dealt(edges), "range int, n int, heads binary, texts binary")
    done = materialize(dealt.repartitionById(len(edges), F.col("range")).mapInArrow(_read, _SCHEMA), "fingerprints")
    forms = done.where("form is not null")
    clash = forms.groupBy("fingerprint").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("fingerprint")
    if is_empty(clash):
        return done.drop("form")
    forms = forms.join(clash, "fingerprint").select("fingerprint", "form").distinct()
    forms = forms.withColumn("_number", F.row_number().over(Window.partitionBy("fingerprint").orderBy("form")))
    done = done.join(forms, ["fingerprint", "form"], "left")
    return done.select(*(F.concat_ws("-", "fingerprint", "_number").alias(c) if c == "fingerprint" else c for c, _ in _ROW[:-1]))


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
