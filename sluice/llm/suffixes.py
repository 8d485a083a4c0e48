"""Removal of passages that a document with a smaller id also has, by suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
id. The suffix array is built by the difference-cover algorithm (cover {1, 2} modulo 3): suffixes at
sampled positions are sorted by their first three symbols and named; where names repeat, the
algorithm recurses on the string of names; the suffixes that were not sampled are then merged in by
their first symbols and the rank of the sampled suffix behind them. Neighbours in the sorted order
are compared on ``LENGTH`` bytes, and each class of equal strings gets its smallest document.

How it is distributed: each string of ``LENGTH`` bytes has a key, the least hash of the ``GRAM``-byte strings
in it, so equal strings have equal keys and neighbouring strings mostly share theirs. Keys are first
exchanged alone; only stretches whose key occurs in two documents or more, with the bytes around them, are dealt by
key to the tasks that sort suffixes. Documents are held in chunks, and a chunk tells another task of a key, or
of a stretch, once at most, however many of its documents have it; so a passage that a third of all
documents share loads no task with more than one entry a chunk.

Cases: a null or short text has nothing to remove; rows without an id neither remove nor lose
anything and are in no chunk; rows that share an id do not affect each other, and those whose texts differ are in chunks of their own; a text of any length is one document, whole; an empty
table gives an empty result; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, materialize

LENGTH = 50
GRAM = 20
STARTS = LENGTH - GRAM + 1  # grams in a string, and the most strings in a stretch
WIDTH = STARTS + LENGTH - 1
KEY_BITS = 47
_SORTED = 1024  # stretches whose suffixes are sorted together: their arrays stay in the processor's cache
_BLOCK = 1 << 15  # strings whose keys are worked out at a time
_CONTENT = np.dtype([("key", ">u8"), ("size", "u1"), ("bytes", "u1", WIDTH)])
_RNG = np.random.default_rng(31)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2)
_ODD = _RNG.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# -- the suffix array ---------------------------------------------------------------------------


def _order(key: np.ndarray) -> np.ndarray:
    """The order of non-negative integers, equal ones as they come: sorted with their places below them, if both fit in a word."""
    low = max(1, len(key).bit_length())
    if not len(key) or int(key.max()).bit_length() + low > 63:
        return np.argsort(key, kind="stable")
    both = key.astype(np.uint64) << np.uint64(low) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << low) - 1)).astype(np.int64)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows by rising key, and which of them each row is. Rows are told apart by a hash, and then compared byte by byte."""
    words = np.frombuffer(np.pad(rows.view(np.uint8).reshape(len(rows), -1), ((0, 0), (0, -rows.dtype.itemsize % 8))).tobytes(), np.uint64).reshape(len(rows), -1)
    h = np.zeros(len(rows), np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * _ODD[i % len(_ODD)]
        h ^= h >> np.uint64(29)
    key = rows["key"].astype(np.uint64)
    order = np.lexsort((h, key))
    hk, kk = h[order], key[order]
    new = np.append(True, (hk[1:] != hk[:-1]) | (kk[1:] != kk[:-1]))
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    distinct = order[new]
    if (words[distinct[of]] != words).any():  # two rows with one hash
        found, of = np.unique(rows.view(f"V{rows.dtype.itemsize}").reshape(-1), return_inverse=True)
        return found.view(rows.dtype), of
    return rows[distinct], of


def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks from 0 of rows of non-negative integers, compared column by column."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        width = int(c.max()) + 1 if len(c) else 1
        if len(key) and int(key.max() + 1) * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + c
    order = _order(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(key) else []
    return rank


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a string of positive integers, in order; a prefix comes first."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two, rest = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names = _names(t[sample], t[sample + 1], t[sample + 2]) + 1
    rank = np.zeros(n + 3, np.int64)
    if int(names.max()) < len(sample):
        inner = np.concatenate([names[: len(one)], [0], names[len(one) :]]) + 1
        order = suffix_array(inner)
        order = order[order != len(one)]
        order -= order > len(one)
        rank[sample[order]] = np.arange(1, len(sample) + 1)
    else:
        rank[sample] = names
    by_rank = np.empty(len(sample), np.int64)
    by_rank[rank[sample] - 1] = sample
    one, two = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    rest = rest[_order(t[rest] * (n + 3) + rank[rest + 1])]
    # a sampled suffix is compared by one symbol and a rank, or by two symbols and a rank
    key = lambda at: t[at] * (n + 3) + rank[at + 1]
    in_one = np.searchsorted(key(one), key(rest))
    both = _names(t[np.concatenate([two, rest])], t[np.concatenate([two, rest]) + 1]) * (n + 3)
    in_two = np.searchsorted(both[: len(two)] + rank[two + 2], both[len(two) :] + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + in_one + in_two
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = by_rank
    return out


def smallest_owner(stretches: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each stretch (a row of WIDTH bytes, ``sizes`` of them in use) and start in it, the smallest owner of that string.

    Returns (stretches, STARTS); starts beyond a stretch's last string have the largest integer.
    """
    count, wide = len(sizes), np.arange(WIDTH)
    ends = np.cumsum(sizes + 1)
    text = np.ones(int(ends[-1]), np.int64)
    inside = wide[None, :] < sizes[:, None]
    starts = ends - sizes - 1
    at = (starts[:, None] + wide[None, :])[inside]
    text[at] = stretches[inside].astype(np.int64) + 2
    of = np.repeat(np.arange(count), sizes + 1)
    offset = np.arange(len(text)) - starts[of]
    order = suffix_array(text)
    order = order[offset[order] <= sizes[of[order]] - LENGTH]
    same = np.ones(max(0, len(order) - 1), bool)
    for i in range(LENGTH):
        left = np.flatnonzero(same)
        same[left] = text[order[left] + i] == text[order[left + 1] + i]
    first = np.concatenate([[0], np.flatnonzero(~same) + 1]) if len(order) else np.array([], np.int64)
    low = np.minimum.reduceat(owner[of[order]], first) if len(order) else np.array([], np.int64)
    out = np.full((count, STARTS), np.iinfo(np.int64).max, np.int64)
    if len(order):
        out[of[order], offset[order]] = np.repeat(low, np.diff(np.append(first, len(order))))
    return out


# -- chunks of documents ------------------------------------------------------------------------


def _string_keys(a: np.ndarray) -> np.ndarray:
    """Keys of all strings in some bytes."""
    h1 = _BYTE[a]
    h2 = h1[:-1] * _ODD[0] + h1[1:]
    h4 = h2[:-2] * _ODD[1] + h2[2:]
    h8 = h4[:-4] * _ODD[2] + h4[4:]
    h = h8[:-8] * _ODD[3] + h8[8:]
    h = h[:-4] * _ODD[4] + h4[16:]
    h ^= h >> np.uint64(32)
    h *= _ODD[5]
    h >>= np.uint64(64 - KEY_BITS)
    span = 1
    while 2 * span <= STARTS:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < STARTS:
        h = np.minimum(h[: span - STARTS], h[STARTS - span :])
    # least hashes are small numbers: a product that can be undone spreads them over the buckets
    return h * _ODD[0] & np.uint64((1 << KEY_BITS) - 1)


class Chunk:
    """Documents laid end to end, with the stretches of equal keys in them."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.size = np.array([len(d) for d in self.data], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.data), np.uint8)
        self.lo, self.hi, self.key, self.doc = self._stretches()

    def _stretches(self):
        """First and last start, key and document of each run of neighbouring strings with one key."""
        a, none = self.bytes, np.array([], np.int64)
        if len(a) < LENGTH:
            return none, none, none.astype(np.uint64), none
        # h[p] is the key of the string at p; strings must lie in one document
        h = np.empty(len(a) - LENGTH + 1, np.uint64)
        for p in range(0, len(h), _BLOCK):
            h[p : p + _BLOCK] = _string_keys(a[p : p + _BLOCK + LENGTH - 1])
        end = self.start + self.size - LENGTH + 1
        some = np.flatnonzero((self.size >= LENGTH) & np.array([i is not None for i in self.ids]))
        if not len(some):
            return none, none, none.astype(np.uint64), none
        # stretches of one key in one document, none of more than STARTS strings
        bounds = np.unique(np.concatenate([np.flatnonzero(h[1:] != h[:-1]) + 1, self.start[some], end[some]]))
        first, last = bounds[:-1], bounds[1:]
        of = some[np.maximum(np.searchsorted(self.start[some], first, side="right") - 1, 0)]
        inside = (first >= self.start[of]) & (first < end[of])
        first, last, of = first[inside], last[inside], of[inside]
        pieces = (last - first + STARTS - 1) // STARTS
        which = np.repeat(np.arange(len(first)), pieces)
        lo = first[which] + STARTS * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        hi = np.minimum(lo + STARTS, last[which]) - 1
        return lo, hi, h[lo], of[which]

    def keys(self) -> np.ndarray:
        """Distinct keys, shifted left, with bit 0 set for those that two documents here have."""
        order = np.lexsort((self.doc, self.key))
        key, doc = self.key[order], np.array(self._id_numbers(), np.int64)[self.doc[order]]
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.array([], np.int64)
        if not len(key):
            return key
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        return key[first] << np.uint64(1) | many.astype(np.uint64)

    def _id_numbers(self) -> list[int]:
        return [0 if i is None else i for i in self.ids]

    def shared(self, keys: np.ndarray):
        """Stretches with one of the keys: their numbers, distinct contents (key, size, bytes), and each one's content."""
        own = np.flatnonzero(np.isin(self.key, keys))
        size = self.hi[own] - self.lo[own] + LENGTH
        row = np.zeros(len(own), _CONTENT)
        row["key"], row["size"] = self.key[own], size
        padded = np.concatenate([self.bytes, np.zeros(WIDTH, np.uint8)])
        for i in range(WIDTH):
            row["bytes"][:, i] = np.where(i < size, padded[self.lo[own] + i], 0)
        distinct, content = _distinct(row) if len(row) else (row, np.array([], np.int64))
        return own, distinct, content


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 31)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def _split(buckets_of_rows: np.ndarray):
    """(bucket, slice) of rows in ascending order of bucket."""
    cut = np.flatnonzero(np.diff(buckets_of_rows)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(buckets_of_rows)], strict=True):
        if hi > lo:
            yield int(buckets_of_rows[lo]), slice(lo, hi)


def _pack_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (0, 2))).reshape(-1).view("<u8").astype(np.uint64)


def _batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def _by_group(batches, columns: list[str]):
    """Lists of rows with one value in the first column; rows come sorted by it."""
    held, last = [], None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if held and row[0] != last:
                yield held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield held


_KEYS = {"bucket": pa.int64(), "chunk": pa.int64(), "keys": pa.binary()}
_STRETCHES = {"bucket": pa.int64(), "chunk": pa.int64(), "contents": pa.binary(), "low": pa.binary(), "high": pa.binary()}
_VERDICTS = {"chunk": pa.int64(), "bucket": pa.int64(), "runs": pa.binary()}
_RUN = np.dtype([("content", "<u4"), ("first", "u1"), ("last", "u1"), ("low", "<i8")])
_RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string(), "row": pa.int64()}
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def _schema(columns: dict) -> str:
    return ", ".join(f"{k} {_SQL[t]}" for k, t in columns.items())


def _chunk_of(rows: list[tuple]) -> Chunk:
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or ""))
    return Chunk([r[1] for r in rows], [r[2] for r in rows])


def _emit_keys(buckets: int):
    def run(batches):
        for rows in _by_group(batches, ["chunk", "doc_id", "text"]):
            keys = np.sort(_chunk_of(rows).keys())
            yield _batch(_KEYS, [(b, rows[0][0], _pack_keys(keys[s])) for b, s in _split(bucket_of(keys >> np.uint64(1), buckets))])

    return run


def _match_keys(batches):
    """Per chunk, those of its keys that also another chunk has, or that two of its own documents have."""
    for rows in _by_group(batches, ["bucket", "chunk", "keys"]):
        each = [_unpack_keys(r[2]) for r in rows]
        every = np.concatenate(each)
        key, count = np.unique(every >> np.uint64(1), return_counts=True)
        wanted = np.union1d(key[count > 1], every[every & np.uint64(1) == 1] >> np.uint64(1))
        out = []
        for (bucket, chunk, _), keys in zip(rows, each, strict=True):
            own = keys >> np.uint64(1)
            found = own[np.isin(own, wanted, assume_unique=True)]
            if len(found):
                out.append((bucket, chunk, _pack_keys(found)))
        yield _batch(_KEYS, out)


def _both_sides(function, schema: dict):
    """A function of a chunk's documents and of what it was told, for a cogrouped map."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows = list(zip(*(docs.column(c).to_pylist() for c in ("chunk", "doc_id", "text")), strict=True))
        out = function(rows, told) if rows else []
        return pa.Table.from_batches([_batch(schema, out)])

    return run


def _told_keys(told: pa.Table) -> np.ndarray:
    return np.concatenate([_unpack_keys(k) for k in told.column("keys").to_pylist()] or [np.array([], np.uint64)])


def _emit_stretches(buckets: int):
    def run(rows, told):
        if not told.num_rows:
            return []
        chunk = _chunk_of(rows)
        own, distinct, content = chunk.shared(_told_keys(told))
        ids = np.array(chunk._id_numbers(), np.int64)[chunk.doc[own]]
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        high = np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, content, ids)
        np.maximum.at(high, content, ids)
        parts = _split(bucket_of(distinct["key"].astype(np.uint64), buckets))
        return [(b, rows[0][0], distinct[s].tobytes(), low[s].tobytes(), high[s].tobytes()) for b, s in parts]

    return run


def _key_ranges(keys: np.ndarray) -> list[tuple[int, int]]:
    """Borders of runs of about ``_SORTED`` stretches, which are sorted together; those of one key are in one run."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    cuts = first[np.unique(np.searchsorted(first, np.arange(0, len(keys), _SORTED)).clip(max=len(first) - 1))]
    cuts = np.unique(np.append(cuts, [0, len(keys)])).tolist()
    return list(zip(cuts, cuts[1:], strict=False))


def _judge(batches):
    """Per chunk and bucket, runs of strings with an owner smaller than one of the chunk's documents that have them."""
    for rows in _by_group(batches, list(_STRETCHES)):
        contents = [np.frombuffer(r[2], _CONTENT) for r in rows]
        each = np.cumsum([0, *map(len, contents)])
        low, high = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in (3, 4))
        every = np.concatenate(contents)
        distinct, content = _distinct(every)
        owner = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(owner, content, low)
        parts = [smallest_owner(distinct["bytes"][x:y], distinct["size"][x:y].astype(np.int64), owner[x:y]) for x, y in _key_ranges(distinct["key"])]
        least = np.concatenate(parts)[content]
        strings = every["size"].astype(np.int64) - LENGTH + 1
        hit = (np.arange(STARTS)[None, :] < strings[:, None]) & (least < high[:, None])
        same = np.zeros_like(hit)
        same[:, 1:] = hit[:, 1:] & hit[:, :-1] & (least[:, 1:] == least[:, :-1])
        ends = hit.copy()
        ends[:, :-1] &= ~same[:, 1:]
        of, first = np.nonzero(hit & ~same)
        last = np.nonzero(ends)[1]
        out = []
        for i, r in enumerate(rows):
            a, b = np.searchsorted(of, [each[i], each[i + 1]])
            if b > a:
                runs = np.empty(b - a, _RUN)
                runs["content"], runs["first"], runs["last"], runs["low"] = of[a:b] - each[i], first[a:b], last[a:b], least[of[a:b], first[a:b]]
                out.append((r[1], r[0], runs.tobytes()))
        yield _batch(_VERDICTS, out)


def _apply(buckets: int, keep_text: bool):
    def run(rows, told):
        chunk = _chunk_of(rows)
        gone = np.zeros(len(chunk.bytes) + 1, np.int32)
        keys = [k for k in told.column("keys").to_pylist() if k is not None]
        if keys:
            own, distinct, content = chunk.shared(np.concatenate([_unpack_keys(k) for k in keys]))
            offset = np.searchsorted(bucket_of(distinct["key"].astype(np.uint64), buckets), np.arange(buckets + 1))
            ids = np.array(chunk._id_numbers(), np.int64)[chunk.doc[own]]
            order = np.argsort(content, kind="stable")
            ordered = content[order]
            for bucket, data in zip(told.column("bucket").to_pylist(), told.column("runs").to_pylist(), strict=True):
                if data is None:
                    continue
                runs = np.frombuffer(data, _RUN)
                which = runs["content"].astype(np.int64) + offset[bucket]
                a, b = np.searchsorted(ordered, which, "left"), np.searchsorted(ordered, which, "right")
                run_of = np.repeat(np.arange(len(runs)), b - a)
                at = order[np.arange(len(run_of)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
                fit = runs["low"][run_of] < ids[at]
                run_of, at = run_of[fit], at[fit]
                np.add.at(gone, chunk.lo[own[at]] + runs["first"][run_of], 1)
                np.add.at(gone, chunk.lo[own[at]] + runs["last"][run_of] + LENGTH, -1)
        removed = np.cumsum(gone)[:-1] > 0
        out = []
        for i, data, start, size in zip(chunk.ids, chunk.data, chunk.start.tolist(), chunk.size.tolist(), strict=True):
            mask = removed[start : start + size]
            n = int(mask.sum())
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if n else 0
            kept = chunk.bytes[start : start + size][~mask].tobytes() if n else data
            out.append((i, size, n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None, (xxhash.xxh64_intdigest(data, 42) ^ 1 << 63) - (1 << 63)))
        return out

    return run


def repeated_passages(docs: DataFrame, keep_text: bool = False, chunk_bytes: int = 2 << 20, bucket_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, (if asked for) ``kept`` and ``row`` of each document.

    row: xxhash64 of the text as it was, which tells rows apart that share an id. kept: the bytes that stay as text; where a cut divides a character, its left-over bytes go too.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text, zero = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    apart = docs.where("doc_id is null").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"), (text if keep_text else F.lit(None).cast("string")).alias("kept"), F.xxhash64(text).alias("row"))
    docs = docs.where("doc_id is not null")
    total, n_docs = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if not n_docs:
        return apart
    chunks, buckets = ceil(((total or 0) + 1) / chunk_bytes), ceil(((total or 0) + 1) / bucket_bytes)
    tasks = max(1, min(chunks, 20_000))
    # held once in files by chunk, so that later joins by chunk move what they bring, and no texts
    held = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(tasks, "chunk")
    held = bucketed(held, tasks, "chunk", "chunks")
    keys = held.sortWithinPartitions("chunk").mapInArrow(_emit_keys(buckets), _schema(_KEYS))
    told = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_match_keys, _schema(_KEYS))
    told = materialize(told, "keys")
    stretches = held.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_both_sides(_emit_stretches(buckets), _STRETCHES), _schema(_STRETCHES))
    verdicts = stretches.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judge, _schema(_VERDICTS))
    verdicts = materialize(verdicts, "verdicts")
    told = told.select("chunk", "bucket", "keys", F.lit(None).cast("binary").alias("runs")).unionByName(verdicts.select("chunk", "bucket", F.lit(None).cast("binary").alias("keys"), "runs"))
    done = held.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_both_sides(_apply(buckets, keep_text), _RESULT), _schema(_RESULT))
    return done.unionByName(apart)


def op10_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "row")
