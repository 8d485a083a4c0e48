"""Near-duplicate documents: a set similarity join over word shingles by chosen paths.

A document's set has its distinct five-word shingles. Documents with equal sets are one class;
classes are then sent down random trees. At each node a random few of the minwise functions
are chosen, two in the mean, and a class goes to the child named by its minwise token
for each of them, so that two classes at the threshold meet in one or two children in the mean
and unlike ones part at once. In nodes small enough all classes are compared by sketches, a byte of each
minwise token; larger ones branch again, and what is still large at the last level is
compared in blocks, whole. Classes whose sketches agree as often as those of two at the threshold nearly always do are
then compared exhaustively on full sets, with prefix filtering, each text being read once but for those in groups
over the limits. Trees are repeated to the target recall at the deepest level.

Cases: a null, empty or blank text has an empty set and links with nothing; a text of fewer words
than a shingle is one shingle; rows with equal sets are linked; rows that share an id are in one class or
linked like other rows; an empty table gives an empty result; only id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, is_empty, materialize, returning
from .groups import Links, connect, link_sets
from .lines import word_hashes

WORDS = 5
PERCENT = 75  # least 100 * |A & B| / |A | B| of a link
FUNCTIONS = 32
SPREAD = 16  # a node that branches chooses each function with probability 1 / SPREAD
_RNG = np.random.default_rng(20_24)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20
_STEP = 4 << 20  # bytes of text that are cut into words at a time, beside one text
_REMEMBERED = 8192  # sets of which the pairs that differ are noted, a byte each
_PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    return list(each_shingle_set(texts))


def each_shingle_set(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles. Letters beyond ASCII keep their case, and only ASCII white space divides, as asked."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.searchsorted(sizes, np.arange(_STEP, int(sizes[-1]) if len(sizes) else 0, _STEP)) + 1
    borders = sorted({0, *cuts.tolist(), len(texts)})
    for a, z in zip(borders, borders[1:], strict=False):
        split = pc.ascii_split_whitespace(pc.fill_null(texts.slice(a, z - a), "").cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        h = word_hashes(words.dictionary, _LOWERED)[words.indices.to_numpy()]
        filled = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[words.indices.to_numpy()] if len(words) else np.zeros(0, bool)
        ends = np.append(0, np.cumsum(filled))[split.offsets.to_numpy() - split.offsets[0].as_py()]  # white space at a text's ends makes empty words
        h = h[filled]
        last = max(0, len(h) - WORDS + 1)
        runs = np.zeros(last, np.uint64)
        for i in range(WORDS):
            runs += h[i : i + last] * _PLACE[i]
        runs = _mixed(runs)
        for first, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            n = end - first
            if n >= WORDS:
                s = np.sort(runs[first : end - WORDS + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif n:
                with np.errstate(over="ignore"):
                    s = _mixed((h[first:end] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
                yield s
            else:
                yield np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()))[0]


def _mixed(s: np.ndarray) -> np.ndarray:
    s = (s ^ s >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return s ^ s >> np.uint64(29)


def minwise(s: np.ndarray) -> np.ndarray:
    """The least value of each function over a set; each function is a bijection, so it names the token."""
    low = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(low, ((s[i : i + 4096, None] ^ _MASKS) * _MULTIPLIERS).min(axis=0), out=low)
    return low.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_digest, sketch, signature of each document; the last three are null for empty sets."""

    def run(batches):
        for batch in batches:
            n, digests, signatures, bytes_ = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(minwise(s) if len(s) else None)
                bytes_.append((signatures[-1] >> 24).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, bytes_)), pa.array(signatures, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_digest", "sketch", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(returning(run), "doc_id long, n_shingles long, set_digest binary, sketch binary, signature array<long>")


def _linked(sets: list[np.ndarray]):
    """Pairs of sets at or over the threshold, enough to connect all that are."""
    n = len(sets)
    if n < 2:
        return
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    tokens, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    links, found, marked = Links(n), [], np.zeros(len(tokens), bool)
    differ = np.zeros(n * n if n <= _REMEMBERED else 0, bool)

    def similar(x: int, others: np.ndarray) -> np.ndarray:
        own, lengths = token[starts[x] : starts[x] + sizes[x]], sizes[others]
        begins = np.cumsum(lengths) - lengths
        marked[own] = True
        both = np.add.reduceat(marked[token[np.repeat(starts[others] - begins, lengths) + np.arange(lengths.sum())]], begins, dtype=np.int64)
        marked[own] = False
        return 100 * both >= PERCENT * (len(own) + lengths - both)

    def close(a, b):
        pair, at = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
        x, y = pair // n, pair % n
        hit = 100 * np.minimum(sizes[x], sizes[y]) >= PERCENT * np.maximum(sizes[x], sizes[y])
        if len(differ):
            hit &= ~differ[pair]
        todo = np.flatnonzero(hit)
        if len(todo):
            i, j = x[todo], y[todo]
            swap = np.bincount(j, minlength=n)[j] > np.bincount(i, minlength=n)[i]  # the one in more pairs is marked
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            order = np.argsort(i, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
                hit[todo[part]] = similar(i[part[0]], j[part])
        if len(differ):
            differ[pair[~hit]] = True
        for i, j in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
            if links.find(i) != links.find(j):
                links.join(i, j)
                found.append((i, j))
        return hit[at]

    # each set's rarest tokens, so many that two sets at the threshold share one of them
    rank = np.empty(len(tokens), np.uint64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(tokens), dtype=np.uint64)
    own = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(40), sizes) | rank[token]
    own.sort()
    prefix = sizes - (PERCENT * sizes + 99) // 100 + 1
    own = own[np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(prefix, sizes)]
    key, item = own & np.uint64((1 << 40) - 1), (own >> np.uint64(40)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    connect(key[order], item[order], np.arange(n), close)
    yield from found


def met(paths: int, levels: int) -> float:
    """Probability that a pair at the threshold shares a node ``levels`` below the root, of root paths of so many functions.

    All nodes draw on the same functions. The pair agrees in s of them, s binomial; each child of a shared node is shared if
    its function is among these, and of the root's paths as many as a draw without repetition from all functions gives.
    """
    p, lost = PERCENT / 100, 0.0
    for s in range(FUNCTIONS + 1):
        below = 1.0
        for _ in range(levels):
            below = 1 - (1 - below / SPREAD) ** s
        ways = ((math.comb(s, m) * math.comb(FUNCTIONS - s, paths - m), m) for m in range(min(s, paths) + 1))
        apart = sum(w * (1 - below) ** m for w, m in ways) / math.comb(FUNCTIONS, paths)
        lost += math.comb(FUNCTIONS, s) * p**s * (1 - p) ** (FUNCTIONS - s) * apart
    return 1 - lost


def root_paths(recall: float, levels: int) -> tuple[list[tuple[int, int]], int]:
    """(tree, function) of the roots' children, so many that ``recall`` is reached ``levels`` below them, and how many all classes take.

    Nodes that never branch lose a pair only if it agrees in none of their functions, so few paths do for them; two classes
    that meet in a large node only both take the others too.
    """
    wanted = next((n for n in range(1, FUNCTIONS + 1) if min(met(n, k) for k in range(levels + 1)) >= recall), None)
    if wanted is None:
        raise ValueError(f"near-duplicates: {FUNCTIONS} functions do not reach a recall of {recall} at {levels} levels")
    few = next((n for n in range(1, wanted) if 1 - met(n, 0) <= (1 - recall) / 100_000), wanted)
    rng, roots, seen = np.random.default_rng(77), [], set()
    tree = 0
    while len(seen) < wanted:
        for c in np.flatnonzero(rng.random(FUNCTIONS) < 1 / (PERCENT / 100 * FUNCTIONS)).tolist():
            if c not in seen and len(seen) < wanted:
                seen.add(c)
                roots.append((tree, c))
        tree += 1
    return roots, few


def chosen_paths(classes: DataFrame, recall: float, levels: int, max_ids: int) -> DataFrame:
    """``classes`` rows with the ``node`` they are in, so that any two at the threshold meet in one with high probability.

    classes: ``id, signature`` and what else is to be carried along. A node over the limit branches again, up to ``levels``
    times; what is still larger at the last level comes as nodes of two of its blocks each, for all pairs of blocks.
    """
    roots, few = root_paths(recall, levels)
    carried = [c for c in classes.columns if c != "signature"]

    def below(rows, paths):
        made = rows.withColumn("node", F.explode(F.array(*(F.xxhash64(F.lit(t), F.lit(c), F.get("signature", F.lit(c))) for t, c in paths))))
        return materialize(made.select("node", *carried), "level")

    def over(nodes):
        return materialize(nodes.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > max_ids), "large")

    nodes, done = below(classes, roots[:few]), []
    for level in range(levels + 1):
        large = over(nodes)
        if is_empty(large):
            break
        if not level and few < len(roots):
            hot = materialize(nodes.join(large, "node", "left_semi").select("id").distinct(), "hot")
            nodes = nodes.unionByName(below(classes.join(hot, "id", "left_semi"), roots[few:]))
            large = over(nodes)
        done.append(nodes.join(large, "node", "left_anti"))
        rows = nodes.join(large, "node")
        if level < levels:
            rows = rows.join(classes.select("id", "signature"), "id")
            chosen = F.filter(F.sequence(F.lit(0), F.lit(FUNCTIONS - 1)), lambda c: F.pmod(F.xxhash64("node", c), F.lit(SPREAD)) == 0)
            rows = rows.withColumn("c", F.explode(chosen)).withColumn("node", F.xxhash64("node", "c", F.get("signature", F.col("c"))))
        else:
            rows = rows.withColumn("blocks", F.ceil(2 * F.col("n") / max_ids)).withColumn("own", F.pmod(F.xxhash64("node", "id"), "blocks"))
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            rows = rows.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
        nodes = materialize(rows.select("node", *carried), "level")
    for part in done:
        nodes = nodes.unionByName(part.select(*nodes.columns))
    return nodes


def least_agreement(lost: float = 1e-6) -> int:
    """In so many functions, or more, two sets at the threshold agree, but for a probability of ``lost``."""
    p, below = PERCENT / 100, 0.0
    for k in range(FUNCTIONS + 1):
        below += math.comb(FUNCTIONS, k) * p**k * (1 - p) ** (FUNCTIONS - k)
        if below > lost:
            return k
    return FUNCTIONS


AGREE = least_agreement()
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bytes the rows of two tables of 64-bit words agree."""
    x = a ^ b
    return np.bitwise_count(~((((x & _LOW) + _LOW) | x) | _LOW) & _HIGH).sum(axis=1, dtype=np.int64)


def _alike(batches):
    """``node, id, root, weight``: sets of a node's classes that sketches, a byte of each function's least value, connect."""
    rest = None

    def sets(node, ids, weight, sketch):
        def close(a, b):
            out = np.empty(len(a), bool)
            for i in range(0, len(a), 1 << 15):
                x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
                near = 100 * np.minimum(weight[x], weight[y]) >= PERCENT * np.maximum(weight[x], weight[y])  # else never linked
                near[near] = agreeing(sketch[x[near]], sketch[y[near]]) >= AGREE
                out[i : i + (1 << 15)] = near
            return out

        label = connect(node, np.arange(len(node)), np.arange(len(node)), close)
        many = np.bincount(label, minlength=len(label))[label] > 1
        kinds, first, which = np.unique(label[many], return_index=True, return_inverse=True)
        root, ids, node, weight = ids[kinds][which], ids[many], node[many], weight[many]
        names = np.array([xxhash.xxh64_intdigest(f"{n} {r}") - (1 << 63) for n, r in zip(node[first].tolist(), root[first].tolist(), strict=True)], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (names[which], ids, root, weight)], ["node", "id", "root", "weight"])

    for b in batches:
        sketch = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(-1, FUNCTIONS // 8)
        now = [*(b.column(c).to_numpy() for c in range(3)), sketch]
        if rest is not None:
            now = [np.concatenate(c) for c in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on in the next batch
        rest = [c[cut:] for c in now]
        if cut:
            yield sets(*(c[:cut] for c in now))
    if rest is not None and len(rest[0]):
        yield sets(*rest)


def near_duplicates(docs: DataFrame, recall: float = 0.9999, levels: int = 3, max_ids: int = 1500, max_weight: int = 1_000_000, max_node: int = 4096) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document."""
    sketch = materialize(sketches(docs), "sketches")
    full = sketch.where("n_shingles > 0")
    same = full.groupBy("set_digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("weight"), F.first(F.struct("signature", "sketch")).alias("s"))
    classes = materialize(same.where("id is not null").select("set_digest", "id", "weight", "s.*"), "classes")
    nodes = chosen_paths(classes.select("id", "weight", "sketch", "signature"), recall, levels, max_node)
    rows = nodes.select("node", "id", "weight", "sketch").repartition("node").sortWithinPartitions("node")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("content"))
    links = link_sets(rows.mapInArrow(returning(_alike), "node long, id long, root long, weight long"), texts, each_shingle_set, _linked, max_ids, max_weight, many=True)
    found = components(links)
    named = classes.select("set_digest", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("set_digest", F.coalesce("component", "id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "set_digest").join(named, "set_digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.unionByName(sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
