"""Fuzzy line deduplication over a corpus.

Lines are normalised (lower case, runs of anything but letters and digits made one space), brought together by
a 128-bit digest of that form, and get a 64-bit SimHash of their distinct words. Two different lines are linked if
their SimHashes differ in at most RADIUS bits and the edit similarity of their normalised forms is 0.75 or more.
Cut into blocks, two such SimHashes agree in all but RADIUS blocks, so lines meet by each choice of the other blocks.
How many blocks there are and how many of them deal the lines to tasks follows the number of lines and
changes no link. Of each connected group of lines one occurrence stays, that of the smallest (doc_id, row, position), where
row is a hash of the text; repeats of one line are one line from the start and are never expanded to pairs.

Between tasks travel packed stretches of lines and of SimHashes, not a row per line or key. An occurrence that is
not the least of its line in its own stretch is redundant wherever the others are, so a frequent line leaves only one
occurrence per stretch to compare.

Cases: a line without letters and digits is only compared exactly, by its stripped text; blank lines always stay; a null
text stays null; rows without an id stay as they are; rows that share an id but not the text are documents of their own;
rows equal in both are one document and keep the same lines; a text all of whose lines go becomes empty; a line of any length is worked
on whole; an empty table gives an empty result; all input columns are returned, and only an input column
``lines_removed`` is replaced.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, returning
from .groups import Links, connect, link_sets

RADIUS = 7
SIMILARITY = 0.75
_HELD = 32 << 20  # bytes of distinct lines that a task combines before it sends them on
_SALTS = 16
_SINGLE = 256  # words of a line that is counted by itself
_PART = 24 << 20  # bytes of text per task that merges lines
_MEMBERS = 1 << 21  # SimHashes that share the blocks by which they are dealt, in the mean
_UNIT = 64  # bytes of a line that are one of weight
_GAP = re.compile(r"[^\w\n]+")
_LATIN = bytes(c if chr(c).isalnum() or c == 10 else 32 for c in range(256))
_STEP = 1 << 14  # lines whose words are held at a time


def normalised(text: str) -> list[bytes]:
    """The normalised form of each line of a text, in UTF-8; empty for blank lines, marked for those of signs only."""
    plain = text.lower()
    try:
        lines = plain.encode("latin-1").translate(_LATIN).split(b"\n")
        found = b"\n".join([b" ".join(line.split()) for line in lines])
        found = (found if plain.isascii() else found.decode("latin-1").encode()).split(b"\n")
    except UnicodeEncodeError:
        found = [line.strip(" ").encode("utf-8", "surrogatepass") for line in _GAP.sub(" ", plain.replace("_", " ")).split("\n")]
    if not all(found):
        for i, raw in enumerate(text.split("\n")):
            if not found[i] and (bare := raw.strip()):
                found[i] = b"\0" + bare.encode("utf-8", "surrogatepass")
    return found


_POWERS = np.cumprod(np.append(np.uint64(1), np.full((1 << 16) - 1, 0x9E3779B97F4A7C15, np.uint64)))


def word_hashes(words: pa.Array, bytes_as: np.ndarray | None = None) -> np.ndarray:
    """Hashes of different words, from their bytes, or from what a table makes of each byte."""
    _, offsets, data = words.buffers()
    first = np.frombuffer(offsets, np.int64, len(words) + 1)
    raw, size = np.frombuffer(data or b"", np.uint8, int(first[-1])), np.diff(first)
    raw = raw if bytes_as is None else bytes_as[raw]
    out = size.astype(np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        place = np.arange(len(raw)) - np.repeat(first[:-1], size)
        out[some] += np.add.reduceat((raw + np.uint64(1)) * _POWERS[place % len(_POWERS)], first[:-1][some])
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        out = (out ^ out >> np.uint64(shift)) * np.uint64(factor)
    return out


def simhashes(lines: list[bytes]) -> np.ndarray:
    """For each line, the bits that more than half of its distinct words' hashes have.

    Words are added to all lines at once, as bits of counters that hold 64 sums side by side; long lines one by one.
    """
    return np.concatenate([_simhashes(lines[i : i + _STEP]) for i in range(0, len(lines), _STEP)] or [np.zeros(0, np.uint64)])


def _simhashes(lines: list[bytes]) -> np.ndarray:
    out = np.zeros(len(lines), np.uint64)
    split = pc.split_pattern(pa.array(lines, pa.large_binary()), b" ")
    words = split.flatten().dictionary_encode()
    hashes = word_hashes(words.dictionary)
    count = np.diff(split.offsets.to_numpy())
    key = np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(32), count) | words.indices.to_numpy().astype(np.uint64)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    sizes = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(lines))
    flat = hashes[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    first = np.cumsum(sizes) - sizes
    for i in np.flatnonzero(sizes > _SINGLE).tolist():
        sums, end = np.zeros(64, np.int64), int(first[i] + sizes[i])
        for at in range(int(first[i]), end, 1 << 16):
            some = flat[at : min(at + (1 << 16), end)].astype("<u8").view(np.uint8).reshape(-1, 8)
            sums += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * sums > sizes[i], bitorder="little").view("<u8")[0]
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] <= _SINGLE]
    for at in range(0, len(order), 4096):
        group = order[at : at + 4096]
        n, base = sizes[group], first[group]
        bits = int(n[0]).bit_length()
        sums = np.zeros((bits, len(group)), np.uint64)
        active = np.searchsorted(-n, -np.arange(int(n[0])), side="left")  # lines of more than j words
        for j, m in enumerate(active.tolist()):
            carry = flat[base[:m] + j]
            for k in range((j + 1).bit_length()):
                plane = sums[k, :m]
                over = plane & carry
                plane ^= carry
                carry = over
        least = (n // 2 + 1).astype(np.uint64)
        more, same = np.zeros(len(group), np.uint64), np.full(len(group), ~np.uint64(0))
        for k in range(bits - 1, -1, -1):
            wanted = np.uint64(0) - ((least >> np.uint64(k)) & np.uint64(1))
            more |= same & sums[k] & ~wanted
            same &= ~(sums[k] ^ wanted)
        out[group] = more | same
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as bits of one integer (Myers; Hyyrö)."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        distance += bool(plus & top) - bool(minus & top)
        plus = plus << 1 & full | 1
        minus = minus << 1 & full
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
    return distance


def similar_lines(a: str, b: str) -> bool:
    longest = max(len(a), len(b))
    most = (1 - SIMILARITY) * longest
    if abs(len(a) - len(b)) > most:
        return False
    v, w = a.split(" "), b.split(" ")
    # words exchanged one for one are a way to edit, so the distance is no longer than that
    if len(v) == len(w) and sum(max(len(x), len(y)) for x, y in zip(v, w, strict=True) if x != y) <= most:
        return True
    return edit_distance(a, b) <= most


def _linked(items: list[tuple[str, int]]):
    """Pairs of lines close in both measures, enough to connect all that are."""
    links, hashes = Links(len(items)), np.array([h for _, h in items], np.uint64)
    for x in range(len(items) - 1):
        for y in (np.flatnonzero(np.bitwise_count(hashes[x + 1 :] ^ hashes[x]) <= RADIUS) + x + 1).tolist():
            if links.find(x) != links.find(y) and similar_lines(items[x][0], items[y][0]):
                links.join(x, y)
                yield x, y


def _prepared(content: bytes) -> tuple[str, int]:
    return content[8:].decode("utf-8", "surrogatepass"), int.from_bytes(content[:8], "little")


# -- distinct lines --------------------------------------------------------------------------------------------

_STRETCH = "part int, n int, heads binary, lines binary"


def _combined(parts: int):
    """Packed stretches of distinct lines with their least occurrence, and of all other occurrences."""

    def packed(first: dict, spare: list):
        rows = []
        if first:
            pack = zstandard.ZstdCompressor(level=1)
            digests = np.frombuffer(b"".join(first), np.uint64).reshape(-1, 2)
            at, lines = zip(*first.values(), strict=True)
            at = np.array(at, np.int64)
            part = (digests[:, 0] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                some = order[edges[p] : edges[p + 1]]
                rows.append((p, len(some), digests[some].tobytes() + at[some].tobytes(), pack.compress(b"\n".join([lines[i] for i in some.tolist()]))))
        if spare:
            rows.append((xxhash.xxh32_intdigest(repr(spare[0])) % parts, len(spare), np.array(spare, np.int64).tobytes(), None))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "n", "heads", "lines"])

    def run(batches):
        first, spare, held = {}, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for doc_id, row, text in zip(*(batch.column(c).slice(start, 256).to_pylist() for c in range(3)), strict=True):
                    for position, line in enumerate(normalised(text) if text else ()):
                        if not line:
                            continue
                        key, at = xxhash.xxh3_128_digest(line), (doc_id, row, position)
                        held += 200
                        if (known := first.get(key)) is None:
                            first[key] = (at, line)
                            held += len(line)
                        elif at < known[0]:
                            spare.append(known[0])
                            first[key] = (at, line)
                        elif at > known[0]:
                            spare.append(at)
                if held > _HELD:
                    yield packed(first, spare)
                    first, spare, held = {}, [], 0
        yield packed(first, spare)

    return run


_LINE = {"id": pa.int64(), "doc_id": pa.int64(), "row": pa.int64(), "position": pa.int32(), "simhash": pa.int64(), "content": pa.binary()}


def _merged(batches):
    """A row per distinct line with a number of its own; rows without one are redundant occurrences."""
    from pyspark import TaskContext

    digests, at, lines, spare = [], [], [], []
    for batch in batches:
        for n, heads, packed in zip(*(batch.column(c).to_pylist() for c in ("n", "heads", "lines")), strict=True):
            if packed is None:
                spare.append(np.frombuffer(heads, np.int64).reshape(n, 3))
            else:
                digests.append(np.frombuffer(heads, np.uint64, 2 * n).reshape(n, 2))
                at.append(np.frombuffer(heads, np.int64, 3 * n, 16 * n).reshape(n, 3))
                lines += zstandard.decompress(packed).split(b"\n")
    step = 20_000
    if digests:
        d, o = np.concatenate(digests), np.concatenate(at)
        order = np.lexsort((o[:, 2], o[:, 1], o[:, 0], d[:, 1], d[:, 0]))
        d, o = d[order], o[order]
        new = np.append(True, (d[1:] != d[:-1]).any(axis=1))
        least = np.flatnonzero(new)
        others = ~new & (o != o[least[np.cumsum(new) - 1]]).any(axis=1)
        spare.append(o[others])
        number = TaskContext.get().partitionId() << 36
        for i in range(0, len(least), step):
            some = least[i : i + step]
            texts = [lines[k] for k in order[some].tolist()]
            hashes = simhashes(texts)
            columns = [
                pa.array(np.arange(number + i, number + i + len(some)), pa.int64()), *(pa.array(o[some, c], pa.int64()) for c in (0, 1)), pa.array(o[some, 2].astype(np.int32)),
                pa.array(hashes.view(np.int64), pa.int64(), mask=np.array([t.startswith(b"\0") for t in texts])),
                pa.array([h.tobytes() + t for h, t in zip(hashes, texts, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, list(_LINE))
    for o in spare:
        for i in range(0, len(o), step):
            some = o[i : i + step]
            none = [pa.nulls(len(some), _LINE[c]) for c in ("id", "simhash", "content")]
            columns = [none[0], *(pa.array(some[:, c], pa.int64()) for c in (0, 1)), pa.array(some[:, 2].astype(np.int32)), *none[1:]]
            yield pa.RecordBatch.from_arrays(columns, list(_LINE))


# -- lines whose SimHashes are close ---------------------------------------------------------------------------


def block_masks(blocks: int) -> list[int]:
    """Bits of each of so many blocks of a SimHash."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def layout(n_lines: int) -> tuple[int, int]:
    """Blocks, and how many of them deal the lines to tasks."""
    blocks = next((b for b in range(RADIUS + 3, RADIUS + 6) if n_lines < 1 << 64 * (b - RADIUS) // b + 1), RADIUS + 6)
    width = 64 / blocks
    dealing = max(1, math.ceil(math.log2(max(1, n_lines / _MEMBERS)) / width))
    return blocks, min(dealing, blocks - RADIUS)


def choices(blocks: int, dealing: int) -> list[tuple[int, list[int]]]:
    """Masks by which lines are dealt, each with the masks of all the choices of blocks that begin with it."""
    masks, found = block_masks(blocks), {}
    for chosen in combinations(masks, blocks - RADIUS):
        found.setdefault(sum(chosen[:dealing]), []).append(sum(chosen))
    return list(found.items())


_MEMBER = np.dtype([("simhash", "<u8"), ("id", "<i8"), ("weight", "<u2")])


def _dealt(dealing: list[int]):
    """Packed SimHashes of the lines that agree in the blocks of a dealing mask."""

    def run(batches):
        held = []
        for b in batches:
            rows = np.empty(b.num_rows, _MEMBER)
            rows["id"], rows["simhash"] = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            rows["weight"] = np.minimum(b.column(2).to_numpy() // _UNIT + 1, 65_535)
            held.append(rows)
            if sum(map(len, held)) >= 1 << 18:
                yield packed(np.concatenate(held))
                held = []
        if held:
            yield packed(np.concatenate(held))

    def packed(rows):
        parts, data = [], []
        for number, mask in enumerate(dealing):
            key = rows["simhash"] & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            sorted_rows, key = rows[order], key[order]
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                parts.append(xxhash.xxh64_intdigest(key[a].tobytes(), number) - (1 << 63))
                data.append(sorted_rows[a:z].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["part", "members"])

    return run


def connected(hashes: np.ndarray, masks: list[int]) -> np.ndarray:
    """A label for each of some different SimHashes, equal for those connected by pairs within the radius that agree in a mask."""
    label, place, low = np.arange(len(hashes)), np.arange(len(hashes), dtype=np.uint64), np.uint64(max(1, len(hashes).bit_length()))
    for mask in masks:
        # the upper bits of a product of the key with the place below them sort fast; keys that it makes equal only cost a comparison
        key = (hashes & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15)
        key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> low << low | place
        key.sort()
        order = (key & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)
        label = connect(key >> low, order, label, lambda a, b: np.bitwise_count(hashes[a] ^ hashes[b]) <= RADIUS)
    return label


def _close(masks_of: list[tuple[int, list[int]]]):
    """``node, id, root, weight``: sets of lines that are connected by SimHashes within the radius."""

    def groups(part: int, rows):
        hashes, inverse = np.unique(rows["simhash"], return_inverse=True)
        number = next(k for k, (mask, _) in enumerate(masks_of) if xxhash.xxh64_intdigest((hashes[0] & np.uint64(mask)).tobytes(), k) - (1 << 63) == part)
        label = connected(hashes, masks_of[number][1])[inverse]
        many = np.bincount(label)[label] > 1
        ids, label, weight = rows["id"][many], label[many], rows["weight"][many].astype(np.int64) * _UNIT
        kinds, first, which = np.unique(label, return_index=True, return_inverse=True)
        node = np.array([xxhash.xxh64_intdigest(f"{part} {of}") - (1 << 63) for of in kinds.tolist()], np.int64)
        return node[which], ids, ids[first][which], weight

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(np.frombuffer(data, _MEMBER))
        while held:
            part, found = held.popitem()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in groups(part, np.concatenate(found))], ["node", "id", "root", "weight"])

    return run


def near_lines(lines: DataFrame, n_lines: int, parts: int) -> DataFrame:
    """``node, id, root, weight`` sets in which any two lines within the radius meet; ``lines``: id, simhash, content."""
    masks_of = choices(*layout(n_lines))
    parts = max(parts, -(-n_lines * len(masks_of) * _MEMBER.itemsize // _PART))
    sent = lines.select("id", "simhash", F.octet_length("content").cast("long").alias("weight"))
    dealt = sent.mapInArrow(returning(_dealt([mask for mask, _ in masks_of])), "part long, members binary").repartition(parts, "part")
    return dealt.mapInArrow(returning(_close(masks_of)), "node long, id long, root long, weight long")


# -- the operator ----------------------------------------------------------------------------------------------


def repeated_lines(docs: DataFrame, max_ids: int = 2000, max_weight: int = 4_000_000) -> DataFrame:
    """``doc_id, row, position`` of all line occurrences that another occurrence makes redundant; row is xxhash64(text)."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // _PART))
    schema = "id long, doc_id long, row long, position int, simhash long, content binary"
    found = materialize(docs.mapInArrow(returning(_combined(parts)), _STRETCH).repartition(parts, "part").mapInArrow(returning(_merged), schema), "lines")
    lines = found.where("simhash is not null")
    sets = near_lines(lines, lines.count(), parts)
    links = link_sets(sets, lines.select("id", "content"), _prepared, _linked, max_ids, max_weight)
    groups = components(links)
    first = F.struct("doc_id", "row", "position").alias("first")
    named = materialize(lines.select(F.col("id").alias("node"), first).join(groups, "node").select("component", "first"), "repeats")
    kept = named.groupBy("component").agg(F.min("first").alias("kept")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    named = named.withColumn("salt", F.pmod(F.hash("first"), F.lit(_SALTS)))  # a large group's lines are looked up in several tasks
    linked = named.join(kept, ["component", "salt"]).where("first <> kept").select("first.*")
    return found.where("id is null").select("doc_id", "row", "position").unionByName(linked)


def _flags(batches):
    """Sorted positions, and for each line up to the last of them whether it is one."""
    for b in batches:
        positions = [np.sort(np.array(p, np.int32)) for p in b.column(2).to_pylist()]
        flags = [np.bincount(p).astype(bool) for p in positions]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(positions, pa.list_(pa.int32())), pa.array(flags, pa.list_(pa.bool_()))], ["doc_id", "row", "lines_removed", "flags"])


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``lines_removed`` (positions, null for none)."""
    gone = repeated_lines(docs.select("doc_id", "text"), **options).groupBy("doc_id", "row").agg(F.collect_set("position").alias("positions"))
    gone = gone.mapInArrow(_flags, "doc_id long, row long, lines_removed array<int>, flags array<boolean>").hint("shuffle_hash").alias("g")
    d = docs.alias("d")
    out = d.join(gone, (F.col("d.doc_id") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.row")), "left")
    kept = F.zip_with(F.split("d.text", "\n"), "g.flags", lambda line, flag: F.when(F.coalesce(flag, F.lit(False)), None).otherwise(line))
    text = F.when(F.col("g.flags").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n")).alias("text")
    return out.select(*(text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c != "lines_removed"), "g.lines_removed")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), kept_sha256 (of the text that stays, in UTF-8) of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = dedup_lines(docs)
    removed = F.when(F.col("lines_removed").isNull(), 0).otherwise(F.size("lines_removed"))
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), removed.cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
