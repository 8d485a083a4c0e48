"""Packing of documents into training sequences by lexical retrieval.

Documents are encoded once and dealt to shards by content: ordered by their two terms of most weight
that other documents have too. A shard has about half of ``block_ids`` ids and one BM25 inverted index, and is
cut into several only if it came out at ``block_ids`` or more, with document frequencies and lengths of the whole corpus; the terms are token ids, so
these statistics are bounded by the vocabulary. A seed document opens a sequence and its unused
neighbours, best first, fill the window; the document that reaches over the window's end is cut there,
and its rest is the next seed. So all sequences of a shard are full but the last, which is cut into
sequences whose lengths are powers of two, which need no padding either.

Cases: a null or empty text is the end id alone; a text of many windows fills several; ties in score go to the
document that comes first in the shard; repeated rows are documents of their own; an empty table gives an
empty result; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 4096
END_ID = 2
K1, B = 1.2, 0.75


_BELOW = [chr(c) for c in range(0x180)]
_LETTER, _DIGIT = ("".join(re.escape(c) for c in _BELOW if unicodedata.category(c)[0] == k) for k in "LN")
_MARK = "".join(re.escape(c) for c in _BELOW if unicodedata.category(c)[0] in "PSC" and not c.isspace())
_LATIN = re.compile(f"[{_LETTER}{_DIGIT}{_MARK}]+")
# The contractions that the tokenizer's pattern names, before letters, single digits and the rest.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}]+")


#: Bytes of UTF-8 that spell letters up to U+00FF, either case, and the same in lower case. A stretch of these alone has no
#: other lead byte than C3, so each byte tells its own case.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *(c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7))]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[[*range(0x41, 0x5B), *(c for c in range(0x80, 0x9F) if c != 0x97)]] += 0x20

_SIGNS = np.zeros(256, bool)  # ASCII signs that are one piece with each other, whatever is before them
_SIGNS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<|"]] = True


class Merges:
    """Byte-pair merges of many words at once: of each word the pair of least rank, the leftmost if it occurs twice, again and again."""

    LONGEST = 40  # bytes of a word; longer ones go to the library

    def __init__(self, model: dict):
        vocabulary, self.width = model["vocab"], np.uint32(len(model["vocab"]))
        if len(vocabulary) >= 1 << 16:
            raise ValueError("merges: pairs of ids must fit in 32 bits")
        # the public byte alphabet: printable Latin-1 characters stand for their own bytes, the other bytes for U+0100 onwards
        own = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or 0xAE <= c]
        others = [c for c in range(256) if c not in own]
        sign = {c: chr(c) for c in own} | {c: chr(256 + i) for i, c in enumerate(others)}
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocabulary[sign[c]] for c in range(256)], np.uint32)
        self.last = np.array([vocabulary[sign[c] + end] for c in range(256)], np.uint32)
        pairs = [(vocabulary[x], vocabulary[y], vocabulary[x + y]) for x, y in model["merges"]]
        left, right, self.merged = (np.array(c, np.uint32) for c in zip(*pairs, strict=True))
        self.none = len(pairs)
        self._place(left * self.width + right)
        self.begin = np.stack([self._ranks(self.inner[:, None], last[None, :]) for last in (self.inner, self.last)])

    def _place(self, keys: np.ndarray) -> None:
        """A hash table of pairs; a pair lies at its slot or at the next free one."""
        self.bits, self.reach = 18, 0
        self.slots = np.full((1 << self.bits) + 64, 0xFFFFFFFF, np.uint32)
        self.slot_rank = np.full(len(self.slots), self.none, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            at = slot
            while self.slots[at] != 0xFFFFFFFF:
                at += 1
            self.slots[at], self.slot_rank[at], self.reach = key, rank, max(self.reach, at - slot)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = np.broadcast_shapes(left.shape, right.shape)
        key = (left * self.width + right).ravel()
        slot = self._slot(key).astype(np.int64)
        there = self.slots[slot]
        found = np.where(there == key, self.slot_rank[slot], np.int32(self.none))
        open_ = np.flatnonzero((there != key) & (there != 0xFFFFFFFF))
        for _ in range(self.reach):
            if not len(open_):
                break
            slot[open_] += 1
            there = self.slots[slot[open_]]
            hit = there == key[open_]
            found[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0xFFFFFFFF)]
        return found.reshape(shape)

    def encode(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given as stretches of bytes, one after another in no order, and (word, size) of each in that order."""
        ids, names = [np.zeros(0, np.uint32)], [np.zeros((2, 0), np.int64)]
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            letters = raw[first[rows][:, None] + np.arange(n)]
            symbols = self.inner[letters]
            symbols[:, -1] = self.last[letters[:, -1]]
            ranks = self.begin[0][letters[:, :-1], letters[:, 1:]]
            if n > 1:
                ranks[:, -1] = self.begin[1][letters[:, -2], letters[:, -1]]
            while len(rows):
                n = symbols.shape[1]
                at = ranks.argmin(axis=1) if n > 1 else np.zeros(len(rows), np.int64)
                least = ranks[np.arange(len(rows)), at] if n > 1 else np.full(len(rows), self.none)
                done = least == self.none
                if done.any():
                    ids.append(symbols[done].ravel())
                    names.append(np.stack([rows[done], np.full(done.sum(), n)]))
                    go = ~done
                    rows, symbols, ranks, at, least = rows[go], symbols[go], ranks[go], at[go], least[go]
                    if not len(rows):
                        break
                symbols[np.arange(len(rows)), at] = self.merged[least]
                stay = np.arange(n - 1)
                symbols = np.take_along_axis(symbols, stay + (stay > at[:, None]), 1)
                stay = stay[:-1]
                ranks = np.take_along_axis(ranks, stay + (stay >= at[:, None]), 1)
                for change in (at - 1, at):  # the pairs that the merged symbol is in now
                    some = np.flatnonzero((change >= 0) & (change < n - 2))
                    c = change[some]
                    ranks[some, c] = self._ranks(symbols[some, c], symbols[some, c + 1])
        return np.concatenate(ids), np.concatenate(names, axis=1)


class WordEncoder:
    """Ids of a text, put together from those of its stretches between ASCII white space.

    The tokenizer's pattern never reaches over white space and its normalisation composes nothing with it, so
    stretches are independent, and each different one of some texts is encoded once. Latin letters, alone or before
    signs, are merged here; all other pieces are the library's, and a bounded number of them is remembered.
    """

    def __init__(self, tokenizer_file: str, remember: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.merges = Merges(json.loads(self.tokenizer.to_str())["model"])
        self.remember, self.parts = remember, {}

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id after it, and where each text's begin and end. A null text has none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids, sizes = self._table(words.dictionary)
        start = np.cumsum(sizes) - sizes
        each = words.indices.to_numpy()
        borders = split.offsets.to_numpy()
        borders = borders - borders[0]
        del split, words
        if end_id is not None:
            each = np.insert(each, borders[1:], len(sizes))
            ids, start, sizes = np.append(ids, self.dtype.type(end_id)), np.append(start, len(ids)), np.append(sizes, 1)
            borders = borders + np.arange(len(borders))
        kind = np.int32 if len(ids) < 1 << 30 else np.int64
        size = sizes.astype(kind)[each]
        ends = np.append(0, np.cumsum(size, dtype=np.int64))[borders]
        return ids[_spread(start.astype(kind)[each], size)], ends

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different stretches one after another, and how many each has."""
        _, offsets, data = words.buffers()
        first = np.frombuffer(offsets, np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
        filled = np.flatnonzero(np.diff(first))
        raw, size, first = np.frombuffer(data or b"", np.uint8, int(first[-1])), np.diff(first)[filled], first[:-1][filled]
        total = np.zeros(len(words), np.int64)
        if not len(filled):
            return np.zeros(0, self.dtype), total
        letter = _LETTERS[raw]
        head = np.minimum.reduceat(np.where(letter, len(raw), np.arange(len(raw))), first) - first
        head = np.minimum(head, size)
        plain = (head > 0) & (head <= Merges.LONGEST) & (size - head <= 4)
        plain &= (np.add.reduceat(letter, first, dtype=np.int64) == head) & (np.add.reduceat(letter | _SIGNS[raw], first, dtype=np.int64) == size)
        known, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        # up to four signs after the letters, as one number
        rest, tail = (size - head)[known], np.zeros(len(known), np.uint32)
        for k in range(4):
            some = rest > k
            tail[some] |= raw[(first + head)[known[some]] + k].astype(np.uint32) << np.uint32(8 * k)
        kinds, tail = np.unique(tail, return_inverse=True)
        signs = [int(k).to_bytes(4, "little").rstrip(b"\0").decode() for k in kinds]
        several = [self._divide(w) for w in words.take(pa.array(filled[others])).to_pylist()]
        parts = self._parts({p for ps in several for p in ps} | set(signs))

        ids, (which, sizes) = self.merges.encode(_LOWERED[raw], first[known], head[known])
        own = np.zeros(len(known), np.int64)
        own[which] = sizes
        after = np.array([len(parts[e]) for e in signs], np.int64)
        total[filled[known]] = own + after[tail]
        found = [parts[p] for ps in several for p in ps]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        pieces = np.fromiter(map(len, several), np.int64, len(several))
        if len(several):
            total[filled[others]] = np.add.reduceat(counts, np.cumsum(pieces) - pieces)
        start = np.cumsum(total) - total
        flat = np.empty(int(total.sum()), self.dtype)
        flat[_spread(start[filled[known]][which], sizes)] = ids
        ends = np.fromiter(chain.from_iterable(parts[e] for e in signs), self.dtype, int(after.sum()))
        flat[_spread(start[filled[known]] + own, after[tail])] = ends[_spread((np.cumsum(after) - after)[tail], after[tail])]
        flat[_spread(start[filled[others]], total[filled[others]])] = np.fromiter(chain.from_iterable(found), self.dtype, int(counts.sum()))
        return flat, total

    def _parts(self, wanted: set[str]) -> dict[str, list[int]]:
        """The library's ids of pieces."""
        if len(self.parts) + len(wanted) > self.remember:  # only a memory of work done
            self.parts = {}
        need = [p for p in wanted if p not in self.parts]
        for i in range(0, len(need), 20_000):
            some = need[i : i + 20_000]
            self.parts.update(zip(some, [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)], strict=True))
        return self.parts

    @staticmethod
    def _divide(stretch: str) -> list[str]:
        """The tokenizer's own pieces of a stretch of Latin letters, digits and marks; any other stretch is left whole."""
        if _LATIN.fullmatch(stretch) and "<|" not in stretch:
            return _PIECE.findall(stretch.lower()) or [stretch]
        return [stretch]

    @property
    def dtype(self):
        return np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of stretches, one after another."""
    end = np.cumsum(size)
    last = int(end[-1]) if len(end) else 0
    kind = np.int32 if last < 1 << 30 and (not len(start) or start.max() < 1 << 30) else np.int64
    return np.repeat((start - end + size).astype(kind), size) + np.arange(last, dtype=kind)


_ENCODERS: dict[str, WordEncoder] = {}
_STEP = 16 << 20  # bytes of text encoded at a time, beside one text
_TOKENS = {"doc_id": pa.int64(), "kind": pa.int32(), "ids": pa.binary()}


def _steps(texts: pa.Array) -> list[int]:
    """Borders of runs of texts of about ``_STEP`` bytes."""
    if not len(texts):
        return [0]
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.searchsorted(sizes, np.arange(_STEP, int(sizes[-1]), _STEP)) + 1
    return sorted({0, *cuts.tolist(), len(texts)})


def counted(ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of documents' ids that lie one after another; ``ends`` has their borders."""
    n = len(ends) - 1
    kind = np.uint32 if n * vocabulary < 1 << 32 else np.uint64
    key = np.repeat(np.arange(n, dtype=kind) * kind(vocabulary), np.diff(ends)) + ids
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    return (key[first] // kind(vocabulary)).astype(np.int64), (key[first] % kind(vocabulary)).astype(np.int64), times


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """Rows of kind 0: ``doc_id`` and its packed ids with the end id; kind 1: document frequencies of some of them."""

    def run(batches):
        encoder = _ENCODERS.get(tokenizer_file) or _ENCODERS.setdefault(tokenizer_file, WordEncoder(tokenizer_file))
        df = np.zeros(encoder.vocabulary, np.int64)
        seen, width = False, encoder.dtype.itemsize
        for batch in batches:
            borders = _steps(batch.column(1))
            for a, z in zip(borders, borders[1:], strict=False):
                ids, ends = encoder.encode(batch.column(1).slice(a, z - a), end_id)
                df += np.bincount(counted(ids, ends, encoder.vocabulary)[1], minlength=encoder.vocabulary)
                seen = True
                data = pa.Array.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer((ends * width).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).cast(pa.int64()), pa.array(np.zeros(z - a, np.int32)), data.cast(pa.binary())], list(_TOKENS))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([1], pa.int32()), pa.array([df.tobytes()], pa.binary())], list(_TOKENS))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, kind int, ids binary")


def frequencies(tokens: DataFrame, vocabulary: int, width: int) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id, number of documents, mean length; over all documents."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.frombuffer(data, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    found = tokens.where("kind = 1").select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    df = np.zeros(vocabulary, np.int64)  # at most one row per id of the vocabulary
    for term, n in found:
        df[term] = n
    n, mean = tokens.where("kind = 0").agg(F.count("*"), F.avg(F.octet_length("ids") / width)).first()
    return df, n, mean or 1.0


class Index:
    """BM25 inverted index over a block of documents. Terms that many of them have also lie as rows of a table."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n, sizes = len(docs), np.array([len(d) for d in docs], np.int64)
        doc, term, tf = counted(np.concatenate(docs), np.append(0, np.cumsum(sizes)), len(idf))
        norm = K1 * (1 - B + B * sizes / mean)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.n, self.terms, self.border = n, term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        df = np.diff(self.first)
        common = np.flatnonzero(df > max(16, n // 8))
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), n), np.float32)
        at = self.row[term] >= 0
        self.table[self.row[term[at]], doc[at]] = weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """The score of each document of the block for all terms of this one."""
        terms = self.terms[self.border[seed] : self.border[seed + 1]]
        row = self.row[terms]
        score = self.table[row[row >= 0]].sum(axis=0, dtype=np.float64)
        rare = terms[row < 0]
        size = self.first[rare + 1] - self.first[rare]
        end = np.cumsum(size)
        if len(end) and end[-1]:
            at = np.repeat(self.first[rare] - end + size, size) + np.arange(end[-1])
            score += np.bincount(self.doc[at], self.weight[at], self.n)
        return score


class Packer:
    """Fills windows; ``full`` takes each finished sequence's pieces: (document, start, length)."""

    def __init__(self, idf: np.ndarray, mean: float, window: int = WINDOW):
        self.idf, self.mean, self.window = idf, mean, window
        self.pieces: list[tuple] = []
        self.room = window

    def _put(self, doc, start: int, size: int):
        """Place a stretch of a document; yields the sequences it completes."""
        while size:
            n = min(size, self.room)
            self.pieces.append((doc, start, n))
            start, size, self.room = start + n, size - n, self.room - n
            if not self.room:
                yield self.pieces
                self.pieces, self.room = [], self.window

    def block(self, docs: list[tuple[int, np.ndarray]]):
        """Pack all documents of a block; yields complete sequences."""
        index = Index([ids for _, ids in docs], self.idf, self.mean)
        used = np.zeros(len(docs), bool)
        seed = 0
        while True:
            while seed < len(docs) and used[seed]:
                seed += 1
            if seed == len(docs):
                return
            used[seed] = True
            opened = yield from self._fill(docs[seed])
            current = seed
            while opened:  # the sequence that the seed lies in last still has room
                last = None
                left = np.flatnonzero(~used)
                for near in left[np.argsort(-index.scores(current)[left], kind="stable")].tolist():
                    used[near] = True
                    before = self.room
                    yield from self._fill(docs[near])
                    if len(docs[near][1]) >= before:
                        last = near
                        break
                opened = last is not None and self.room < self.window
                current = last

    def _fill(self, doc):
        yield from self._put(doc, 0, len(doc[1]))
        return self.room < self.window

    def rest(self):
        """The open sequence as sequences of falling powers of two."""
        pieces, left = self.pieces[::-1], self.window - self.room
        self.pieces, self.room = [], self.window
        while left:
            size = 1 << left.bit_length() - 1
            left -= size
            out = []
            while size:
                doc, start, n = pieces.pop()
                take = min(n, size)
                out.append((doc, start, take))
                size -= take
                if take < n:
                    pieces.append((doc, start + take, n - take))
            yield out


_PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def dealt(tokens: DataFrame, shards: int, df: np.ndarray, idf, dtype) -> DataFrame:
    """``doc_id, ids`` in shards of like documents, near copies next to each other."""
    shared = tokens.sparkSession.sparkContext.broadcast(df > 1)

    def run(batches):
        for b in batches:
            packed = b.column(1).cast(pa.large_binary())
            _, offsets, data = packed.buffers()
            ends = np.frombuffer(offsets, np.int64, len(packed) + 1, 8 * packed.offset) // dtype.itemsize
            ids = np.frombuffer(data, dtype)[ends[0] : ends[-1]] if len(packed) else np.zeros(0, dtype)
            doc, terms, tf = counted(ids, ends - ends[0], len(idf.value))
            weight = np.where(shared.value[terms], idf.value[terms] * tf / (tf + K1), -1.0)
            best = []
            for _ in range(2 * bool(len(packed))):  # the heaviest, then the next; a lone term is both
                most = np.maximum.reduceat(weight, np.searchsorted(doc, np.arange(len(packed))))
                at = np.flatnonzero(weight == most[doc])
                at = at[np.append(True, doc[at][1:] != doc[at][:-1])]
                best.append(terms[at])
                weight[at] = -2.0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in best or [[], []])], ["doc_id", "ids", "first", "second"])

    keyed = tokens.where("kind = 0").select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, first long, second long")
    keys = ["first", "second", "doc_id"]
    return keyed.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")


def pack_documents(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, block_docs: int | None = None, block_ids: int = 4_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``sequence_id`` has the shard in its upper bits. with_ids adds the pieces' ids."""
    encoder = WordEncoder(tokenizer_file)
    dtype = encoder.dtype
    tokens = materialize(encode_documents(docs, tokenizer_file, end_id), "tokens")
    df, n_docs, mean = frequencies(tokens, encoder.vocabulary, dtype.itemsize)
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)))  # of the vocabulary's size
    schema = _PIECES | ({"ids": pa.list_(pa.int64())} if with_ids else {})

    def run(batches):
        from pyspark import TaskContext

        packer, shard, number = Packer(idf.value, mean, window), TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []

        def note(pieces):
            nonlocal number
            offset = 0
            for (doc_id, ids), start, n in pieces:
                part = ids[start : start + n]
                rows.append((doc_id, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), shard + number, offset, *([part.astype(np.int64)] if with_ids else ())))
                offset += n
            number += 1

        def out():
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))
            rows.clear()
            return batch

        block, size = [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.append((doc_id, np.frombuffer(data, dtype)))
                size += len(block[-1][1])
                if len(block) == block_docs or size >= block_ids:
                    for pieces in packer.block(block):
                        note(pieces)
                    block, size = [], 0
                    yield out()
        if block:
            for pieces in packer.block(block):
                note(pieces)
        for pieces in packer.rest():
            note(pieces)
        yield out()

    sql = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    shards = max(1, -(-int(2 * n_docs * mean) // block_ids))
    return dealt(tokens, shards, df, idf, dtype).mapInArrow(run, sql)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
