"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A text is encoded left to right. At each position the longest matching piece (found by an
Aho-Corasick automaton) is tried first, then its shorter prefixes. A piece may follow another
only if merging the two pieces' characters again gives just these two; a position from which
no piece fits is marked in a bitfield and never tried again. Every neighbouring pair of the
result is thus stable under merging, and only one such sequence exists: the one that merging
by score gives.

Cases: a null text is an empty text (no ids); characters outside the vocabulary become byte
pieces; a text of any length is worked on whole; repeated rows give repeated results; only the
id and the text are read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"


class Pieces:
    """The pieces of a merge-type model, with identity normalisation and a dummy prefix."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        """byte_ids: the id of each byte's piece, or an empty list. Other special ids have the piece ''."""
        import ahocorasick

        self.score = {p: s for p, s in zip(pieces, scores, strict=True) if p}
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        self.pieces, self.byte_ids = pieces, byte_ids
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.byte_set = frozenset(byte_ids)
        self.longest_piece = max(map(len, self.ids))
        chars = [p for p in self.ids if len(p) == 1]
        longer = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-self.score[p], self.ids[p]))
        self.rank = {p: r for r, p in enumerate(chars + longer)}  # characters first, then as merging makes them
        self.halves: dict[str, tuple[str, str]] = {}  # the last merge that makes a piece
        for p in longer:
            parts = self.merge(p, last=True)
            if len(parts) == 2:
                self.halves[p] = (parts[0], parts[1])
        reachable = chars + list(self.halves)
        self.chars = frozenset(chars)
        self.bigrams = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        fit = set(reachable)
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in fit), None) for p in reachable}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.spaced: dict[str, tuple[str, str]] = {}

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        return cls(*model_tables(model_file))

    def merge(self, text: str, last: bool = False) -> list[str]:
        """Merge characters by score, leftmost first among equals: the definition, for short strings.

        last: stop before the merge that would leave a single piece.
        """
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0 or last and len(parts) == 2:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        if len(self.pairs) >= 500_000:
            self.pairs.clear()
        if SPACE in right:  # runs of spaces have pieces of equal score: merge from the characters
            known = self.merge(left + right) == [left, right]
        else:
            known = self._stays_apart(left, right)
        self.pairs[left, right] = known
        return known

    def _stays_apart(self, left: str, right: str) -> bool:
        """Whether re-merging both pieces' characters never merges across their border.

        Goes back in time: undoes the later of the two pieces' last merges, and asks whether
        what then touches the border would have merged before what was undone.
        """
        rank, halves = self.rank, self.halves
        limit = len(rank) + 1
        while True:
            made = rank.get(left + right)
            if made is not None and made < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b and left in halves:
                limit = a
                left = halves[left][1]
            elif right in halves:
                limit = b + 1
                right = halves[right][0]
            else:
                return True

    def backtrack(self, word: str) -> list[str]:
        """The pieces of a string whose characters are all in the vocabulary."""
        if word in self.shorter:  # the longest match is the whole word
            return [word]
        n, failed = len(word), 0
        longest = [0] * n
        for end, size in self.automaton.iter(word):
            longest[end - size + 1] = size
        out: list[str] = []
        pairs = self.pairs
        pos, piece = 0, word[: longest[0]]
        while pos < n:
            if piece:
                end = pos + len(piece)
                fits = not failed >> end & 1
                if fits and out:
                    fits = pairs.get((out[-1], piece))
                    if fits is None:
                        fits = self.compatible(out[-1], piece)
                if fits:
                    out.append(piece)
                    pos = end
                    piece = word[pos : pos + longest[pos]] if pos < n else ""
                else:
                    piece = self.shorter[piece]
            else:
                failed |= 1 << pos
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                piece = out.pop()
                pos -= len(piece)
                piece = self.shorter[piece]
        return out

    def word(self, word: str) -> list[int]:
        """Ids of a stretch that no piece leaves. Characters without a piece split it."""
        known = self.ids
        if self.chars.issuperset(word):
            return [known[p] for p in self.backtrack(word)]
        out: list[int] = []
        start = 0
        for i, c in enumerate(word):
            if c not in known:
                out += [known[p] for p in self.backtrack(word[start:i])] if i > start else []
                out += [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [0]
                start = i + 1
        if start < len(word):
            out += [known[p] for p in self.backtrack(word[start:])]
        return out

    def _stretch(self, word: str) -> tuple[str, str]:
        """Ids (decimal, joined by commas) and decoded text of one space and ``word``, which has none.

        No piece has a space after another character, so none crosses from one such stretch to the next.
        """
        parts = word.split("\n")
        if len(parts) > 1 and "\n" not in self.ids:  # a line end is bytes, which merge with nothing
            head, tail = self.spaced_word(parts[0]), []
            for p in parts[1:]:
                tail += self.word("\n" + p)
        elif len(word) > 1 and not word[-1].isalnum() and word[-2:] not in self.bigrams:  # no piece crosses there
            head, tail = self.spaced_word(word[:-1]), self.word(word[-1])
        else:
            ids = self.word(SPACE + word)
            return ",".join([str(i) for i in ids]), self.joined(ids)
        return head[0] + "," + ",".join([str(i) for i in tail]), head[1] + self.joined(tail)

    def spaced_word(self, word: str) -> tuple[str, str]:
        found = self.spaced.get(word)
        if found is None:
            found = self._stretch(word)
            if len(self.spaced) >= 600_000:  # only a memory of work done: without it, a word is encoded again
                self.spaced.clear()
            if len(word) <= 40:
                self.spaced[word] = found
        return found

    def encode_joined(self, text: str) -> tuple[str, str]:
        """Ids of a whole text, joined by commas, and what they decode to."""
        if not text:
            return "", ""
        words = text.replace(SPACE, " ").split(" ")
        found, run, get = [], "", self.spaced.get
        for w in words:
            if run:
                if w:
                    ids = self.word(run + SPACE + w)
                    found.append((",".join([str(i) for i in ids]), self.joined(ids)))
                    run = ""
                else:
                    run += SPACE
            elif w:
                x = get(w)
                found.append(self.spaced_word(w) if x is None else x)
            else:
                run = SPACE
        if run:
            ids = self.word(run)
            found.append((",".join([str(i) for i in ids]), self.joined(ids)))
        return ",".join([x[0] for x in found]), "".join([x[1] for x in found])[1:]

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)[0]
        return [int(i) for i in joined.split(",")] if joined else []

    def joined(self, ids: list[int]) -> str:
        if self.byte_set.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.joined(ids)
        return text[1:] if text[:1] == " " else text


def model_tables(model_file: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and byte ids read from a model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.vocab_size()
    plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
    byte_ids = [i for i in range(n) if m.is_byte(i)]
    return [m.id_to_piece(i) if plain[i] else "" for i in range(n)], [m.get_score(i) for i in range(n)], byte_ids


_LOADED: dict[str, Pieces] = {}  # by model file, for the Python worker's later tasks


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids`` (joined by commas) and ``decoded`` of each whole text."""
    return _map(docs, model_file, "doc_id long, ids string, decoded string", lambda ids, decoded: (ids, decoded), [pa.string(), pa.string()])


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text."""

    def digest(ids: str, decoded: str) -> tuple:
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _map(docs, model_file, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest, [pa.int64(), pa.string(), pa.string()])


def _map(docs: DataFrame, model_file: str, schema: str, what, types: list[pa.DataType]) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(model_tables(model_file))  # bounded by the vocabulary
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        pieces = _LOADED.get(model_file)
        if pieces is None:
            pieces = _LOADED[model_file] = Pieces(*tables.value)
        for batch in batches:
            rows = [what(*pieces.encode_joined(t or "")) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
