"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows, one state forward and one backward, labels
every position, and a document's probabilities are the mean over its letters' positions in the
whole text. It is trained in numpy by backpropagation through time on a bounded, documented
sample: at most ``per_label`` labelled documents a label, ``pieces`` pieces of ``piece`` characters each from all parts of
each whole text. Prediction runs on every byte of every text, in batches of windows of bounded memory.

Cases: a null text or one without a letter is ``und`` with score 0; without any labelled text all
are ``und``; with a single label all others have it, with score 1; only rows with a label and a text are learned
from; ids may repeat or be null (null ids are not held out); an empty table gives an empty result;
columns other than doc_id, text and lang are not read, so they cannot clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import returning

UNKNOWN = "und"
PAD = 256
_ASCII_LETTER = re.compile("[A-Za-z]")
#: bytes whose positions count: ASCII letters and parts of longer characters
_COUNTS = np.zeros(257, bool)
_COUNTS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class ByteGru:
    """Parameters per direction d: in_d (257, 3H) holds each byte's input to update, reset and
    candidate; rec_d (H, 2H) and cand_d (H, H) act on the state; out_d (H, C); bias (C)."""

    def __init__(self, labels: list[str], hidden: int = 12, window: int = 64, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden, self.window = labels, hidden, window
        self.p = {"bias": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.p |= {
                f"in_{d}": rng.normal(0, 0.3, (257, 3 * hidden)), f"rec_{d}": rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)),
                f"cand_{d}": rng.normal(0, hidden**-0.5, (hidden, hidden)), f"out_{d}": rng.normal(0, hidden**-0.5, (hidden, len(labels))),
            }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pass(self, x: np.ndarray, d: str, keep: bool = False):
        """States of one direction for byte windows x (time, rows): yields (t, state, gates)."""
        h, p = self.hidden, self.p
        state = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            given = np.take(p[f"in_{d}"], x[t], axis=0)
            gates = state @ p[f"rec_{d}"]
            gates += given[:, : 2 * h]
            _sigmoid(gates)
            update, reset = gates[:, :h], gates[:, h:]
            cand = (reset * state) @ p[f"cand_{d}"]
            cand += given[:, 2 * h :]
            np.tanh(cand, out=cand)
            old = state
            state = old - cand
            state *= update
            state += cand
            yield t, state, (old, gates, cand) if keep else None

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((*x.shape, len(self.labels)), np.float32)
        for t, state, _ in self._pass(x, "f"):
            np.matmul(state, self.p["out_f"], out=out[t])
        for t, state, _ in self._pass(x, "b"):
            out[t] += state @ self.p["out_b"]
        out += self.p["bias"]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions that count, and its gradients through time."""
        h, p, g = self.hidden, self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: list(self._pass(x, d, keep=True)) for d in "fb"}
        out = np.zeros((*x.shape, len(self.labels)), np.float32)
        for d in "fb":
            for t, state, _ in runs[d]:
                out[t] += state @ p[f"out_{d}"]
        out += p["bias"]
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        counts = _COUNTS[x]
        n = max(1, int(counts.sum()))
        own = np.take_along_axis(out, np.broadcast_to(y[None, :, None], (*x.shape, 1)), axis=2)[..., 0]
        loss = float(-(np.log(own + 1e-9) * counts).sum() / n)
        delta = out
        np.put_along_axis(delta, np.broadcast_to(y[None, :, None], (*x.shape, 1)), own[..., None] - 1, axis=2)
        delta *= counts[..., None] / np.float32(n)
        g["bias"] = delta.sum(axis=(0, 1))
        for d in "fb":
            down = np.zeros((x.shape[1], h), np.float32)
            inputs = np.zeros((x.shape[0], x.shape[1], 3 * h), np.float32)
            for t, state, (old, gates, cand) in reversed(runs[d]):
                g[f"out_{d}"] += state.T @ delta[t]
                down = down + delta[t] @ p[f"out_{d}"].T
                update, reset = gates[:, :h], gates[:, h:]
                d_cand = down * (1 - update) * (1 - cand * cand)
                d_held = d_cand @ p[f"cand_{d}"].T
                d_gates = np.concatenate([down * (old - cand), d_held * old], axis=1) * gates * (1 - gates)
                g[f"cand_{d}"] += (reset * old).T @ d_cand
                g[f"rec_{d}"] += old.T @ d_gates
                inputs[t, :, : 2 * h], inputs[t, :, 2 * h :] = d_gates, d_cand
                down = down * update + d_held * reset + d_gates @ p[f"rec_{d}"].T
            np.add.at(g[f"in_{d}"], x.reshape(-1), inputs.reshape(-1, 3 * h))
        return loss, g

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam on windows (rows, time); returns the mean loss of each epoch."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, total = 0, epochs * max(1, -(-len(windows) // batch))
        for _ in range(epochs):
            order, seen = rng.permutation(len(windows)), []
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                loss, g = self.gradients(np.ascontiguousarray(windows[rows].T), y[rows])
                seen.append(loss)
                step += 1
                pace = rate * (1 - step / (total + 1))
                norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
                for k, w in g.items():
                    w = w * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * w
                    v[k] = 0.99 * v[k] + 0.01 * w * w
                    self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def windows(self, data: bytes) -> np.ndarray:
        """(rows, time) byte windows of a whole text; the last is padded."""
        a = np.frombuffer(data, np.uint8).astype(np.int16)
        return np.pad(a, (0, -len(a) % self.window), constant_values=PAD).reshape(-1, self.window)

    def predict(self, texts: list[bytes], rows: int = 2048) -> np.ndarray:
        """Pooled probabilities (texts, labels); zero where no position counts."""
        total = np.zeros((len(texts), len(self.labels)))
        held, owner, size = [], [], 0

        def flush():
            nonlocal size
            x, of = np.concatenate(held), np.repeat(owner, [len(w) for w in held])
            for i in range(0, len(x), rows):
                part = np.ascontiguousarray(x[i : i + rows].T)
                out = self.logits(part)
                out -= out.max(axis=2, keepdims=True)
                np.exp(out, out=out)
                out *= (_COUNTS[part] / out.sum(axis=2))[..., None]
                np.add.at(total, of[i : i + rows], out.sum(axis=0))
            held.clear(), owner.clear()
            size = 0

        for i, data in enumerate(texts):
            if data:
                held.append(self.windows(data))
                owner.append(i)
                size += len(held[-1])
                if size >= rows:
                    flush()
        if held:
            flush()
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


_HASHES = 1 << 40
MOST_LABELS = 2000  # as many outputs a network may have


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, per_label: int, pieces: int, piece: int) -> list[tuple[str, list[str]]]:
    """(label, pieces of its text) of at most ``per_label`` rows a label, the least by a hash of id and text.

    Rows far over that hash's quantile are left out before any are ranked, so a label that most rows have is no one task's work.
    The pieces are of ``piece`` characters each, one from each of ``pieces`` equal parts of the whole text.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(_HASHES)).alias("rank"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"language: more than {MOST_LABELS} labels")
    if not sizes:
        return []
    least = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, float(4 * per_label * _HASHES) / r["n"])))
    near = known.where(F.col("rank") <= least[F.col("lang")])
    by_hash = Window.partitionBy("lang").orderBy("rank", "doc_id", "text")
    chosen = near.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= per_label)
    room = F.greatest(F.length("text") - piece, F.lit(0))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.floor((i + F.pmod(F.xxhash64("rank", i), F.lit(1000)) / 1000) * room / pieces).cast("int") + 1)
    texts = F.array_distinct(F.transform(cuts, lambda c: F.struct(c.alias("c"), F.substring("text", c, F.lit(piece)).alias("t")))).alias("texts")
    rows = chosen.select("lang", "rank", "doc_id", texts).collect()  # at most per_label a label
    rows = sorted(rows, key=lambda r: (r.lang, r.rank, r.doc_id is None, r.doc_id))
    return [(r.lang, [t.t for t in r.texts]) for r in rows]


def train(docs: DataFrame, per_label: int = 400, pieces: int = 6, piece: int = 64, epochs: int = 6, hidden: int = 12) -> ByteGru | None:
    """A network fitted on the rows that are not held out; None without any labelled text."""
    sample = training_sample(docs, per_label, pieces, piece)
    labels = sorted({lang for lang, _ in sample})
    if not labels:
        return None
    net = ByteGru(labels, hidden)
    rows, y = [], []
    for lang, texts in sample:
        for text in texts:
            w = net.windows(text.encode("utf-8", "surrogatepass"))
            rows.append(w)
            y += [labels.index(lang)] * len(w)
    if len(labels) > 1:
        net.fit(np.concatenate(rows), np.array(y), epochs)
    return net


def predict(docs: DataFrame, net: ByteGru | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            clear = [model is not None and has_letter(t) for t in texts]
            if model is None:
                labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            else:
                p = model.predict([t.encode("utf-8", "surrogatepass") if c else b"" for t, c in zip(texts, clear, strict=True)])
                labels = [model.labels[i] if c else UNKNOWN for i, c in zip(p.argmax(axis=1).tolist(), clear, strict=True)]
                scores = np.where(clear, np.minimum(p.max(axis=1), 1.0), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(returning(run), "doc_id long, lang_pred string, score double")


def op6_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
