"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are cut into segments that the network reads in both directions, many segments side by side.  Every
position gets language probabilities from the two hidden states; a document's probabilities are the mean over all of
its positions.  Training is backpropagation through time with Adam on windows of a bounded sample.

The gates use x / (1 + |x|), which costs a few plain operations instead of an exponential.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Training reads at most so many documents of a language, and so many windows of each.
SAMPLE = 400
WINDOWS = 3
WINDOW_CHARS = 120
HIDDEN = 8
SEGMENT = 128
_LETTER = re.compile(r"[^\W\d_]")
_BATCH = 4096


def _byte_classes() -> np.ndarray:
    """A-Z are read as a-z, digits as one class; 0 stays for padding."""
    table = np.arange(256)
    table[65:91] = table[97:123]
    table[48:58] = 48
    table[0] = 32
    return table


CLASSES = _byte_classes()


class Direction:
    """One direction's weights: per byte, and from the state.  Arrays hold a row per unit and a column per segment."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.byte = (0.3 * rng.standard_normal((3 * hidden, 256))).astype(np.float32)
        self.state = (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)

    def forward(self, x: np.ndarray, keep: np.ndarray, trace: list | None = None) -> Iterator[np.ndarray]:
        """State (hidden, segments) after each step of ``x`` (steps, segments); padding leaves it at 0."""
        H = self.state.shape[1]
        h = np.zeros((H, x.shape[1]), np.float32)
        size = np.empty((2 * H, x.shape[1]), np.float32)
        for t in range(x.shape[0]):
            a = self.state @ h
            pre = np.take(self.byte, x[t], axis=1)
            g = pre[:2 * H]
            g += a[:2 * H]
            np.abs(g, out=size)
            size += 1
            g /= size
            g *= 0.5
            g += 0.5
            c = g[H:] * a[2 * H:]
            c += pre[2 * H:]
            np.abs(c, out=size[:H])
            size[:H] += 1
            c /= size[:H]
            if trace is not None:
                trace.append((h, a[2 * H:], g, c.copy()))
            c -= h
            c *= g[:H]
            c += h
            c *= keep[t]
            h = c
            yield h

    def backward(self, x: np.ndarray, keep: np.ndarray, trace: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the weights from the gradients of all states (steps, hidden, segments)."""
        H = self.state.shape[1]
        d_byte, d_state = np.zeros((256, 3 * H), np.float32), np.zeros_like(self.state)
        dh = np.zeros_like(d_out[0])
        for t in range(x.shape[0] - 1, -1, -1):
            h, a, g, c = trace[t]
            dh = (dh + d_out[t]) * keep[t]
            z, r = g[:H], g[H:]
            dc = dh * z * np.square(1 - np.abs(c))
            dg = np.concatenate([dh * (c - h), dc * a]) * 0.5 * np.square(1 - np.abs(2 * g - 1))
            da = np.concatenate([dg, dc * r])
            np.add.at(d_byte, x[t], np.concatenate([dg, dc]).T)
            d_state += da @ h.T
            dh = dh * (1 - z) + self.state.T @ da
        return d_byte.T, d_state


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.right, self.left = Direction(rng, hidden), Direction(rng, hidden)
        self.out = np.zeros((len(languages), 2 * hidden), np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def positions(self, x: np.ndarray, traces: tuple[list, list] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Language probabilities (languages, segments) at each position of ``x`` (steps, segments), and both states."""
        H = self.out.shape[1] // 2
        keep = (x > 0).astype(np.float32)
        back = list(self.left.forward(x[::-1], keep[::-1], traces and traces[1]))[::-1]
        for there, here in zip(self.right.forward(x, keep, traces and traces[0]), back):
            z = self.out[:, :H] @ there
            z += self.out[:, H:] @ here
            z += self.bias
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            yield z, (there, here)

    def labels(self, text: str) -> list[str]:
        """Language of every byte of one text."""
        out: list[str] = []
        data = CLASSES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        for at in range(0, data.size, SEGMENT):
            out += [self.languages[int(p.argmax())] for p, _ in self.positions(data[at:at + SEGMENT, None])]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 160, rows: int = 192, rate: float = 0.02, seed: int = 7) -> None:
        """Adam on random columns of ``x`` (steps, windows) with languages ``y``; every position is a training example."""
        rng = np.random.default_rng(seed)
        weights = [self.right.byte, self.right.state, self.left.byte, self.left.state, self.out, self.bias]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        share = np.bincount(y, minlength=len(self.languages)).astype(np.float64)
        chance = (1 / share[y]) / (1 / share[y]).sum()  # languages in equal parts
        for step in range(1, rounds + 1):
            pick = rng.choice(y.size, min(rows, y.size), p=chance)
            xb, yb = x[:, pick], y[pick]
            keep = (xb > 0).astype(np.float32)
            traces: tuple[list, list] = ([], [])
            p, there, here = (np.stack(v) for v in zip(*((z, a, b) for z, (a, b) in self.positions(xb, traces))))
            p[:, yb, np.arange(yb.size)] -= 1
            p *= keep[:, None] / max(1.0, float(keep.sum()))
            H = self.out.shape[1] // 2
            grads = [*self.right.backward(xb, keep, traces[0], np.einsum("lh,tlb->thb", self.out[:, :H], p)),
                     *self.left.backward(xb[::-1], keep[::-1], traces[1], np.einsum("lh,tlb->thb", self.out[:, H:], p)[::-1]),
                     np.concatenate([np.einsum("tlb,thb->lh", p, there), np.einsum("tlb,thb->lh", p, here)], axis=1),
                     p.sum(axis=(0, 2))[:, None]]
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for w, g, (m, v) in zip(weights, grads, moments):
                g = g / max(1.0, size)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean language probabilities of each text over all its positions."""
        total = np.zeros((len(texts), len(self.languages)))
        owner, lines = [], []

        def flush():
            x = np.zeros((len(lines), SEGMENT), np.int64)
            for row, line in zip(x, lines):
                row[:line.size] = line
            x = np.ascontiguousarray(x.T)
            keep = (x > 0).astype(np.float32)
            summed = np.zeros((len(self.languages), x.shape[1]), np.float32)
            for p, k in zip(self.positions(x), keep):
                p[0][...] *= k
                summed += p[0]
            np.add.at(total, owner, summed.T)
            owner.clear()
            lines.clear()

        for k, text in enumerate(texts):
            data = CLASSES[np.frombuffer(text, np.uint8)]
            for at in range(0, data.size, SEGMENT):
                owner.append(k)
                lines.append(data[at:at + SEGMENT])
                if len(lines) == _BATCH:
                    flush()
        if lines:
            flush()
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, usable=lambda doc_id: F.lit(True), per_language: int = SAMPLE) -> Network | None:
    """Fit on windows of at most ``per_language`` documents of each language; None without a labelled text.

    ``usable`` says from the doc_id which rows may be read.  Windows start at places that the hash of the doc_id picks
    in the whole text.  A language is learned when it has a usable document.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & usable(F.col("doc_id")))
    place = lambda k: (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW_CHARS, F.lit(1))) + 1).cast("int")
    windows = known.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id",
                           *(F.substring(F.col("text"), place(k), F.lit(WINDOW_CHARS)).alias(f"w{k}") for k in range(WINDOWS)))
    picked = (windows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= per_language)
              .select("lang", "h", "doc_id", *(f"w{k}" for k in range(WINDOWS))).orderBy("lang", "h", "doc_id").collect())
    rows = [(r.lang, w) for r in picked for w in r[3:] if _LETTER.search(w)]
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    x = np.zeros((SEGMENT, len(rows)), np.int64)
    for k, (_, w) in enumerate(rows):
        data = CLASSES[np.frombuffer(w.encode("utf-8", "surrogatepass")[:SEGMENT], np.uint8)]
        x[:data.size, k] = data
    net = Network(languages)
    if len(languages) > 1:
        net.fit(x[:64], np.array([languages.index(lang) for lang, _ in rows]))
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text).

    ``lang_pred`` is the language with the largest mean probability, ``score`` that probability; texts that are null,
    empty or without a letter, and all texts without a network, get ``und`` and 0.  Rows with null or repeated doc_ids
    are kept; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            read = [k for k, t in enumerate(texts) if net is not None and _LETTER.search(t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if read:
                p = net.documents([texts[k].encode("utf-8", "surrogatepass") for k in read])
                for k, row in zip(read, p):
                    lang[k], score[k] = net.languages[int(row.argmax())], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, lang_pred string, score double")
