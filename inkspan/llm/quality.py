"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network with calibrated probabilities.

Every word of the corpus has a sparse random index vector (``NONZERO`` signs in ``DIM`` places, derived from its
bucket). A word's vector is the sum of the index vectors of its neighbours over all texts: counts over the whole corpus
that add up exactly, in any order. A document is the mean of its words' vectors and of their squares. A network of two
layers (numpy, fixed seed) learns quality from at most ``TRAIN_ROWS`` labelled rows; on a held-back fifth of these a
temperature is fitted that calibrates its probabilities.

Words are runs of letters (lower-cased), of digits and of symbols, with marks for capitals and for a word that repeats
the one before it; they are hashed into ``BUCKETS`` buckets, so the table of vectors has BUCKETS * DIM cells at any
size of the corpus. Texts are never shuffled, and each is read whole.

Null and empty texts have a zero vector and get the network's answer to it. Without labels of both kinds all scores are
1, so that a filter keeps everything. Repeated rows score alike. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import crc32_mod, labelled_sample, narrow, text_slices, words_of

BUCKETS, DIM, NONZERO, WINDOW = 8192, 32, 2, 2
#: Most labelled rows to learn from, hidden units, passes and step of the optimiser; documents under THRESHOLD go.
TRAIN_ROWS, HIDDEN, EPOCHS, STEP, THRESHOLD = 20_000, 32, 60, 3e-3, 0.3

PIECES = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def bucket(piece: str) -> int:
    return xxhash.xxh32_intdigest(piece) % BUCKETS


REPEATED, UPPER, CAPITAL = (bucket(f"<{x}>") for x in ("repeated", "upper", "capital"))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    draw = np.random.default_rng(7)
    return draw.integers(0, DIM, (BUCKETS, NONZERO)), draw.choice((-1, 1), (BUCKETS, NONZERO))


def pieces(word: str) -> list[int]:
    out = []
    for p in PIECES.findall(word):
        if p[0].isalpha():
            if p[0].isupper():
                out.append(UPPER if len(p) > 1 and p.isupper() else CAPITAL)
            p = p.lower()
        out.append(bucket(p[:4] if not p[0].isalnum() else p))
    return out


def sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each piece of the texts, in order."""
    rows, at, words = words_of(texts)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = [pieces(w) for w in words]
    # A word that repeats the one before it is followed by a mark.
    again = np.concatenate(([False], (at[1:] == at[:-1]) & (rows[1:] == rows[:-1])))
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = np.fromiter((p for c in cut for p in c), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    n = sizes[at] + again
    total = int(n.sum())
    start = np.cumsum(n) - n
    inside = np.arange(total) - np.repeat(start, n)
    own = np.repeat(sizes[at], n)
    codes = np.where(inside < own, flat[np.minimum(np.repeat(first[at], n) + inside, max(0, len(flat) - 1))] if len(flat) else REPEATED, REPEATED)
    return np.repeat(rows, n), codes


def contexts(texts: pa.Array, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of neighbours' index vectors for each bucket, flat."""
    rows, codes = sequence(texts)
    total = np.zeros(BUCKETS * DIM)
    for k in range(1, WINDOW + 1):
        same = rows[k:] == rows[:-k]
        a, b = codes[:-k][same], codes[k:][same]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                total += np.bincount(x * DIM + places[y, j], signs[y, j], minlength=BUCKETS * DIM)
    return total


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets from all texts of ``docs``: BUCKETS rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIM)
        for batch in text_slices(batches):
            total += contexts(batch.column("text"), places, signs)
        table = total.reshape(BUCKETS, DIM).astype(np.int64)
        at = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(table[at, d]) for d in range(DIM))], ["at", *(f"d{d}" for d in range(DIM))])

    names = [f"d{d}" for d in range(DIM)]
    sums = narrow(docs).select("text").mapInArrow(run, "at int, " + ", ".join(f"{n} long" for n in names)).groupBy("at").agg(*(F.sum(n).alias(n) for n in names))
    table = np.zeros((BUCKETS, DIM), np.float64)
    for r in sums.collect():
        table[r["at"]] = r[1:]
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """Mean of the words' vectors and of their squares, one row for each text."""
    rows, codes = sequence(batch.column("text"))
    n = batch.num_rows
    counts = np.bincount(rows * BUCKETS + codes, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
    return np.concatenate((counts @ vectors, counts @ (vectors * vectors)), 1).astype(np.float64)


class Network:
    """Two layers: tanh, then a logit. Inputs are standardised; the logit is divided by a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        order = np.lexsort((*x.T[:4], y))
        x, y = x[order], y[order]
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.sd
        draw = np.random.default_rng(11)
        back = draw.permutation(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
        w = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        a, b = x[~back], y[~back]
        for _ in range(EPOCHS):
            mixed = draw.permutation(len(a))
            for k in range(0, len(a), 256):
                xs, ys = a[mixed[k : k + 256]], b[mixed[k : k + 256]]
                h = np.tanh(xs @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - ys) / len(xs)
                g = np.outer(d, w[2]) * (1 - h * h)
                t += 1
                for i, grad in enumerate((xs.T @ g + 1e-4 * w[0], g.sum(0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    w[i] = w[i] - STEP * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if back.any():
            logits = self.logits((x[back] * self.sd) + self.mean)
            tried = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, np.where(y[back] > 0, -logits, logits) / s)) for s in tried]
            self.temperature = float(tried[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.sd, -12, 12)
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors of the corpus, and the network (None without labels of both kinds)."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = pooled(batch, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    found = labelled_sample(docs, labels, "quality", rows).mapInArrow(gather, "x array<double>, label int").toArrow()
    y = found.column("label").to_numpy() > 0
    if not len(y) or y.all() or not y.any():
        return vectors, None
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    return vectors, Network(x, y.astype(float))


def _probability(batch: pa.RecordBatch, model: tuple[np.ndarray, Network | None]) -> np.ndarray:
    return np.ones(batch.num_rows) if model[1] is None else model[1].probability(pooled(batch, model[0]))


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_probability(batch, shared.value))], ["doc_id", "score"])

    out = narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns; learns from ``docs`` and labels."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = [_probability(s, shared.value) for s in text_slices(iter([batch.select([at])]))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= threshold))

    return narrow(docs).mapInArrow(run, docs.schema)
