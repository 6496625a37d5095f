"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over chunks of `WIDTH` bytes that start every `HOP` bytes (so that they overlap and
cover the whole document), each filter's largest response over all chunks is kept, and a hidden layer combines the
responses into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bounded_rows, map_batches, resident, text_slices, utf8_parts

HOP, WIDTH, DIM, PAD = 8, 16, 8, 256


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all documents, each padded to whole hops and two at least, and the first block of each plus the end."""
    lengths = np.diff(offsets)
    n = np.maximum(2, -(-lengths // HOP))
    first = np.concatenate([[0], np.cumsum(n)])
    codes = np.full(int(first[-1]) * HOP, PAD, dtype=np.int16)
    shift = np.repeat(first[:-1] * HOP - offsets[:-1], lengths)
    codes[np.arange(len(data)) + shift] = data
    return codes, first


class ByteCnn:
    def __init__(self, filters: int = 32, hidden: int = 16, seed: int = 3):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (257, DIM)).astype(np.float32)
        self.embed[PAD] = 0
        self.conv = r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, filters)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.w1 = r.normal(0, filters**-0.5, (filters, hidden)).astype(np.float32)
        self.b1 = np.zeros(hidden, np.float32)
        self.w2 = r.normal(0, hidden**-0.5, hidden).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.constant: float | None = None

    NAMES = ("embed", "conv", "bias", "w1", "b1", "w2", "b2")

    def responses(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Filter responses of the chunk that starts at each block; those that would run into the next document are very low."""
        x = self.embed[codes].reshape(-1, HOP * DIM)
        half = HOP * DIM
        out = x @ self.conv[:half]
        out[:-1] += (x @ self.conv[half:])[1:]
        out[first[1:] - 1] = -1e30
        return out

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.maximum(pooled + self.bias, 0)
        h = np.maximum(z @ self.w1 + self.b1, 0)
        return z, h, 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2[0], -40, 40)))

    def score(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18) -> np.ndarray:
        """Probabilities of documents that lie one after another in data; about `most` bytes are held at a time, and long
        documents are read in stretches that overlap by a chunk, so their responses are those of the whole text."""
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        n, k = len(offsets) - 1, 0
        pooled = np.empty((n, len(self.bias)), np.float32)
        while k < n:
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, side="right")) - 1)
            a, b = int(offsets[k]), int(offsets[end])
            if end == k + 1 and b - a > most:
                starts = range(a, b - HOP, most)  # the last HOP bytes start no chunk of their own
                pooled[k] = np.max([self._pool(data[s : min(b, s + most + HOP)], np.array([0, min(b, s + most + HOP) - s])) for s in starts], axis=0)[0]
            else:
                pooled[k:end] = self._pool(data[a:b], offsets[k : end + 1] - a)
            k = end
        return self.head(pooled)[2].astype(np.float64)

    def _pool(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, first = blocks(data, offsets)
        return np.maximum.reduceat(self.responses(codes, first), first[:-1], axis=0)

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 1500, batch: int = 32, rate: float = 1e-2, seed: int = 5) -> ByteCnn:
        """Adam on the log loss; gradients flow through the chunk of each filter's largest response. Same rows, same weights."""
        if len(texts) == 0 or len(set(labels.tolist())) < 2:
            self.constant = float(labels[0]) if len(texts) else 0.5
            return self
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        r, step = np.random.default_rng(seed), 0
        epochs = -(-steps * batch // len(texts))
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                picked = order[a : a + batch]
                step += 1
                grads = self._gradients([texts[i] for i in picked], labels[picked])
                speed = rate * (1 - 0.95 * step / total)
                for k in self.NAMES:
                    m[k] += 0.1 * (grads[k] - m[k])
                    v[k] += 0.01 * (grads[k] ** 2 - v[k])
                    getattr(self, k)[...] -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                self.embed[PAD] = 0
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        codes, first = blocks(np.frombuffer(b"".join(texts), np.uint8), offsets)
        out = self.responses(codes, first)
        n, filters = len(texts), len(self.bias)
        where = np.stack([out[a:b].argmax(axis=0) + a for a, b in zip(first, first[1:])])
        pooled = np.take_along_axis(out, where, axis=0) if n == 1 else out[where, np.arange(filters)]
        z, h, p = self.head(pooled)
        d = ((p - labels) / n).astype(np.float32)
        dh = np.outer(d, self.w2) * (h > 0)
        dz = (dh @ self.w1.T) * (z > 0)
        window = codes[(where * HOP)[:, :, None] + np.arange(WIDTH)]  # documents, filters, bytes
        x = self.embed[window].reshape(n, filters, WIDTH * DIM)
        dembed = np.zeros_like(self.embed)
        back = (dz[:, :, None] * self.conv.T[None]).reshape(-1, DIM)
        flat = window.reshape(-1)
        for k in range(DIM):
            dembed[:, k] = np.bincount(flat, weights=back[:, k], minlength=257)
        return {"embed": dembed, "conv": np.einsum("bf,bfk->kf", dz, x, optimize=True), "bias": dz.sum(0), "w1": z.T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": np.array([d.sum()], np.float32)}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 6000, max_bytes: int = 24 << 20) -> ByteCnn:
    """Fit on a bounded sample: of the labelled documents, in the order of a hash of doc_id, max_rows rows and max_bytes of whole
    texts at most, texts that do not fit passed over; one of each label at least, whatever its size (see bounded_rows). Rows with
    a null id, label or text are not learned from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("__label"))
    order = F.xxhash64(F.lit(1), F.col("doc_id"))
    picked = reduce(DataFrame.union, [known.where(F.col("__label") == y).withColumn("__rank", order).orderBy("__rank", "doc_id").limit(max_rows).drop("__rank") for y in (0, 1)])
    # at most max_rows narrow rows a label: broadcast
    rows = bounded_rows(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id"), max_rows, max_bytes, each="__label", values=(0, 1))
    return ByteCnn().fit([r["text"].encode("utf-8") for r in rows], np.array([r["__label"] for r in rows], dtype=np.float32))


def classify(docs: DataFrame, model: ByteCnn, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs with `score` (the probability of label 1) and `predicted` (1 if score >= threshold, else 0).

    Defined results: null and empty texts are scored as texts of padding alone; null ids and repeated rows are scored like
    any; input columns named score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(__name__)
        for batch in text_slices(batches, text):
            scores = model.score(*utf8_parts(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in source.schema), "score double", "predicted int"])
    return map_batches(source, run, schema)
