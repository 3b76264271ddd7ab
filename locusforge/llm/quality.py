"""Quality classifier: a byte-level convolutional network in numpy.

A text is laid out in chunks that start every CHUNK bytes and hold WIDTH bytes more, so that filters see every byte window
of the whole text and nothing of another one: a score depends on the text alone. Each byte has a learned vector; FILTERS learned filters of WIDTH bytes are rectified and max-pooled in
each chunk; two layers give each chunk a logit and their mean is the text's. Learning is by Adam on labelled texts
outside the held-out fold, both classes with equal weight; the gradient of a max goes to the one window that made it.

Defined cases: a null or empty text is one chunk of padding and gets the score of that; without labels of both classes
every score is the share of ones (0.5 without any labels); repeated rows get equal scores, whatever batch they are in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold
from .sampling import labelled_sample
from .scoring import with_columns

#: Bound of the training sample: whole texts a class, and bytes of them together.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 24 << 20
CHUNK, WIDTH, VECTOR, FILTERS, HIDDEN = 512, 8, 8, 24, 16
STRIDE = CHUNK + WIDTH
#: Steps of learning, texts a step, chunks of each drawn anew in each step, rate.
STEPS, STEP_TEXTS, TEXT_CHUNKS, RATE = 700, 32, 6, 5e-3
#: Chunks scored at once (a few MB), always a multiple of EVEN: so the matrix product treats each row alike.
TOGETHER, EVEN = 256, 16
ACCEPT = 0.3


def layout(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, first): rows of STRIDE bytes, those that begin every CHUNK bytes of a text, with zeros after its end; first: each text's first row."""
    counts = np.array([max(1, -(-len(b) // CHUNK)) for b in blobs], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    rows = np.zeros((first[-1], STRIDE), np.uint8)
    for b, at, n in zip(blobs, first[:-1].tolist(), counts.tolist(), strict=True):
        padded = np.zeros(n * CHUNK + WIDTH, np.uint8)
        padded[: len(b)] = np.frombuffer(b, np.uint8)
        rows[at : at + n] = np.lib.stride_tricks.as_strided(padded, (n, STRIDE), (CHUNK, 1))
    return rows, first


class Net:
    def __init__(self, seed: int = 4):
        r = np.random.default_rng(seed)
        self.vectors = r.normal(0, 0.5, (256, VECTOR)).astype(np.float32)
        self.vectors[0] = 0
        self.kernel = r.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.inner = r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32)
        self.inner_shift = np.zeros(HIDDEN, np.float32)
        self.weights = r.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Per chunk and filter the greatest response; with where, also the window that made it. A phase is a reshape, not a copy; a product for each row, all of one shape, so that a row's result doesn't depend on the others; of the windows of a row the last reaches into the next row and isn't looked at."""
        n = len(rows)
        x = self.vectors[np.append(rows.ravel(), np.zeros(WIDTH, np.uint8))]
        best = at = None
        for phase in range(WIDTH):
            out = (x[phase : phase + n * STRIDE].reshape(n, STRIDE // WIDTH, WIDTH * VECTOR) @ self.kernel)[:, : CHUNK // WIDTH]
            if where:
                i = out.argmax(axis=1)
                top = np.take_along_axis(out, i[:, None], 1)[:, 0]
                here = i * WIDTH + phase
                at = here if best is None else np.where(top > best, here, at)
            else:
                top = out.max(axis=1)
            best = top if best is None else np.maximum(best, top)
        return (best + self.shift, at) if where else best + self.shift

    def _top(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # sums of each row alone: a matrix product may round a row otherwise in another place or number of rows
        h = np.maximum((a[:, :, None] * self.inner).sum(axis=1) + self.inner_shift, 0)
        return h, (h * self.weights).sum(axis=1) + self.base

    def logits(self, blobs: list[bytes]) -> np.ndarray:
        rows, first = layout(blobs)
        parts = []
        for i in range(0, len(rows), TOGETHER):
            part = rows[i : i + TOGETHER]
            n = len(part)
            if n % EVEN:
                part = np.concatenate([part, np.zeros((-n % EVEN, STRIDE), np.uint8)])
            parts.append(self._top(np.maximum(self.pooled(part), 0))[1][:n])
        return np.add.reduceat(np.concatenate(parts), first[:-1]) / np.diff(first) if blobs else np.zeros(0)

    def learn(self, blobs: list[bytes], y: np.ndarray, seed: int = 4) -> Net:
        r = np.random.default_rng(seed)
        params = [self.vectors, self.kernel, self.shift, self.inner, self.inner_shift, self.weights, self.base]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        while t < STEPS:
            for batch in np.array_split(r.permutation(len(blobs)), -(-len(blobs) // STEP_TEXTS)):
                every, first = layout([blobs[i] for i in batch])
                # a few chunks of each text a step, drawn from the whole text
                picks = [np.sort(r.permutation(b - a)[:TEXT_CHUNKS]) + a for a, b in zip(first[:-1], first[1:], strict=True)]
                rows = every[np.concatenate(picks)]
                owner = np.repeat(np.arange(len(batch)), [len(p) for p in picks])
                share = (1 / np.array([len(p) for p in picks], np.float32))[owner]
                z, at = self.pooled(rows, where=True)
                a = np.maximum(z, 0)
                h, chunk_logit = self._top(a)
                logit = np.bincount(owner, chunk_logit * share, len(batch))
                slope = ((1 / (1 + np.exp(-logit)) - y[batch]) * weight[batch] / len(batch))[owner].astype(np.float32) * share
                dh = slope[:, None] * self.weights * (h > 0)
                dz = (dh @ self.inner.T) * (z > 0)
                seen = rows[np.arange(len(rows))[:, None, None], at[..., None] + np.arange(WIDTH)]
                x = self.vectors[seen].reshape(len(rows), FILTERS, WIDTH * VECTOR)
                dx = (dz[..., None] * self.kernel.T).reshape(-1, VECTOR)
                dv = np.stack([np.bincount(seen.ravel(), dx[:, k], 256) for k in range(VECTOR)], 1).astype(np.float32)
                dv[0] = 0
                grads = [dv, np.einsum("cf,cfk->kf", dz, x), dz.sum(0), a.T @ dh, dh.sum(0), slope @ h, slope.sum(keepdims=True)]
                t += 1
                rate = RATE * max(0.02, 1 - t / STEPS)
                for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    p -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        return self


class Prior:
    """Stands in where a class is missing."""

    def __init__(self, share: float):
        self.logit = np.log((share + 1e-3) / (1 - share + 1e-3))

    def logits(self, blobs: list[bytes]) -> np.ndarray:
        return np.full(len(blobs), self.logit)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Net | Prior:
    sample = labelled_sample(docs, labels, label, (SAMPLE_ROWS, SAMPLE_ROWS), SAMPLE_BYTES)
    y = np.array([y for _, y in sample], np.float32)
    if len({*y}) < 2:
        return Prior(float(y.mean()) if len(y) else 0.5)
    return Net().learn([t.encode() for t, _ in sample], y)


def score_quality(docs: DataFrame, model: Net | Prior, text_col: str = "text", out: str = "score") -> DataFrame:
    def score(column: pa.Array) -> list:
        blobs = pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()
        return [1 / (1 + np.exp(-np.clip(np.asarray(model.logits(blobs), np.float64), -500, 500)))]

    return with_columns(docs, score, [T.StructField(out, T.DoubleType())], text_col)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_quality(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    return score_quality(docs, fit(docs, labels), out="__score").filter(F.col("__score") >= ACCEPT).drop("__score")
