"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

The text is lower-cased (ASCII and Latin-1), runs of other ASCII than letters and digits become one space, and a space is
put at both ends, so that n-grams tell the beginnings and ends of words. Features are the distinct n-grams of 4 to 8
characters of it, hashed to 2**21 slots and counted by presence. A slot's ratio is log((p + a) / (P + a)) -
log((q + a) / (Q + a)), p and q the toxic and clean texts that hold it; slots in few texts or with a ratio near 0 are
left out. A logistic regression with an L2 penalty is then fitted to the scaled features, so a long clean text can't add
up small chances.

Defined cases: a null or empty text has no n-grams and gets the score of the bias; without labels of both classes every
score is the share of ones (0.5 without labels); repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .common import fold
from .quality import Prior
from .sampling import labelled_sample
from .scoring import with_columns

#: Bound of the training sample: toxic whole texts (and twice as many clean ones), bytes of a class together.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 24 << 20
SIZES, BITS = (4, 5, 6, 7, 8), 21
#: A slot needs LEAST_TEXTS texts, or a tenth of the smaller class if that is less.
SMOOTH, LEAST_TEXTS, LEAST_RATIO = 0.5, 6, 2.0
STEPS, RATE, PENALTY = 150, 0.05, 1e-3
ACCEPT = 0.5


_WORD = np.ones(256, bool)
_WORD[:128] = [chr(b).isalnum() for b in range(128)]


def plain(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as they are looked at, as arrays of characters (code points): lower case, words between single spaces, a space at both ends."""
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    offs = begins[offs]
    data = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(offs) - 1
    at = np.stack([offs[:-1], offs[1:]], 1).ravel()
    data = np.insert(data, at, np.uint32(0x20))
    offs = offs + 2 * np.arange(n + 1)
    data[(data >= 0xC0) & (data <= 0xDE) & (data != 0xD7)] += 32
    word = (data >= 128) | _WORD[np.minimum(data, 127)]
    keep = word.copy()
    keep[:-1] |= word[1:]
    keep[offs[1:] - 1] = True
    data = np.where(word, data, np.uint32(0x20))[keep]
    return data, np.concatenate([[0], np.cumsum(keep)])[offs]


_ROLL, _SPREAD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def slots(data: np.ndarray, offs: np.ndarray):
    """Yields (slot, text) arrays, one pair a size, of all n-grams that lie within one text: the top bits of a polynomial of their characters, mixed with the size."""
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    packed = data.astype(np.uint64)
    for n in range(2, max(SIZES) + 1):
        packed = packed[:-1] * np.uint64(_ROLL) + data[n - 1 :] if len(packed) > 1 else packed[:0]
        if n in SIZES:
            whole = owner[: len(packed)] == owner[n - 1 : n - 1 + len(packed)]
            yield (ta.mix(packed[whole] + np.uint64(n * _SPREAD & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64), owner[: len(packed)][whole]


def present(data: np.ndarray, offs: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each distinct pair; with chosen (a mask), of chosen slots only."""
    data, offs = plain(data, offs)
    keys = []
    for slot, text in slots(data, offs):
        if chosen is not None:
            on = chosen[slot]
            slot, text = slot[on], text[on]
        keys.append(ta.unique((text << BITS) | slot))
    both = ta.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


class Linear:
    def __init__(self, weights: np.ndarray, base: float):
        self.at, self.weights, self.base = np.flatnonzero(weights), weights[weights != 0], base
        self.table = None

    def __getstate__(self):
        return self.at, self.weights, self.base

    def __setstate__(self, state):
        self.at, self.weights, self.base = state
        self.table = None

    def logits_of(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << BITS)
            self.table[self.at] = self.weights
            self.chosen = self.table != 0
        text, slot = present(data, offs, self.chosen)
        return self.base + np.bincount(text, self.table[slot], len(offs) - 1)

    def logits(self, blobs: list[bytes]) -> np.ndarray:
        return np.concatenate([self.logits_of(*ta.texts(pa.array([b.decode()], pa.string()))) for b in blobs] or [np.zeros(0)])


def learn(texts: list[str], y: np.ndarray) -> Linear:
    batches = [ta.texts(part.column("text")) for part in ta.chunks(pa.record_batch([pa.array(texts, pa.string())], ["text"]), "text")]
    begins = np.cumsum([0, *(len(offs) - 1 for _, offs in batches)])
    held = np.zeros((2, 1 << BITS))
    for i, (data, offs) in enumerate(batches):
        text, slot = present(data, offs)
        for k in (0, 1):
            held[k] += np.bincount(slot[y[text + begins[i]] == k], minlength=1 << BITS)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    ratio = np.log((held[1] + SMOOTH) / (n[1] + SMOOTH)) - np.log((held[0] + SMOOTH) / (n[0] + SMOOTH))
    chosen = (held.sum(0) >= min(LEAST_TEXTS, max(1, n.min() // 10))) & (np.abs(ratio) >= LEAST_RATIO)
    names = np.flatnonzero(chosen)
    place = np.zeros(1 << BITS, np.int64)
    place[names] = np.arange(len(names))
    rows, cols = [], []
    for i, (data, offs) in enumerate(batches):
        text, slot = present(data, offs, chosen)
        rows.append(text + begins[i])
        cols.append(place[slot])
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    x, r = ratio[names][cols], np.zeros(len(names))
    w, b, m, v = r.copy(), float(np.log(n[1] / n[0])), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, x * w[cols], len(texts)), -30, 30)))
        slope = (p - y) / len(texts)
        g = np.append(np.bincount(cols, x * slope[rows], len(names)) + PENALTY * w, slope.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = RATE * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(1 << BITS)
    weights[names] = w * ratio[names]
    return Linear(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Linear | Prior:
    sample = labelled_sample(docs, labels, label, (2 * SAMPLE_ROWS, SAMPLE_ROWS), SAMPLE_BYTES)
    y = np.array([y for _, y in sample])
    if len({*y.tolist()}) < 2:
        return Prior(float(y.mean()) if len(y) else 0.5)
    return learn([t for t, _ in sample], y)


def score_toxicity(docs: DataFrame, model: Linear | Prior, text_col: str = "text", out: str = "score") -> DataFrame:
    def score(column: pa.Array) -> list:
        logit = model.logits([b""] * len(column)) if isinstance(model, Prior) else model.logits_of(*ta.texts(column))
        return [1 / (1 + np.exp(-np.clip(logit, -500, 500)))]

    return with_columns(docs, score, [T.StructField(out, T.DoubleType())], text_col)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
