"""Words and shingles of a batch of texts as numpy arrays: no Python object per word.

A word's hash is a polynomial over its bytes modulo 2**64, taken as a difference of prefix sums and divided by the
power at its start (the base is odd, so it has an inverse), then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19

_libc = ctypes.CDLL(None)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = tuple(made)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return _FOLD[raw], offs - offs[0]


def trim() -> None:
    """Free pages of the heap go back to the system, where the C library can do that."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_BYTES of text, so that memory follows the longest text and not the batch. After each, what the arrays of the last slice held goes back to the system: workers stay for the stages that follow."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > CHUNK_BYTES:
            yield batch.slice(begin, i - begin)
            trim()
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)
        trim()


def spans(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words between gap bytes; first[i]: index of the first word of text i, one more at the end."""
    solid = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.ones(len(data), bool)
    before[1:] = ~solid[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which on arrays of this size beats the hash table of np.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Of each text: the sorted distinct hashes of its k-word shingles; of fewer words, one hash of them all."""
    w = _weights(k)
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        grams += words[j : j + len(grams)] * w[j]
    grams = mix(grams)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield unique(grams[a : b - k + 1])
        elif b > a:
            yield mix((words[a:b] * w[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def minhash(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of a set under each function of the family, as int32."""
    a, b = family
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[i : i + 4096, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set, whatever the order of its members."""
    signed = lambda x: int(np.asarray(x, np.uint64).view(np.int64))
    return signed(mix(shingles).sum(dtype=np.uint64)), signed(mix(shingles ^ np.uint64(_BASE)).sum(dtype=np.uint64))
