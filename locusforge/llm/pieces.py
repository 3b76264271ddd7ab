"""Pre-tokenization as numpy arrays, for texts of common characters; others go a slower, general way.

The common characters are ASCII without the separators 0x1C-0x1F, and two-byte letters: what byte they are tells their
class. A text with any other character is `odd` and left to the caller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textarrays as ta

LETTER, DIGIT, OTHER, BLANK, REST = range(5)

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[0x80:0xC0] = REST  # bytes that continue a character
_CLASS[0xC0:] = LETTER

LONG = 512

#: Contractions that the patterns of both tokenizers take before anything else.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)), offs - offs[0]


def odd_texts(data: np.ndarray, offs: np.ndarray, leads: tuple[int, ...]) -> np.ndarray:
    """Which texts hold a character outside the common ones, or `<|`, with which special tokens begin."""
    allowed = np.zeros(256, bool)
    allowed[:0xC0] = True
    allowed[0x1C:0x20] = False
    allowed[list(leads)] = True
    bad = ~allowed[data]
    if len(data) > 1:
        bad[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs for times and divided by
        bad[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        # a two-byte character has exactly one byte that continues it; U+0080-U+00BF have the lead 0xC2, not allowed
    return _any(bad, offs)


def _any(bad: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(bad, False), offs[:-1]) * (np.diff(offs) > 0) > 0 if len(offs) > 1 else np.zeros(0, bool)


def long_texts(first: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts hold a piece of over LONG bytes: those are left to the caller too, for equal hashes tell equal pieces only while they are short. first: index of each text's first piece."""
    return _any(ends - starts > LONG, first)


def classes(data: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    rest = np.flatnonzero(kind == REST)
    kind[rest] = LETTER
    return kind


def contractions(data: np.ndarray, kind: np.ndarray, first: np.ndarray, after_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """(at, length) of the contractions. They begin where a match begins: not after other signs, nor, unless after_space, after the space that such a sign takes with it."""
    at = np.flatnonzero(data == 0x27)
    at = at[(first[at]) | ((kind[at - 1] != OTHER) & (after_space | (data[at - 1] != 0x20)))]
    padded = np.append(data, [0, 0])
    edge = np.append(first, [True, True, True])
    one, two = padded[at + 1], padded[np.minimum(at + 2, len(padded) - 1)]
    inside1, inside2 = ~edge[at + 1], ~edge[at + 1] & ~edge[at + 2]
    length = np.zeros(len(at), np.int64)
    for c in CONTRACTIONS:
        if len(c) == 1:
            length[inside1 & (one == ord(c))] = 2
    for c in CONTRACTIONS:
        if len(c) == 2:
            length[(length == 0) & inside2 & (one == ord(c[0])) & (two == ord(c[1]))] = 3
    return at[length > 0], length[length > 0]


def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""(starts, ends) of `'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+`."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes(data)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    first = first[:n]
    lead = (data & 0xC0) != 0x80
    begin = first.copy()
    begin[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    at, length = contractions(data, kind, first, True)
    begin[at] = True
    begin[at + 1] = False
    ends = at + length
    begin[at[length == 3] + 2] = False
    begin[ends[ends < n]] = True
    begin &= lead
    starts = np.flatnonzero(begin)
    stops = np.append(starts[1:], n)
    solid = kind[starts] != BLANK
    return starts[solid], stops[solid]


def split_bytes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""(starts, ends) of `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`: they cover every byte."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes(data)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    first = first[:n]
    blank = kind == BLANK
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # before a solid character the last blank stands apart from the blanks before it; a space goes with that character
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
    begin |= last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (data[:-1] == 0x20)
    begin &= ~joined
    at, length = contractions(data, kind, first, False)
    begin[at + 1] = False
    begin[at[length == 3] + 2] = False
    ends = at + length
    begin[ends[ends < n]] = True
    begin &= (data & 0xC0) != 0x80
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sample, which): the distinct pieces by hash, a piece of each, and for each piece which of them it is."""
    keys, sample, which = np.unique(ta.word_hashes(data, starts, ends).view(np.int64), return_index=True, return_inverse=True)
    return keys, sample, which
