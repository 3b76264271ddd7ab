r"""BPE encoding by per-prefix dynamic programming, and decoding.

In the merges' result for a string, the last token of each prefix is unique. For each prefix an automaton reports the
tokens that are its suffixes; the one that fits is that whose pair with the last token of the remaining prefix is
compatible: no merge would have crossed their boundary. Back-pointers from the whole word give its ids. The ids of a
word, and the digits and name of an id, lie end to end in arrays: a text is put together without a Python object a word.

Whether two tokens are compatible is read off the way they are built: the pieces that touch the boundary grow by known
merges at known ranks (ids rise with rank), and the pair is incompatible if at some time the touching pieces could merge
sooner than either grows (at equal rank the merge further left goes first).

The last byte of a word is a symbol of its own (`</w>`), so a word's symbols are its bytes with 256 added to the last.

Defined cases: null is empty; an empty or blank text has no ids and decodes to the empty string; the strings of special
tokens are special tokens; repeated rows get equal results; other columns pass through encode().
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import pieces
from .memo import Flat, Memo, Numbers, once
from .scoring import with_columns

_NEVER = 1 << 60
#: Remembered by a worker: words of common characters (some 60 bytes each), other words, pairs of tokens.
MEMORY, ODD_MEMORY, PAIRS = 500_000, 30_000, 150_000

#: U+00C0-U+00FF: letters whose lower case differs in one bit of the second byte.
LEADS = (0xC3,)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBPE:
    """An encoder for a vocabulary file of byte-level BPE with word ends. Pickles as the file's text; a worker makes it once."""

    def __init__(self, source: str):
        self.source = source
        self.memory, self.seen, self.ids = Memo(ODD_MEMORY), None, None

    def __reduce__(self):
        return once, (WordBPE, self.source)

    @cached_property
    def tables(self) -> WordBPE:
        spec = json.loads(self.source)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.symbol_ids = [0] * 512
        text: dict[int, str] = {}
        for letter, b in byte_letters().items():
            for symbol, name in ((b, letter), (b + 256, letter + suffix)):
                self.symbol_ids[symbol] = vocab[name]
                text[vocab[name]] = chr(symbol)
        self.pair: dict[tuple[int, int], int] = {}
        # the pieces of a token that touch its left and right end, from the single symbol to the token itself
        self.left = {i: (i,) for i in text}
        self.right = {i: (i,) for i in text}
        self.fits: dict[int, bool] = {}
        for m in spec["model"]["merges"]:
            x, y = m.split(" ") if isinstance(m, str) else m
            a, b, made = vocab[x], vocab[y], vocab[x + y]
            usable = made not in text and a in self.left and b in self.right and self._compatible(a, b)
            self.pair.setdefault((a, b), made)
            if usable:
                text[made] = text[a] + text[b]
                self.left[made] = (*self.left[a], made)
                self.right[made] = (*self.right[b], made)
        self.automaton = ahocorasick.Automaton()
        for i, s in text.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.digit_text, self.name_text = Flat("u1"), Flat("u1")
        for texts, of in ((self.digit_text, str), (self.name_text, lambda i: self.names.get(i, ""))):
            made = [f"{of(i)} ".encode() for i in range(max(self.names) + 1)]
            texts.extend(np.frombuffer(b"".join(made), np.uint8), np.array([len(x) for x in made], np.int64))
        return self

    def _compatible(self, a: int, b: int) -> bool:
        right, left = self.right[a], self.left[b]
        i = j = 0
        while True:
            grow_a = right[i + 1] if i + 1 < len(right) else _NEVER
            grow_b = left[j + 1] if j + 1 < len(left) else _NEVER
            across = self.pair.get((right[i], left[j]), _NEVER)
            if across < grow_a and across <= grow_b and across != _NEVER:
                return False
            if grow_a <= grow_b:
                if grow_a == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def ids_of(self, word: bytes) -> list[int]:
        """The ids of one word, that is one piece of pre-tokenization."""
        t = self.tables
        n = len(word)
        last, size, fits = [0] * (n + 1), [0] * (n + 1), t.fits
        for end, (token, length) in t.automaton.iter(word[:-1].decode("latin-1") + chr(256 + word[-1])):
            i = end + 1
            if size[i]:
                continue
            if length < i:
                pair = last[i - length] << 32 | token
                good = fits.get(pair)
                if good is None:
                    if len(fits) > PAIRS:
                        fits.clear()
                    good = fits[pair] = t._compatible(last[i - length], token)
                if not good:
                    continue
            last[i], size[i] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """As the library does for a vocabulary without a decoder: the tokens with a space between."""
        names = self.tables.names
        return " ".join(names[i] for i in ids)

    @cached_property
    def _parts(self):
        library = Tokenizer.from_str(self.source)
        return re.compile("(" + "|".join(map(re.escape, self.tables.special)) + ")"), library.normalizer, library.pre_tokenizer, byte_letters()

    def words(self, text: str) -> list[bytes | int]:
        """Words of any text, and the ids of special tokens among them: the general way, with the file's own normalizer and pre-tokenizer."""
        special, normalizer, cutter, letters = self._parts
        out: list[bytes | int] = []
        for part in special.split(text):
            if part in self.tables.special:
                out.append(self.tables.special[part])
            elif part:
                out += [bytes(map(letters.__getitem__, w)) for w, _ in cutter.pre_tokenize_str(normalizer.normalize_str(part))]
        return out

    def known(self, word: bytes | int) -> bytes:
        """The ids of a word of a text of uncommon characters, as bytes of an array."""
        found = self.memory.find([word])[0]
        if found is None:
            found = self.memory.put(word, np.array([word] if isinstance(word, int) else self.ids_of(word), np.int32).tobytes())
        return found

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.words(text or "") for i in ([w] if isinstance(w, int) else self.ids_of(w))]

    def _numbers(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number in memory of each distinct word."""
        if self.seen is None or len(self.seen) > MEMORY:
            self.seen, self.ids = Numbers(), Flat("<i4")
        at = self.seen.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            whole = data.tobytes()
            made = [self.ids_of(whole[a:b]) for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            size = np.array([len(x) for x in made], np.int64)
            self.ids.extend(np.fromiter(chain.from_iterable(made), np.int32, int(size.sum())), size)
            at[missing] = self.seen.add(keys[missing])
        return at

    def arrays(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        data, offs = pieces.raw(column)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        accented = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
        low[accented[(data[accented] >= 0x80) & (data[accented] <= 0x9E)]] += 32
        starts, ends = pieces.split_words(low, offs)
        first = np.searchsorted(starts, offs)
        odd = pieces.odd_texts(data, offs, LEADS) | pieces.long_texts(first, starts, ends)
        words = np.diff(first)
        good = ~np.repeat(odd, words)
        starts, ends = starts[good], ends[good]
        keys, sample, which = pieces.distinct(low, starts, ends)
        flat, edge = self.ids_at(low, keys, starts[sample], ends[sample], which)
        edge = edge[np.concatenate([[0], np.cumsum(np.where(odd, 0, words))])].tolist()
        return [np.frombuffer(b"".join(map(self.known, self.words(column[i].as_py()))), np.int32) if odd[i] else flat[edge[i] : edge[i + 1]] for i in range(len(column))]

    def ids_at(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words, end to end; where each word's begin, and the end)."""
        number = self._numbers(data, keys, starts, ends)  # this may begin a new memory
        return self.ids.take(number[which])

    def batch(self, column: pa.Array):
        """Per text: (ids, ids as text, decoded text), texts as UTF-8."""
        t = self.tables
        ids = self.arrays(column)
        if not ids:
            return
        flat = np.concatenate(ids)
        edge = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        (digits, d), (names, n) = t.digit_text.take(flat), t.name_text.take(flat)
        digits, names, d, n = digits.tobytes(), names.tobytes(), d[edge].tolist(), n[edge].tolist()
        for i, x in enumerate(ids):  # each token brings the space after it: the last one's goes
            yield x, digits[d[i] : max(d[i], d[i + 1] - 1)], names[n[i] : max(n[i], n[i + 1] - 1)]


def load(path: str) -> WordBPE:
    """Read on the driver; workers get the text with the task, and need no file."""
    with open(path, encoding="utf-8") as f:
        return WordBPE(f.read())


def encode(docs: DataFrame, bpe: WordBPE, text_col: str = "text") -> DataFrame:
    """docs with ids (array) and decoded."""

    def run(column: pa.Array) -> list:
        got = list(bpe.batch(column))
        return [[g[0] for g in got], [g[2].decode() for g in got]]

    return with_columns(docs, run, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], text_col)


def digest(docs: DataFrame, path: str) -> DataFrame:
    bpe = load(path)
    sha = lambda s: hashlib.sha256(s).hexdigest()

    def run(column: pa.Array) -> list:
        rows = [(len(ids), sha(digits), sha(decoded)) for ids, digits, decoded in bpe.batch(column)]
        return [list(x) for x in zip(*rows, strict=True)] or [[], [], []]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return with_columns(docs.select("doc_id", "text"), run, fields).drop("text")
