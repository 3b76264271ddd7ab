"""Array forms of words, shingles and pieces against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from locusforge.llm import bpe, pieces, sstable, toxicity
from locusforge.llm import textarrays as ta
from locusforge.llm.memo import Memo, Numbers

ALPHA = "abAB  \n\t.,!?'09éÉßλЖ中 \u0085😀"


def some_texts(n, k, seed=1, alpha=ALPHA):
    r = random.Random(seed)
    return [None, "", " ", "\n"] + ["".join(r.choice(alpha) for _ in range(r.randrange(k))) for _ in range(n)]


def test_words_and_shingles():
    texts = some_texts(400, 60)
    data, offs = ta.texts(pa.array(texts))
    starts, ends, first = ta.spans(data, offs)
    hashes = ta.word_hashes(data, starts, ends)
    seen = {}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        got = [data[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert got == words
        for w, h in zip(words, hashes[first[i] : first[i + 1]], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for t, s in zip(texts, ta.shingle_sets(hashes, first), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        want = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or ({tuple(words)} if words else set())
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()


def test_chunks_cover_the_batch():
    batch = pa.record_batch([pa.array(["a" * (1 << 19), None, "b" * (1 << 21), "", "c"] * 3)], ["text"])
    parts = list(ta.chunks(batch, "text"))
    assert sum(len(p) for p in parts) == 15 and len(parts) > 4 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_memo_is_bounded():
    m = Memo(100)
    for i in range(1000):
        m.put(i, str(i))
        assert len(m) + len(m.older) <= 150
    assert m.find([999, 0]) == ["999", None]


@pytest.mark.parametrize("alpha,k", [("abAB's tTrevmdlL  \n\t'.,!?0123éÉÀßü", 40), (ALPHA + "ΣσςİıǅÅ½²Ⅷ字​\x1c\x1d\x0b ́÷×<|>ʰ҂", 30), ("aeinorst", 60)])
def test_bpe_equals_the_library(alpha, k):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.load(path), Tokenizer.from_file(path)
    texts = some_texts(1500, k, 2, alpha) + ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>'s", "it's WE'LL '' 'x", "Ünï" * 3000]
    for t, (ids, digits, decoded) in zip(texts, own.batch(pa.array(texts)), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == want == ids.tolist() and digits.decode() == " ".join(map(str, want))
        assert decoded.decode() == own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_numbers_of_keys():
    r, n, of = np.random.default_rng(3), Numbers(), {}
    for _ in range(40):
        keys = np.unique(r.integers(-(1 << 63), 1 << 63, 300) >> r.integers(40, 58))
        at = n.find(keys)
        assert at.tolist() == [of.get(k, -1) for k in keys.tolist()]
        new = r.permutation(keys[at < 0])
        of |= zip(new.tolist(), n.add(new).tolist(), strict=True)
        assert sorted(of.values()) == list(range(len(n)))


def test_a_full_memory_begins_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe.WordBPE(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for seed in range(6):
        texts = some_texts(40, 30, seed, "aeinorst  éÉ")
        for t, ids in zip(texts, own.arrays(pa.array(texts)), strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("alpha,k", [("abAB's tTrevmdlL  \n\t'.,!?0123éÉÀßüЖ", 40), (ALPHA + "Σ½²字​\x1c\x0b ́÷×<|>ʰ҂", 30)])
def test_byte_bpe_equals_the_library(alpha, k):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = sstable.load(path), Tokenizer.from_file(path)
    texts = some_texts(1500, k, 3, alpha) + ["<|endoftext|>", "a <|endoftext|> b", "it's  we'll '' 'x", " \n \n's", "a" * 5000]
    for t, ids in zip(texts, own.batch(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_every_common_character():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}." for c in range(1, 0x590)]
    for t, ids in zip(texts, sstable.load(public_tokenizers.path("byte_bpe_50k.json")).batch(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert pieces.odd_texts(*pieces.raw(pa.array(["é", "×", "中", "", "a"])), (0xC3,)).tolist() == [False, True, True, False, False]


def test_shard_round_trip():
    r = random.Random(5)
    rows = sorted((r.randrange(-(2**62), 2**62), r.randrange(300)) for _ in range(2000))
    rows = sorted(rows + [(7, 3), (7, 0), (7, 40_000), (8, 1)], key=lambda x: x[0])
    writer, blocks, want = sstable.ShardWriter(2), [], []
    for key, n in rows:
        ids = np.array([r.randrange(1 << 16) for _ in range(n)], "<u2")
        want.append((key, ids.tolist()))
        blocks += writer.add(key, ids.tobytes())
    blocks += writer.close()
    shard = sstable.Shard(b"".join(b + b"\n" for b in blocks))
    assert [(k, v.tolist()) for k, v in shard] == want and shard.documents == len(rows) and len(shard.index) > 5
    assert [v.tolist() for v in shard.get(7)] == [v for k, v in want if k == 7]
    for key, ids in want[::97]:
        assert ids in [v.tolist() for v in shard.get(key)]
    absent = [k for k in (r.randrange(-(2**62), 2**62) for _ in range(2000)) if k not in dict(rows)]
    assert not any(shard.get(k) for k in absent) and sum(map(shard.may_hold, absent)) < 0.05 * len(absent)
    with pytest.raises(ValueError):
        sstable.Shard(b"x" * 100)


def test_toxicity_plain_text():
    data, offs = toxicity.plain(*ta.texts(pa.array(["Ab!! cÉ", "", "--"])))
    assert ["".join(map(chr, data[a:b])) for a, b in zip(offs[:-1], offs[1:], strict=True)] == [" ab cé ", " ", " "]
