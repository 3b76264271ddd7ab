"""Crowds of look-alikes a little under the threshold, with true pairs among them, against brute force."""

import random
from math import ceil, comb

import numpy as np
import pytest

from locusforge.llm import across, near_dedup, repeats
from tests.llm.test_operators import edited, near_truth, prose


def crowd(r, n, pairs, tail=17, head=83, alike=5):
    """n texts that share a template (pairwise under 0.75); the first `pairs` have a partner over it."""
    template = prose(r, head)
    own = [prose(r, tail).split() for _ in range(n)]
    for k in range(pairs):
        own[pairs + k][:alike] = own[k][:alike]
    texts = [template + " " + " ".join(o) for o in own]
    r.shuffle(texts)
    return list(enumerate(texts))


def components_of(rows, df):
    return {i: (x.n_shingles, x.component_id) for i, x in rows(near_dedup.digest(df)).items()}


@pytest.mark.parametrize("block", [256, 7])  # one block a region, and many
def test_crowded_regions_lose_no_pair(spark, docs, rows, monkeypatch, block):
    r = random.Random(12)
    pairs = crowd(r, 120, 20)
    base = prose(r, 90)
    pairs += [(1000 + i, edited(r, base, r.randrange(0, 6))) for i in range(60)]
    truth = near_truth(pairs)
    assert sum(i != c for i, (_, c) in truth.items()) > 40
    monkeypatch.setattr(near_dedup, "REGION", 4)
    monkeypatch.setattr(across, "MEMBERS", block)
    assert components_of(rows, docs(pairs)) == truth


def test_failed_candidates_hide_no_pair(spark, docs, rows):
    """One region a tree, under REGION: pairs of higher estimated likeness that fail must not stand for a link."""
    pairs = crowd(random.Random(13), 200, 60, alike=4)
    truth = near_truth(pairs)
    assert sum(i != c for i, (_, c) in truth.items()) == 60
    assert components_of(rows, docs(pairs)) == truth


@pytest.mark.parametrize("block", [256, 9])
def test_crowded_band_keys_lose_no_link(spark, docs, monkeypatch, block):
    """Templated sentences, pairwise under 0.75, with near copies among them: the links' components against brute force."""
    monkeypatch.setattr(across, "MEMBERS", block)
    r = random.Random(14)
    pairs = crowd(r, 150, 40, tail=6, head=28, alike=5)
    truth = near_truth(pairs)
    assert sum(i != c for i, (_, c) in truth.items()) == 40
    base = docs(pairs).selectExpr("doc_id AS id", "xxhash64(text) AS th", "text")
    links = repeats._links(base)[0].collect()
    assert len({frozenset((x.u, x.v)) for x in links}) == 40


def matrix_truth(pairs):
    """near_truth() by a product of matrices: for thousands of texts."""
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.lower().split() for _, t in pairs)]
    names = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        has[i, [names[g] for g in s]] = 1
    size, both = has.sum(1), has @ has.T
    forest = across.Forest(len(sets))
    for a, b in zip(*np.nonzero(np.triu(100 * both >= 75 * (size[:, None] + size - both), 1)), strict=True):
        forest.join(int(a), int(b))
    least = {}
    for k, (i, _) in enumerate(pairs):
        least[forest.root(k)] = min(i, least.get(forest.root(k), i))
    return {i: (int(size[k]), least[forest.root(k)]) for k, (i, _) in enumerate(pairs)}


@pytest.mark.parametrize("n,region", [(300, 256), (300, 4), (1200, 256), (1200, 4), (3000, 256), (3000, 4)])
def test_crowds_of_near_copies(spark, docs, rows, monkeypatch, n, region):
    """One base text with random edits: some copies are in the great component, some in small ones, some alone."""
    r = random.Random(n)
    base = prose(r, 60)
    pairs = [(i, edited(r, base, r.randrange(0, 5))) for i in range(n)]
    truth = matrix_truth(pairs)
    assert len({c for _, c in truth.values()}) > n // 20
    monkeypatch.setattr(near_dedup, "REGION", region)
    assert components_of(rows, docs(pairs)) == truth


def test_signature_filter_seldom_drops_a_pair_at_the_threshold():
    p, least = 0.75 + 0.25 / 256, ceil(near_dedup.LIKELY * near_dedup.HASHES)
    assert sum(comb(near_dedup.HASHES, k) * p**k * (1 - p) ** (near_dedup.HASHES - k) for k in range(least)) < 2e-5
    marks = np.repeat(np.arange(3, dtype=np.uint8), near_dedup.HASHES).reshape(3, -1)
    marks[1, :76] = marks[0, :76]
    assert near_dedup.likely_pairs(np.arange(3), marks) == [(0, 1)]
