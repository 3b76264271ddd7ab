import math
import random

import numpy as np
import pytest

from locusforge import rules
from locusforge.operators import fragments, scan
from locusforge.queries import back_translated
from locusforge.sources import config


@pytest.fixture(scope="module")
def scanner():
    return scan.Scanner(config.synthetic())


def codes(protein):
    return np.array([26 if c == "*" else ord(c) - 65 for c in protein], np.int64)


def dense(motifs, protein):
    """The rules on full arrays, one place at a time."""
    n = len(protein)
    hits, ps, reach = [0] * n, [1.0] * n, 0
    if n < motifs.max_width:
        return []
    for m in motifs.order:
        w = motifs.width(m)
        reach = max(reach, w)
        for j in range(n - w + 1):
            score = sum(int(motifs.pwm[m][ord(c) - 65, i]) for i, c in enumerate(protein[j : j + w]) if c != "*")
            if score < motifs.threshold(m, rules.CANDIDATE_P):
                continue
            p = motifs.pvalue(m, score)
            over = [k for k in range(j, j + w) if hits[k]] + [k for k in range(max(0, j - reach + 1), j) if hits[k] and motifs.width(hits[k]) > j - k]
            if over and p >= math.prod(ps[k] for k in over):
                continue
            for k in over:
                hits[k], ps[k] = 0, 1.0
            hits[j], ps[j] = m, p
    return [(q, h, ps[q]) for q, h in enumerate(hits) if h and ps[q] < rules.ACCEPT_P]


def test_random_proteins(scanner):
    r = random.Random(3)
    words = [config.consensus(i) for i in rules.RANK]
    proteins = []
    for _ in range(60):
        text = ""
        while len(text) < 120:
            w = r.choice(words)
            cut = r.randrange(len(w))
            text += r.choice([w, w[:cut], w[cut:], "".join(r.choice("ACDEFGHIKLMNPQRSTVWYX*") for _ in range(5))])
        proteins.append(text)
    proteins += ["", "A" * 49, "*" * 60]
    got = list(scanner.accepted([codes(p) for p in proteins]))
    assert got == [dense(config.synthetic(), p) for p in proteins]
    assert sum(map(len, got)) > 100


def test_tied_zero_p_values():
    flat = config.Motifs((1, 2), {i: np.ones((26, 3), np.int64) for i in (1, 2)}, {i: np.zeros(1) for i in (1, 2)})
    s = scan.Scanner(flat)
    assert list(s.accepted([codes("ACDEFG")])) == [dense(flat, "ACDEFG")]


def test_fragments(spark):
    p1, p6 = rules.CONSENSUS[1], rules.CONSENSUS[6]
    dna = back_translated(p1 + "G" * 10 + p6 + p1 + "G" * 10 + p6 + "A" * 100)
    contigs = spark.createDataFrame([("chr1", dna), ("none", "ACGT" * 100), ("short", "A")], "contig_id string, sequence string")
    rows = scan.scan_fragments(fragments.chop(contigs), config.synthetic()).collect()
    assert {r.contig_id for r in rows} == {"chr1"} and [r.motif_id for r in sorted(rows, key=lambda r: r.dna_start)] == [1, 6, 1, 6]
    first = min(rows, key=lambda r: r.dna_start)
    assert (first.position, first.dna_start, first.dna_end, first.protein_sequence, first.strand, first.frame) == (1, 0, 63, p1, "+", 0)
    back = contigs.selectExpr("contig_id", "translate(reverse(sequence), 'ATGC', 'TACG') AS sequence")
    mirrored = scan.scan_fragments(fragments.chop(back), config.synthetic()).collect()
    assert sorted((len(dna) - r.dna_end, r.motif_id) for r in mirrored) == sorted((r.dna_start, r.motif_id) for r in rows)
    assert {r.strand for r in mirrored} == {"-"}


def test_coordinates(spark):
    from pyspark.sql import functions as F

    for strand, width, want in (("+", 4, (100, 112)), ("-", 4, (20088, 20100)), ("-", 3, (20091, 20100))):
        a, b = fragments.dna_span(F.lit(strand), F.lit(0), F.lit(100), F.lit(20000), F.lit(1), F.lit(width))
        assert tuple(spark.range(1).select(a.alias("a"), b.alias("b")).first()) == want


def test_config(spark, tmp_path):
    own = config.synthetic()
    assert own.max_width == 50 and own.width(1) == 21 and len(own.order) == 20
    pwm, cdf = config.as_text(own)
    (tmp_path / "mot.txt").write_text(pwm)
    (tmp_path / "store.txt").write_text(cdf)
    back = config.load_dir(spark, str(tmp_path))
    assert back.order == own.order and all((back.pwm[i] == own.pwm[i]).all() and np.allclose(back.cdf[i], own.cdf[i]) for i in own.order)
    assert own.threshold(1, 1e-4) == 61 and own.pvalue(1, -5) == own.pvalue(1, 0) and own.pvalue(1, 10**6) == 0.0
    (tmp_path / "x.txt").write_text("motif_2@0@A 5\nbad\nmotif_1@1@C 7\nmotif_2@x@A 9\nmotif_1@3@\n\nmotif_1@1@C 8 extra\nmotif_2@1@* 4\nmotif_999@0@A 1\n")
    got = config.load(spark, str(tmp_path / "x.txt"))
    assert got.order == (2, 1) and got.width(1) == 4 and got.pwm[1][2, 1] == 8 and got.pwm[2][0, 0] == 9 and got.width(2) == 2
    (tmp_path / "y.txt").write_text("motif_1@3 0.5\nmotif_1@1 x\n")
    assert config.load(spark, str(tmp_path / "x.txt"), str(tmp_path / "y.txt")).cdf[1].tolist() == [0, 0, 0, 0.5]
    (tmp_path / "z.txt").write_text("motif_21@0@A 1\n")
    with pytest.raises(ValueError):
        config.load(spark, str(tmp_path / "z.txt"))


def test_packed_scores_are_those_of_each_motif():
    """Four motifs share a look-up: negative and very large scores, blocks' edges and few tables."""
    r = np.random.default_rng(4)
    own = config.synthetic()
    pwm = {i: r.integers(-9000, 9000, m.shape) if i % 5 == 0 else r.integers(-40, 60, m.shape) for i, m in own.pwm.items()}
    s = scan.Scanner(config.Motifs(own.order, pwm, own.cdf))
    s.first = {i: 20_000 if i % 5 == 0 else 250 for i in own.order}
    text = r.integers(0, 27, 2 * scan.BLOCK + 77).astype(np.uint8)
    n = len(text) - s.reach
    got = {i: {} for i in own.order}
    for i, places, scores in s.over(np.append(text, np.zeros(3 * s.reach + 3, np.uint8)), n):
        got[i].update(zip(places.tolist(), scores.tolist(), strict=True))
    for i, m in pwm.items():
        full = np.vstack([m, np.zeros((1, m.shape[1]), np.int64)])
        total = sum(full[text[j : j + n], j] for j in range(m.shape[1]))
        assert got[i] == {q: total[q] for q in np.flatnonzero(total >= s.first[i]).tolist()}
    assert s.alone and sum(len(t) for t, _ in s.packs) + len(s.alone) * 17 < sum(map(len, s.tables.values()))


def test_small_scores_take_lanes_of_eight_bits():
    """Eight motifs of few distinct scores share a look-up: 31 look-ups a place instead of 45, with the same windows."""
    own = config.synthetic()
    s = scan.Scanner(own)
    assert not s.alone and sum(len(t) for t, _ in s.packs) < 32
    r = np.random.default_rng(5)
    text = r.integers(0, 27, scan.BLOCK + 900).astype(np.uint8)
    for k, i in enumerate(own.order):
        text[100 + 60 * k : 100 + 60 * k + own.width(i)] = own.pwm[i].argmax(axis=0)
    n = len(text) - s.reach
    got = {i: {} for i in own.order}
    for i, places, scores in s.over(np.append(text, np.zeros(3 * s.reach + 3, np.uint8)), n):
        got[i].update(zip(places.tolist(), scores.tolist(), strict=True))
    for i in own.order:
        full = np.vstack([own.pwm[i], np.zeros((1, own.width(i)), np.int64)])
        total = sum(full[text[j : j + n], j] for j in range(own.width(i)))
        assert got[i] and got[i] == {q: total[q] for q in np.flatnonzero(total >= s.first[i]).tolist()}


def test_matches_are_counted_in_planes_of_bits():
    """Matrices of one step take no look-up a place; several letters a column, flat columns, thresholds that all or no places reach, rows' edges, and others beside them."""
    own = config.synthetic()
    assert not scan.Scanner(own).packs and set(scan.Scanner(own).counted) == set(own.order)
    r = np.random.default_rng(6)
    pwm = {i: 7 * (r.random(m.shape) < r.choice([0.05, 0.3])) * (np.arange(m.shape[1]) % 5 > 0) for i, m in own.pwm.items()}
    pwm[2] = r.integers(0, 3, own.pwm[2].shape)  # two steps: lanes of 8 bits
    pwm[4] = np.full(own.pwm[4].shape, 2)  # all letters but the stop codon
    s = scan.Scanner(config.Motifs(own.order, pwm, own.cdf))
    assert 2 not in s.counted and len(s.packs) == 1 and len(s.counted) == 19
    s.first = {i: {1: -10_000, 3: 10_000, 4: 29}.get(i, 35) for i in own.order}
    for n in (8 * scan.ROW + 1001, 5):
        text = r.integers(0, 27, n + s.reach).astype(np.uint8)
        got = {i: {} for i in own.order}
        for i, places, scores in s.over(np.append(text, np.zeros(3 * s.reach + 3, np.uint8)), n):
            assert list(places) == sorted(places)
            got[i].update(zip(places.tolist(), scores.tolist(), strict=True))
        for i, m in pwm.items():
            full = np.vstack([m, np.zeros((1, m.shape[1]), np.int64)])
            total = sum(full[text[j : j + n], j] for j in range(m.shape[1]))
            assert got[i] == {q: total[q] for q in np.flatnonzero(total >= s.first[i]).tolist()}
