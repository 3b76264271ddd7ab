"""Motif tables by tiles: results must not depend on where tiles and islands are cut."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusforge import rules
from locusforge.operators import assemble as asm
from locusforge.operators import motifs as mo
from locusforge.schemas import MOTIF


def table_of(spark, seed, contigs=40, length=120, tight=False):
    """Random motifs with seeds, repeats, copies, equal places on both strands and contigs that turn at one start."""
    r = random.Random(seed)
    rows = []
    for c in range(contigs):
        at = -700 if c % 5 == 0 else 0
        words = [*rules.SEEDS, rules.NBARC_ORDER, (9, 11, 19, 9), (9, 20)]
        strands = r.choice(["+", "+-", "++-", "-"])
        n = 0
        while n < length:
            at += r.choice([90, 400, 600, 2400] if tight else [90, 400, 600, 2400, 2600, 11000, 30000])
            strand = r.choice(strands)
            for m in r.choice(words) if r.random() < 0.4 else [r.randrange(1, 21)]:
                at += r.choice([0, 80, 100, 300])
                for s in [strand] * r.choice([1, 1, 1, 2, 3]) + (["-" if strand == "+" else "+"] if r.random() < 0.15 else []):
                    rows.append((m, f"c{c}_0_frame{s}0", 1, r.choice(["AC", "AC", "A*"]), 1e-6, 0.0, f"c{c}", at, at + 9, s, r.randrange(2), 0))
                    n += 1
    return spark.createDataFrame(rows, MOTIF)


def walked(df):
    """Dedup and loci of whole contigs, in plain Python."""
    contigs = {}
    for x in df.collect():
        contigs.setdefault(x.contig_id, []).append(x)
    kept, loci = {}, {}
    for c, rows in contigs.items():
        rows.sort(key=lambda x: (x.strand == "-", -x.dna_start if x.strand == "-" else x.dna_start, x.frag_offset, x.frame, x.motif_id, x.protein_sequence, x.pvalue))
        out, k = [], 0
        for i, x in enumerate(rows):
            k = k + 1 if i and (rows[i - 1].motif_id, rows[i - 1].dna_start) == (x.motif_id, x.dna_start) else 0
            if k % 2 == 0:
                out.append(x)
        kept[c] = [(x.strand, x.dna_start, x.motif_id, x.frame, x.protein_sequence) for x in out]
        found = [[(out[i].motif_id, out[i].dna_start, out[i].strand) for i in locus] for locus in asm.fold_contig([(x.motif_id, x.dna_start, x.strand, "*" in x.protein_sequence) for x in out])]
        if found:
            loci[c] = found
    return kept, loci


@pytest.mark.parametrize("seed, tight", [(1, False), (2, False), (3, True)])
def test_tiles_against_whole_contigs(spark, monkeypatch, seed, tight):
    monkeypatch.setattr(mo, "TILE", 3000)
    monkeypatch.setattr(asm, "SPAN", 5000)
    df = table_of(spark, seed, tight=tight).cache()
    want, loci = walked(df)
    kept, turns = mo.deduped(df)
    got = {}
    for x in kept.collect():
        got.setdefault(x.contig_id, []).append((x.strand, x.dna_start, x.motif_id, x.frame, x.protein_sequence))
    assert {c: sorted(v) for c, v in got.items()} == {c: sorted(v) for c, v in want.items()}
    assert sorted(map(tuple, turns.collect())) == sorted(map(tuple, mo.turns(kept).collect()))
    w = Window.partitionBy("contig_id").orderBy(*mo.order_columns())
    ranks = mo.rank_motifs(df).withColumn("n", F.row_number().over(w))
    assert ranks.filter("n <> motif_rank").count() == 0 and ranks.count() == df.count()
    for whole in (False, True):
        found = {}
        for x in asm.assemble(kept, table=None if whole else turns, whole=whole).orderBy("contig_id", "locus_no").collect():
            found.setdefault(x.contig_id, []).append([(m.motif_id, m.dna_start, m.strand) for m in x.motifs])
        assert found == loci


def test_islands_stay_small(spark):
    """A long contig without wide gaps, with places on both strands, is cut near its seeds."""
    r = random.Random(7)
    rows = [(r.randrange(1, 21), "c_0_frame+0", 1, "AC", 1e-6, 0.0, "c", 160 * i - i % 2 * 160, 160 * i + 9, "+-"[i % 4 == 3], 0, 0) for i in range(40_000)]
    rows += [(1, "c_0_frame+0", 1, "AC", 1e-6, 0.0, "c", 3_200_000, 3_200_009, s, 0, 0) for s in "+-"]
    kept, turns = mo.deduped(spark.createDataFrame(rows, MOTIF))
    sizes = [x["count"] for x in asm.near_islands(kept, asm.AssembleParams(), turns).groupBy("contig_id", "island").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 10_000


def test_islands_are_folded_as_a_stream(spark):
    """No Python group an island: its cost was most of an annotation's time."""
    df = table_of(spark, 9, contigs=2, length=10)
    for whole in (False, True):
        plan = asm.assemble(df, whole=whole)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "InPandas" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    """A table in files that are many shares of a task, on a session of 4 shuffle partitions."""
    monkeypatch.setattr(mo, "SHARE", 1 << 10)
    table_of(spark, 11, contigs=60).write.parquet(str(tmp_path / "m"))
    return spark.read.parquet(str(tmp_path / "m"))


def test_seeds_are_dealt_by_the_size_of_the_input(spark, stored):
    """With the session's partitions alone a task's memory grew with the table; and each lead was made for each test of a word."""
    kept, turns = mo.deduped(stored)
    plan = plan_of(mo.mark_seeds(mo.keyed(mo.with_turns(stored, whole=True)), mo.by("contig_id"), 500))
    assert plan.count(" AS __m1") + plan.count(" AS __m2") == 2 and plan.count("lead(") == 6
    seeds = mo.with_seeds(kept, table=turns)
    assert seeds.rdd.getNumPartitions() > 8
    key = ["contig_id", "dna_start", "motif_id", "strand", "frame", "protein_sequence"]
    want = mo.mark_seeds(mo.keyed(mo.with_turns(kept, whole=True)), mo.by("contig_id"), 500)
    assert sorted(map(tuple, seeds.select(*key, "seed_length").collect())) == sorted(map(tuple, want.select(*key, "seed_length").collect()))


def test_dedup_sorts_once(spark, stored):
    """Windows whose keys are expressions each sorted the rows anew, and held them twice in a task."""
    for whole in (False, True):
        kept = mo.dedup_adjacent(stored, whole=whole)
        plan = plan_of(kept)
        assert plan.count("Sort [contig_id") - whole <= 1
        got = {}
        for x in kept.collect():
            got.setdefault(x.contig_id, []).append((x.strand, x.dna_start, x.motif_id, x.frame, x.protein_sequence))
        assert {c: sorted(v) for c, v in got.items()} == {c: sorted(v) for c, v in walked(stored)[0].items()}
    assert mo.dedup_adjacent(stored).rdd.getNumPartitions() > 8


def test_ranks_are_dealt_by_the_size_of_the_input(spark, stored):
    ranks = mo.rank_motifs(stored)
    assert ranks.rdd.getNumPartitions() > 8 and "SortMergeJoin" not in plan_of(ranks)
    w = Window.partitionBy("contig_id").orderBy(*mo.order_columns())
    assert ranks.withColumn("n", F.row_number().over(w)).filter("n <> motif_rank").count() == 0 and ranks.count() == stored.count()


def test_folds_are_dealt_by_the_size_of_the_input(spark, stored):
    """Motifs are few bytes, so that adaptive execution put the windows and folds of a large input into few tasks."""
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        kept = mo.dedup_adjacent(stored, whole=True)
        loci = asm.assemble(kept, whole=True)
        assert plan_of(kept).count("REPARTITION_BY_NUM") == 1 and plan_of(loci).count("REPARTITION_BY_NUM") == 2
        found = {}
        for x in loci.orderBy("contig_id", "locus_no").collect():
            found.setdefault(x.contig_id, []).append([(m.motif_id, m.dna_start, m.strand) for m in x.motifs])
        assert found == walked(stored)[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_alignment_deals_its_windows_and_folds(spark, monkeypatch):
    from locusforge import queries

    monkeypatch.setattr(mo, "SHARE", 1 << 12)
    assert plan_of(queries.q_nbarc_alignment(spark, "/root/testdata/sf0.001")).count("REPARTITION_BY_NUM") >= 2


@pytest.mark.parametrize("what", ["dedup_adjacent", "rank_motifs", "with_seeds"])
def test_tasks_do_not_hang_on_adaptive_execution(spark, stored, what):
    """With more shuffle partitions in the session than tasks by size, these were put together again into tasks that grew with the table."""
    turns = mo.turns(stored)
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        out = {"dedup_adjacent": mo.dedup_adjacent, "rank_motifs": mo.rank_motifs, "with_seeds": lambda x: mo.with_seeds(x, table=turns)}[what](stored)
        assert plan_of(out).count("REPARTITION_BY_NUM") == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_contigs_take_few_windows(spark, stored):
    """In a contig's order only its turn has neighbours of two strands: windows that look for the turn were most of those over contigs."""
    plan = plan_of(asm.assemble(mo.dedup_adjacent(stored, whole=True), whole=True))
    assert "fore" not in plan and plan.count("lead(") <= 4
