import random

import pytest
from pyspark.sql import functions as F

from locusforge import rules
from locusforge.functions import loci as fn
from locusforge.operators import assemble as asm
from locusforge.operators import motifs as mo
from locusforge.plans import outputs, report
from locusforge.schemas import MOTIF
from locusforge.sources.motif_table import parse_motifs


def rows(ms, contig="chr1", strand="+"):
    """(motif, start[, strand[, text]]) -> motif rows."""
    out = []
    for m in ms:
        i, start, s, text = (*m, strand, "AC")[: 2 + 2] if len(m) == 2 else (*m, "AC")[:4]
        out.append((i, f"{contig}_0_frame{s}0", 1, text, 1e-6, 0.0, contig, start, start + 60, s, 0, 0))
    return out


def loci_of(spark, ms, params=asm.AssembleParams()):  # noqa: B008
    return asm.assemble(spark.createDataFrame(rows(ms), MOTIF), params).orderBy("locus_no").collect()


def ids(row):
    return [m.motif_id for m in row.motifs]


def spaced(*motifs):
    return [(m, 1000 + 100 * i) for i, m in enumerate(motifs)]


GOLDEN = [
    (spaced(1, 6, 4), [[1, 6, 4]]),
    ([(1, 1000), (9, 20000)], []),
    (spaced(1, 6, 4, 5, 10), [[1, 6, 6, 4, 4, 5, 5, 10]]),
    (spaced(17, 16, 1, 6, 4, 5, 10, 3, 12, 2, 8, 7, 9, 11, 9), [[17, 16, 1, 6, 6, 4, 4, 5, 5, 5, 10, 10, 10, 3, 3, 3, 12, 12, 12, 2, 2, 2, 8, 8, 7, 9, 11, 9]]),
    (spaced(18, 15, 13, 1, 6, 9), [[18, 15, 13, 1, 6, 9]]),
    ([(1, 5000, "-"), (6, 4900, "-"), (4, 4800, "-"), (9, 4700, "-")], [[1, 6, 4, 9]]),
    ([(1, 1000), (6, 1500)], [[1, 6]]),
    ([(1, 1000), (6, 1501)], []),
    ([(1, 1000), (6, 1100), (4, 1200), (1, 1400), (6, 1500), (4, 1600)], [[1, 6, 4], [1, 6, 4]]),
    ([(1, 1000), (6, 1100), (4, 3600), (5, 6101)], [[1, 6, 4]]),
    ([(1, 1000), (6, 1100), (9, 1300, "+", "A*")], [[1, 6]]),
    ([(1, 1000), (6, 1100), (4, 1300, "+", "A*")], [[1, 6, 4]]),
    (spaced(1, 6, 9, 11, 19, 9), [[1, 6, 9, 11, 19, 9]]),
    (spaced(1, 6, 20, 9), [[1, 6, 20]]),
    ([(13, 4000, "+"), (1, 4100, "-"), (6, 4000, "-")], [[13, 1, 6]]),
]


@pytest.mark.parametrize("ms,want", GOLDEN)
def test_golden(spark, ms, want):
    got = loci_of(spark, ms)
    assert [ids(r) for r in got] == want
    assert [r.name for r in got] == [f"chr1_nlr{i + 1}" for i in range(len(want))]


def test_without_duplicates(spark):
    assert [ids(r) for r in loci_of(spark, spaced(1, 6, 4, 5, 10), asm.AssembleParams(keep_duplicates=False))] == [[1, 6, 4, 5, 10]]


def walked_seeds(ms):
    out = []
    for i in range(len(ms)):
        word = [ms[i][0]]
        for j in range(i + 1, len(ms)):
            if abs(ms[j][1] - ms[j - 1][1]) > 500:
                break
            word.append(ms[j][0])
            if tuple(word) in rules.SEEDS:
                out.append((i, len(word)))
                break
    return out


def test_random_contigs(spark):
    """Islands in Spark against the fold of whole contigs, and seeds against the walk."""
    r = random.Random(11)
    table, want, seeds = [], {}, 0
    for c in range(300):
        contig, ms, at = f"c{c:03d}", [], 0
        words = [s for s in rules.SEEDS] + [rules.NBARC_ORDER]
        while len(ms) < 30:
            at += r.choice([90, 120, 400, 600, 2400, 2600, 9000, 11000])
            strand = r.choice("++-")
            for m in r.choice(words) if r.random() < 0.4 else [r.randrange(1, 21)]:
                at += r.choice([80, 100, 300])
                ms.append((m, at, strand, r.choice(["AC", "AC", "A*"])))
        own = rows(ms, contig)
        table += own
        order = sorted(ms, key=lambda m: (m[2] == "-", -m[1] if m[2] == "-" else m[1], m[0], m[3]))
        want[contig] = [[(order[i][0], order[i][1]) for i in locus] for locus in asm.fold_contig([(a, b, s, "*" in t) for a, b, s, t in order])]
        found = walked_seeds(order)
        seeds += len(found)
    df = spark.createDataFrame(table, MOTIF)
    assert mo.with_seeds(df).filter("seed_length > 0").count() == seeds
    got = {}
    for x in asm.assemble(df).orderBy("contig_id", "locus_no").collect():
        got.setdefault(x.contig_id, []).append([(m.motif_id, m.dna_start) for m in x.motifs])
    assert got == {k: v for k, v in want.items() if v}


def test_dedup_runs(spark):
    for n, kept in ((1, 1), (2, 1), (3, 2), (4, 2), (5, 3)):
        df = spark.createDataFrame(rows([(1, 100)] * n + [(6, 100)]), MOTIF)
        assert mo.dedup_adjacent(df).filter("motif_id = 1").count() == kept
        assert mo.dedup_exact(df).count() == 2


def test_signature_filter(spark):
    df = spark.createDataFrame(rows([(17, 1), (16, 2)], "a") + rows([(1, 1), (2, 2), (6, 3)], "b"), MOTIF)
    assert {r.contig_id for r in mo.signature_filter(df, ["contig_id"], mo.order_columns()).collect()} == {"a"}


def pseudo(spark, ms):
    one = F.array(*[F.struct(F.lit(m).alias("motif_id"), F.lit(t).alias("protein_sequence")) for m, t in ms])
    return spark.range(1).select(one.alias("m"))


def test_locus_functions(spark):
    m = F.col("m")
    assert pseudo(spark, [(13, ""), (1, ""), (7, ""), (9, "")]).select(fn.domain_string(m)).first()[0] == "TIR-NBARC-LRR"
    assert pseudo(spark, [(9, ""), (7, ""), (9, "")]).select(fn.domain_string(m)).first()[0] == "LRR-LRR"
    assert pseudo(spark, [(1, ""), (9, "")]).select(fn.is_complete(m)).first()[0] and not pseudo(spark, [(1, "")]).select(fn.is_complete(m)).first()[0]
    whole = [(i, rules.CONSENSUS[i]) for i in rules.NBARC_ORDER]
    assert pseudo(spark, whole).select(fn.alignment(m)).first()[0] == "".join(rules.CONSENSUS[i] for i in rules.NBARC_ORDER)
    gaps = pseudo(spark, [(17, "Q"), (1, "A*X"), (6, "B"), (6, "B"), (5, "C")]).select(fn.alignment(m)).first()[0]
    assert gaps == "A__B" + "-" * (165 - 21 - 29) and pseudo(spark, [(6, "B")]).select(fn.alignment(m)).first()[0] is None
    for d, text in ((1e-6, "1E-6"), (8.778909458322434e-12, "8.778909458322434E-12"), (0.0, "0.0"), (5.0, "5"), (0.001, "0.001"), (1e7, "1E7"), (0.25, "0.25"), (float("nan"), "NaN"), (float("-inf"), "-Infinity")):
        assert spark.createDataFrame([(d,)], "d double").select(fn.format_double(F.col("d"))).first()[0] == text


def test_outputs(spark, tmp_path):
    ms = [(1, 100, "+", "P"), (6, 227, "+", "H"), (9, 357, "+", "L")]
    table = spark.createDataFrame([(i, "chr1_100_frame+0", p, t, 1e-6, 0.0, "chr1", s, s + 3, "+", 0, 100) for (i, s, _, t), p in zip(ms, (1, 10, 20), strict=True)], MOTIF)
    loci = asm.assemble(table)
    assert [r.line for r in outputs.report_lines(loci).collect()] == ["chr1\tchr1_nlr1\tNBARC-LRR\t100\t360\t+\tmotif_1,motif_6,motif_9"]
    path = outputs.write_lines(outputs.gff_lines(loci), str(tmp_path / "x.gff"), outputs.gff_header("2026-01-02"))
    lines = open(path).read().splitlines()
    assert lines[0] == "##gff-version 2" and len(lines) == 6 and lines[5].split("\t")[2:5] == ["NBSLRR", "101", "360"]
    bed = outputs.bed_lines(loci).first().line.split("\t")
    assert len(bed) == 12 and bed[8] == "0,255,0" and bed[9:] == ["3", "3,3,3", "0,127,257"]
    assert [r.line.split("\t")[4] for r in outputs.motif_bed_lines(table).collect()] == ["1E-6"] * 3
    tsv = outputs.motif_tsv_lines(table).select(F.col("line").alias("value"))
    assert sorted(map(tuple, parse_motifs(tsv).collect())) == sorted(map(tuple, table.collect()))
    assert report.stats_lines(table, loci).count() == 4 + 1 + 3
    assert tuple(report.contig_counts(table, loci).first()) == ("chr1", 3, 1, 1)
    contigs = spark.createDataFrame([(0, "chr1", "", "acgt" * 100), (1, "other", "", "AC")], "contig_idx bigint, contig_id string, description string, sequence string")
    x = outputs.locus_sequences(loci, contigs, 1000).first()
    assert x.header == ">chr1_nlr1 chr1 0-400 strand:+ motif_1,motif_6,motif_9" and x.sequence == "acgt" * 100
    assert outputs.locus_fasta_lines(loci, contigs, 1000).first().line.count("\n") == 4
    assert outputs.resolve("p", report="r") == {"report": "r", "gff": "p.nlr.gff", "bed": "p.nlr.bed", "motif_bed": "p.motifs.bed", "alignment": "p.nbarc.fasta"}


def test_bad_motif_lines(spark):
    good = "motif_1\tx_0_frame+0\t3\tAC\t1E-6\t0.0\tx\t1\t4\t-\t2"
    lines = [good, "motif_1\tx\t3\tAC\t1E-6", "motif_x" + good[7:], good.replace("\t3\t", "\tq\t"), "motif_1\tx_7_frame-1\t3\tAC\t0.5\t1\t\t\t\t\t", good.replace("\t4\t", "\tz\t"), "", "motif_1\tx\t3\tAC\t.5\t1"]
    got = parse_motifs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.contig_id, r.strand, r.frame, r.frag_offset) for r in got] == [("x", "-", 2, 0), (None, "+", 0, 7), (None, "+", 0, 0)]


def test_import_makes_each_line_once(spark):
    """The plan holds the expression of a line once, however often the import looks at it."""
    count = lambda df, word: df._jdf.queryExecution().optimizedPlan().toString().count(word)
    lines = outputs.motif_tsv_lines(spark.createDataFrame(rows([(1, 100), (6, 200)]), MOTIF)).select(F.col("line").alias("value"))
    table = parse_motifs(lines)
    assert count(table, "concat_ws(") == count(lines, "concat_ws(") and count(table, "split(") == 1 and table.count() == 2
