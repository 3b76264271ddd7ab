import gzip

import pytest
from pyspark.sql import functions as F

from locusforge.functions import registry
from locusforge.functions import sequence as seq
from locusforge.operators import fragments, scan
from locusforge.sources import fasta


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first().x


def test_codons_and_frames(spark):
    for codon, aa in {"ATG": "M", "TAA": "*", "GGG": "G", "NNN": "X", "ATN": "X"}.items():
        assert one(spark, seq.translate_dna(F.col("s")), s=codon) == aa
    frames = one(spark, seq.six_frames(F.col("s")), s="ATGAAATT")
    assert [(f.strand, f.frame, f.protein) for f in frames][:3] == [("+", 0, "MK"), ("+", 1, "*N"), ("+", 2, "EI")]
    kernel = [(s, f, scan._SHOWN[p].tobytes().decode()) for s, f, p in scan.six(b"ATGAAATTNAC")]
    assert kernel == [(f.strand, f.frame, f.protein) for f in one(spark, seq.six_frames(F.col("s")), s="ATGAAATTNAC")]
    assert [f.protein for f in one(spark, seq.six_frames(F.col("s")), s="")] == [""] * 6


def test_small_functions(spark):
    assert one(spark, seq.reverse_complement(F.col("s")), s="ATGCNn") == "nNGCAT"
    assert one(spark, seq.is_dna(F.col("s")), s="") is False
    assert one(spark, seq.is_dna(F.col("s")), s="ACGTEE") is True
    assert one(spark, seq.fasta_record(F.col("a"), F.col("b"), F.col("c")), a="x", b="", c="AC") == ">x\nAC\n"
    for n in (1, 100, 101, 200):
        assert one(spark, seq.wrapped(F.col("s")), s="A" * n).count("\n") == -(-n // 100)
    a, b = seq.fragment_of(F.col("s"))
    row = spark.createDataFrame([("chr_1_400_frame-2",)], ["s"]).select(a.alias("a"), b.alias("b"), seq.frame_of(F.col("s"))[0].alias("c"), seq.frame_of(F.col("s"))[1].alias("d")).first()
    assert tuple(row) == ("chr_1", 400, "-", 2)


def brute_chop(s, length, overlap):
    out, at = [], 0
    while s:
        out.append((at, s[at : at + length].upper()))
        if at + length >= len(s):
            return out
        at += length - overlap
    return out


@pytest.mark.parametrize("length,overlap", [(4, 2), (5, 1), (7, 0), (20, 19)])
def test_chop(spark, length, overlap):
    words = ["", "A", "acgtACGTAC", "ACGTACGTACGT", "AAAAAAAAAA", "ACGTN" * 9]
    rows = fragments.chop(spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(words)], "contig_id string, sequence string"), length, overlap).collect()
    for i, s in enumerate(words):
        want = brute_chop(s, length, overlap)
        assert sorted((r.frag_offset, r.frag) for r in rows if r.contig_id == f"c{i}") == want
        assert list(fasta.cut(iter([s[:3], s[3:]]), length, overlap)) == want
    with pytest.raises(ValueError):
        fragments.chop(spark.createDataFrame([("a", "b")], "contig_id string, sequence string"), 5, 5)


TEXT = b"junk\n>chr1  first  one\r\nACGT\r\nacgt\r\n\n>>chr2\nAC GT\n>empty\n>chr3 d\nNNNN"


def test_fasta(spark, tmp_path):
    plain, zipped = tmp_path / "a.fa", tmp_path / "b.fa"
    plain.write_bytes(TEXT)
    zipped.write_bytes(gzip.compress(TEXT[:30]) + gzip.compress(TEXT[30:]))
    want = [("chr1", "first one", "ACGTacgt"), ("chr2", "", "AC GT"), ("empty", "", ""), ("chr3", "d", "NNNN")]
    for path in (plain, zipped):
        rows = fasta.read_fasta(spark, str(path)).orderBy("contig_idx").collect()
        assert [(r.contig_id, r.description, r.sequence) for r in rows] == want
    for size in (1, 7, 30, 1000):  # any byte ranges give each record once
        fasta.register(spark)
        rows = spark.read.format("fasta").option("rangeBytes", size).load(str(plain)).orderBy("contig_idx").collect()
        assert [(r.contig_id, r.sequence) for r in rows] == [(a, c) for a, _, c in want]
    frags = fasta.read_fragments(spark, str(plain), 4, 2).collect()
    assert sorted((r.frag_offset, r.frag) for r in frags if r.contig_id == "chr1") == brute_chop("ACGTacgt", 4, 2)
    body = tmp_path / "c.fa"
    body.write_bytes(TEXT[5:])
    rows = fasta.read_fasta_text(spark, str(body)).orderBy("contig_idx").collect()
    assert [(r.contig_id, r.description, r.sequence) for r in rows] == want
    for empty in (b"", b">chr1", b">chr1\n"):
        (tmp_path / "d.fa").write_bytes(empty)
        assert fasta.read_fragments(spark, str(tmp_path / "d.fa"), 4, 2).count() == 0


def test_sql_functions(spark):
    registry.register(spark)
    r = spark.sql("SELECT revcomp('ATGCNn') a, translate_frame('ATGAAATT', '+', 1) b, domain_string(array(13, 1, 7, 9)) c, has_signature(array(1, 6, 4, 5)) d, has_signature(array(1, 2, 3)) e").first()
    assert tuple(r) == ("nNGCAT", "*N", "TIR-NBARC-LRR", True, False)
    assert [tuple(x) for x in spark.sql("SELECT * FROM chop('ACGTACGTAC', 4, 2) ORDER BY 1").collect()][:2] == [(0, "ACGT"), (2, "GTAC")]
    assert spark.sql("SELECT * FROM six_frames('ATGAAATT')").count() == 6
