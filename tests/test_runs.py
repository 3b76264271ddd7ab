"""Whole runs: command line, checkpoint, streaming, the driver's entry point."""

import ast
import gzip
import pathlib
import subprocess

import duckdb
import pytest

from locusforge import cli, rules
from locusforge.plans.annotate import Params, annotate_contigs, resume
from locusforge.plans.outputs import motif_tsv_lines
from locusforge.queries import ORACLES, QUERIES, cassette
from locusforge.sources.motif_table import parse_motifs
from locusforge.streaming import scan_stream

ROOT = pathlib.Path(__file__).parent.parent
SMALL = "/root/testdata/sf0.001"


def genome():
    own = cassette()
    back = own.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    return f">chr1 one\n{'ACGT' * 300}{own}{'TTGA' * 500}\n>chr2\n{back.lower()}{'N' * 50}\n>chr3\n{'A' * 400}\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_command_line(spark, tmp_path, zipped, capsys):
    fa = tmp_path / "g.fa"
    fa.write_bytes(gzip.compress(genome().encode()) if zipped else genome().encode())
    args = ["-i", str(fa), "-p", str(tmp_path / "o"), "-f", str(fa), str(tmp_path / "loci.fa"), "10", "-c", str(tmp_path / "m.tsv"), "--stats", str(tmp_path / "s.tsv"), "--plot", str(tmp_path / "plots"), "--summary", "--checkpoint", str(tmp_path / "ck"), "--progress", "off", "--log-level", "error"]
    assert cli.main(args) == 0
    said = capsys.readouterr().out
    assert "sequences\t2" in said and "complete NLR\t2" in said
    names = ["o.nlr.txt", "o.nlr.gff", "o.nlr.bed", "o.motifs.bed", "o.nbarc.fasta", "loci.fa", "m.tsv", "s.tsv"]
    before = {n: (tmp_path / n).read_bytes() for n in names}
    report = before["o.nlr.txt"].decode().splitlines()
    assert [x.split("\t")[0] for x in report] == ["chr1", "chr2"] and [x.split("\t")[5] for x in report] == ["+", "-"]
    assert (tmp_path / "plots" / "01-motif-counts.png").read_bytes().startswith(b"\x89PNG")
    assert before["loci.fa"].decode().splitlines()[0].startswith(">chr1_nlr1 chr1 ")
    assert cli.main(args) == 0  # from the checkpoint
    assert {n: (tmp_path / n).read_bytes() for n in names} == before


def test_exit_codes(tmp_path):
    assert cli.main(["-i", str(tmp_path / "none.fa")]) == 1
    fa = tmp_path / "g.fa"
    fa.write_text(">a\nAC\n")
    assert cli.main(["-i", str(fa), "--log-level", "loud"]) == 1
    assert cli.main(["-i", str(fa), "-o", str(tmp_path / "no" / "dir" / "x"), "--progress", "off", "--log-level", "error"]) == 3


def contigs(spark):
    parts = [x.split("\n", 1) for x in genome()[1:].split("\n>")]
    return spark.createDataFrame([(i, h.split()[0], "", s.replace("\n", "")) for i, (h, s) in enumerate(parts)], "contig_idx bigint, contig_id string, description string, sequence string")


def keyed(df):
    return sorted(tuple(r) for r in df.drop("motifs").collect())


def test_fragments_do_not_change_loci(spark):
    whole = annotate_contigs(contigs(spark))
    cut = annotate_contigs(contigs(spark), params=Params(fragment_length=1200, overlap=700, spread=5))
    assert {(r.contig_id, r.start_pos, r.end_pos) for r in cut.loci.collect()} == {(r.contig_id, r.start_pos, r.end_pos) for r in whole.loci.collect()}
    again = resume(parse_motifs(motif_tsv_lines(whole.motifs).selectExpr("line AS value")))
    assert keyed(again.loci) == keyed(whole.loci)


def test_stream(spark, tmp_path):
    for i in range(3):
        contigs(spark).filter(f"contig_idx = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        scan_stream.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert keyed(scan_stream.loci(spark, str(tmp_path / "out")).loci) == keyed(annotate_contigs(contigs(spark)).loci)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, ((*(r[c] for c in names),) for r in df.collect()))) == sorted(map(repr, map(tuple, cur.fetchall())))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_llm():
    for path in (ROOT / "locusforge").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


def test_repository_stays_small():
    size = subprocess.run(["du", "-sk", str(ROOT / ".git")], capture_output=True, text=True).stdout.split()
    assert not size or int(size[0]) < 30_000
    assert len(rules.RANK) == 20
