"""Command line: `python -m locusforge.cli -i genome.fa -p out`. Exit codes: 1 bad input, 2 run failure, 3 write failure."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from locusforge import plot
from locusforge.plans import outputs, report
from locusforge.plans.annotate import Params, annotate
from locusforge.sources import config, fasta

log = logging.getLogger("locusforge")
LEVELS = {"trace": logging.DEBUG, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("locusforge", description="Annotates immune-receptor loci in a genome.")
    p.add_argument("-i", dest="input", required=True, help="genome FASTA, plain or gzip")
    p.add_argument("-x", dest="pwm", help="position weight matrices (default: built-in, synthetic)")
    p.add_argument("-y", dest="cdf", help="p-value tables (default: built-in, synthetic)")
    p.add_argument("-o", dest="report", help="loci report")
    p.add_argument("-g", dest="gff", help="loci GFF")
    p.add_argument("-b", dest="bed", help="loci BED")
    p.add_argument("-m", dest="motif_bed", help="motif BED")
    p.add_argument("-a", dest="alignment", help="NB-ARC alignment FASTA")
    p.add_argument("-f", dest="loci", nargs=3, metavar=("GENOME", "OUT", "FLANK"), help="sequences of the loci")
    p.add_argument("-c", dest="export", help="motif table")
    p.add_argument("-p", "--output-prefix", dest="prefix", help="prefix of the report, GFF, BED, motif BED and alignment files")
    p.add_argument("-t", dest="threads", type=int, help="local threads (default: all; ignored on a cluster)")
    p.add_argument("-n", dest="batch", type=int, default=1000, help="fragments in an Arrow batch")
    p.add_argument("--checkpoint", help="folder for the motif table")
    p.add_argument("--tmpdir", help="Spark's local folder")
    p.add_argument("--progress", default="auto", choices=["auto", "bar", "simple", "off"])
    p.add_argument("--stats", help="statistics file")
    p.add_argument("--plot", help="folder for charts")
    p.add_argument("--summary", action="store_true", help="counts of each contig on stdout")
    p.add_argument("--log-level", default="info")
    return p


def validate(args: argparse.Namespace) -> str | None:
    for path in (args.input, args.pwm, args.cdf):
        if path and not os.path.isfile(path):
            return f"no such file: {path}"
    if args.log_level not in LEVELS:
        return f"bad log level: {args.log_level}"
    if args.threads is not None and args.threads < 1 or args.batch < 1:
        return "threads and batch must be at least 1"
    return None


def session(args: argparse.Namespace) -> SparkSession:
    b = SparkSession.builder.appName("locusforge").config("spark.sql.execution.arrow.maxRecordsPerBatch", args.batch).config("spark.ui.showConsoleProgress", str(args.progress in ("bar",) or args.progress == "auto" and sys.stderr.isatty()).lower())
    if "MASTER" not in os.environ:
        b = b.master(f"local[{args.threads or '*'}]")
    if args.tmpdir:
        b = b.config("spark.local.dir", args.tmpdir)
    return b.getOrCreate()


def write(spark: SparkSession, args: argparse.Namespace, result) -> list[str]:
    paths = outputs.resolve(args.prefix, report=args.report, gff=args.gff, bed=args.bed, motif_bed=args.motif_bed, alignment=args.alignment, export=args.export)
    made = {
        "report": lambda: (outputs.report_lines(result.loci), None),
        "gff": lambda: (outputs.gff_lines(result.loci), outputs.gff_header()),
        "bed": lambda: (outputs.bed_lines(result.loci), outputs.BED_HEADERS["bed"]),
        "motif_bed": lambda: (outputs.motif_bed_lines(result.motifs), outputs.BED_HEADERS["motif_bed"]),
        "alignment": lambda: (outputs.alignment_lines(result.loci), [outputs.ALIGNMENT_REFERENCE]),
        "export": lambda: (outputs.motif_tsv_lines(result.motifs), None),
    }
    done = []
    for kind, path in paths.items():
        lines, header = made[kind]()
        done.append(outputs.write_lines(lines, path, header))
    if args.loci:
        genome, out, flank = args.loci
        if not flank.isdigit():
            log.warning("bad flank %r, taken as 0", flank)
        if os.path.isfile(genome):
            done.append(outputs.write_lines(outputs.locus_fasta_lines(result.loci, fasta.read_fasta(spark, genome), int(flank) if flank.isdigit() else 0), out))
        else:
            log.warning("genome %s can't be read, no sequences written", genome)
    if args.stats:
        done.append(outputs.write_lines(report.stats_lines(result.motifs, result.loci), args.stats, ["#section\tkey\tvalue"]))
    if args.plot:
        os.makedirs(args.plot, exist_ok=True)
        kinds = {r.motif_id: r.n for r in report.motif_counts(result.motifs).collect()}
        contigs = report.contig_counts(result.motifs, result.loci)
        done.append(plot.bars(f"{args.plot}/01-motif-counts.png", [kinds.get(i, 0) for i in range(1, 21)]))
        done.append(plot.bars(f"{args.plot}/02-chromosome-nlrs.png", plot.binned((r.loci for r in contigs.orderBy("contig_id").toLocalIterator()), contigs.count()), (44, 160, 44)))
    return done


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if bad := validate(args):
        print(f"error: {bad}", file=sys.stderr)
        return 1
    logging.basicConfig(level=LEVELS[args.log_level], format="%(levelname)s %(message)s")
    if not any((args.report, args.gff, args.bed, args.motif_bed, args.alignment, args.loci, args.export, args.prefix, args.stats, args.plot, args.summary)):
        log.warning("no output asked for")
    began = time.time()
    try:
        spark = session(args)
        motifs = config.load(spark, args.pwm, args.cdf)
        params = Params(checkpoint=args.checkpoint, spread=2 * spark.sparkContext.defaultParallelism)  # a chromosome's fragments come from one task
        log.info("input %s, fragments of %d overlapping by %d", args.input, params.fragment_length, params.overlap)
        st = os.stat(args.input)
        result = annotate(fasta.read_fragments(spark, args.input, params.fragment_length, params.overlap), motifs, params, f"{os.path.abspath(args.input)} {st.st_size} {st.st_mtime_ns}")
        result.motifs.persist(StorageLevel.DISK_ONLY)
        result.loci.persist(StorageLevel.DISK_ONLY)
        totals = report.global_counts(result.motifs, result.loci).first()
    except Exception:
        log.exception("run failed")
        return 2
    try:
        done = write(spark, args, result)
    except Exception:
        log.exception("writing failed")
        return 3
    if args.summary:
        print("#chromosome\tmotifs\tnlrs\tcomplete")
        for r in report.contig_counts(result.motifs, result.loci).orderBy("contig_id").toLocalIterator():
            print(f"{r.contig_id}\t{r.motifs}\t{r.loci}\t{r.complete}")
    print(f"# {outputs.LABEL} done\nsequences\t{totals.sequences}\nNLR loci\t{totals.loci}\ncomplete NLR\t{totals.complete}\nelapsed\t{time.time() - began:.2f}s")
    print("output files:\n" + "\n".join(f"  {p}" for p in done) if done else "output files\t(none)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
