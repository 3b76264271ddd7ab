"""Report files as tables of lines, and a writer for them.

Every function gives a DataFrame whose `line` column, in the order of its other columns, is the file without its header.
write_lines() streams it partition by partition to one local file: the driver holds one partition at a time.
"""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge import rules
from locusforge.functions import loci as fn
from locusforge.functions.sequence import reverse_complement, wrapped

LABEL = "locusforge"
# Header lines of GFF and BED files (here, in gff_header and BED_HEADERS).
GFF_COLUMNS = "#seqname\tsource\tfeature\tstart\tend\tscore\tstrand\tframe\tattribute"
# Fixed value: the reference row of the NB-ARC alignment, padded to 165 columns.
ALIGNMENT_REFERENCE = ">NP_001021202.1\nFLHGRAGSGKSVIASQALSKS-----------------------------TLFVFDDVVQEETIRLRLRCLVTTRDVEISNAASQ" + "-" * 80


def _tabs(*parts: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


def report_lines(loci: DataFrame) -> DataFrame:
    return loci.select("contig_id", "locus_no", _tabs("contig_id", "name", "domains", "start_pos", "end_pos", "strand", "motif_list").alias("line"))


def gff_header(date: str | None = None, label: str = LABEL) -> list[str]:
    return ["##gff-version 2", f"##source-version {label} V1.0", f"##date {date or datetime.now(UTC).strftime('%Y-%m-%d')}", "##Type DNA", GFF_COLUMNS]


def gff_lines(loci: DataFrame, complete_only: bool = False, label: str = LABEL) -> DataFrame:
    rows = loci.filter("is_complete") if complete_only else loci
    return rows.select("contig_id", "locus_no", _tabs("contig_id", F.lit(label), F.lit("NBSLRR"), F.col("start_pos") + 1, "end_pos", F.lit("."), "strand", F.lit("."), F.concat(F.lit("name="), "name", F.lit(";nlrClass="), "domains")).alias("line"))


def bed_lines(loci: DataFrame) -> DataFrame:
    m = F.col("motifs")
    sizes, starts = fn.blocks(m, F.col("strand"), F.col("start_pos"))
    return loci.select("contig_id", "locus_no", _tabs("contig_id", "start_pos", "end_pos", "name", F.lit(0), "strand", "start_pos", "end_pos", fn.bed_colour(m), F.size(m), sizes, starts).alias("line"))


BED_HEADERS = {"bed": ['#track name="NLR_Loci"', '#itemRgb="On"'], "motif_bed": ['#track name="NLR_Motifs"', '#itemRgb="On"']}


def motif_bed_lines(motifs: DataFrame, annotate_stop: bool = False) -> DataFrame:
    row = _tabs("contig_id", "dna_start", "dna_end", F.concat(F.lit("motif_"), F.col("motif_id").cast("string")), fn.format_double(F.col("pvalue")), "strand", "dna_start", "dna_end", rules.lookup(rules.COLOUR, F.col("motif_id")))
    rows = [row]
    if annotate_stop:
        rows.append(F.when(F.contains("protein_sequence", F.lit("*")), _tabs("contig_id", "dna_start", "dna_end", F.lit("STOP"), F.lit(0), "strand", "dna_start", "dna_end", F.lit("0,0,0"))))
    return motifs.select("contig_id", F.col("strand") == "-", "dna_start", "motif_id", "frag_offset", F.posexplode(F.array_compact(F.array(*rows))).alias("n", "line"))


def motif_tsv_lines(motifs: DataFrame) -> DataFrame:
    dna = F.when(F.col("contig_id").isNull(), F.lit("\t\t\t\t")).otherwise(_tabs("contig_id", "dna_start", "dna_end", "strand", "frame"))
    row = _tabs(F.concat(F.lit("motif_"), F.col("motif_id").cast("string")), "protein_sequence_id", "position", "protein_sequence", fn.format_double(F.col("pvalue")), fn.format_double(F.col("score")), dna)
    return motifs.select("contig_id", F.col("strand") == "-", "dna_start", "motif_id", "frag_offset", row.alias("line"))


def alignment_lines(loci: DataFrame) -> DataFrame:
    rows = loci.filter("is_complete").withColumn("aligned", fn.alignment(F.col("motifs"))).filter("aligned IS NOT NULL")
    return rows.select("contig_id", "locus_no", F.concat(F.lit(">"), "name", F.lit("\n"), "aligned").alias("line"))


def locus_sequences(loci: DataFrame, contigs: DataFrame, flank: int = 0) -> DataFrame:
    """(contig_idx, locus_no, name, header, sequence): each locus with its flanks, reverse-complemented on the reverse strand, in the contigs' order."""
    ends = loci.select("name", "contig_id", "locus_no", "strand", "motif_list", F.greatest(F.col("start_pos") - flank, F.lit(0)).alias("s"), (F.col("end_pos") + flank).alias("stop"))
    # contigs holding no locus never meet the join's output, and a contig is sliced as bytes: a text slice is counted from its start
    rows = ends.join(contigs.select("contig_idx", "contig_id", F.col("sequence").cast("binary").alias("b")), "contig_id").withColumn("e", F.least("stop", F.length("b").cast("bigint"))).filter("s < e")
    piece = F.expr("cast(substring(b, cast(s + 1 AS int), cast(e - s AS int)) AS string)")
    shown = rows.withColumn("piece", piece).withColumn("sequence", F.when(F.col("strand") == "-", reverse_complement(F.col("piece"))).otherwise(F.col("piece")))
    header = F.concat(F.lit(">"), "name", F.lit(" "), "contig_id", F.lit(" "), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"), F.lit(" strand:"), "strand", F.lit(" "), "motif_list")
    return shown.select("contig_idx", "locus_no", "name", header.alias("header"), "sequence")


def locus_fasta_lines(loci: DataFrame, contigs: DataFrame, flank: int = 0) -> DataFrame:
    rows = locus_sequences(loci, contigs, flank)
    return rows.select("contig_idx", "locus_no", F.concat("header", F.lit("\n"), F.regexp_replace(wrapped(F.col("sequence")), r"\n$", "")).alias("line"))


def ordered(lines: DataFrame) -> DataFrame:
    keys = [F.col(f"`{c}`") for c in lines.columns if c != "line"]
    return lines.orderBy(*keys) if keys else lines


def write_lines(lines: DataFrame, path: str, header: list[str] | None = None) -> str:
    """One ordered local file, written whole or not at all."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as f:
        for h in header or []:
            f.write(h + "\n")
        for row in ordered(lines).select("line").toLocalIterator():
            f.write(row.line + "\n")
    os.replace(part, path)
    return path


#: Files that a prefix gives.
SUFFIXES = {"report": ".nlr.txt", "gff": ".nlr.gff", "bed": ".nlr.bed", "motif_bed": ".motifs.bed", "alignment": ".nbarc.fasta"}


def resolve(prefix: str | None, **explicit: str | None) -> dict[str, str]:
    """Paths of the wanted files: an explicit one wins over the prefix's."""
    out = {k: explicit.get(k) or (prefix + s if prefix else None) for k, s in SUFFIXES.items()}
    out |= {k: v for k, v in explicit.items() if k not in SUFFIXES}
    return {k: v for k, v in out.items() if v}
