"""Counts of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contig_counts(motifs: DataFrame, loci: DataFrame) -> DataFrame:
    """(contig_id, motifs, loci, complete); contigs with motifs and no locus are kept."""
    a = motifs.groupBy("contig_id").agg(F.count(F.lit(1)).alias("motifs"))
    b = loci.groupBy("contig_id").agg(F.count(F.lit(1)).alias("loci"), F.count_if("is_complete").alias("complete"))
    return a.join(b, "contig_id", "left").select("contig_id", "motifs", F.coalesce("loci", F.lit(0)).alias("loci"), F.coalesce("complete", F.lit(0)).alias("complete"))


def motif_counts(motifs: DataFrame) -> DataFrame:
    return motifs.groupBy("motif_id").agg(F.count(F.lit(1)).alias("n"))


def global_counts(motifs: DataFrame, loci: DataFrame) -> DataFrame:
    """(sequences, motifs, loci, complete): sequences are contigs with motifs. A sum over the contigs' counts, so both tables are read once."""
    return contig_counts(motifs, loci).agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("motifs"), F.lit(0)).alias("motifs"), F.coalesce(F.sum("loci"), F.lit(0)).alias("loci"), F.coalesce(F.sum("complete"), F.lit(0)).alias("complete"))


def stats_lines(motifs: DataFrame, loci: DataFrame) -> DataFrame:
    """(line) of the statistics file, in order but for its header."""
    total = global_counts(motifs, loci)
    names = {"sequences": "sequence_count", "motifs": "motif_total", "loci": "nlr_total", "complete": "nlr_complete"}
    first = total.select(F.explode(F.array(*[F.struct(F.lit(0).alias("section"), F.lit(i).alias("n"), F.lit("").alias("key"), F.concat(F.lit(f"global\t{name}\t"), F.col(c).cast("string")).alias("line")) for i, (c, name) in enumerate(names.items())])).alias("x")).select("x.*")
    per = contig_counts(motifs, loci).select(F.lit(1).alias("section"), F.lit(0).alias("n"), F.col("contig_id").alias("key"), F.concat_ws("\t", F.lit("chromosome"), "contig_id", *[F.col(c).cast("string") for c in ("motifs", "loci", "complete")]).alias("line"))
    kinds = motif_counts(motifs).select(F.lit(2).alias("section"), F.col("motif_id").alias("n"), F.lit("").alias("key"), F.concat(F.lit("motif\tmotif_"), F.col("motif_id").cast("string"), F.lit("\t"), F.col("n").cast("string")).alias("line"))
    return first.union(per).union(kinds).orderBy("section", "n", "key").select("line")
