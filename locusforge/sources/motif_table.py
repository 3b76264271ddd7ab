"""Import of exported motif tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.functions.sequence import fragment_of


_COUNT, _ANY = r"\+?\d{1,18}", r"[^\t]*"
_NUMBER = r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))"
#: Six columns with good numbers; then no DNA side (fewer than 11 columns, or no contig), or a good one.
LINE = rf"^(?:motif_)*\+?\d{{1,3}}\t{_ANY}\t{_COUNT}\t{_ANY}\t{_NUMBER}\t{_NUMBER}(?:(?:\t{_ANY}){{0,4}}|\t(?:\t{_ANY}){{4,}}|\t[^\t]+\t{_COUNT}\t{_COUNT}\t{_ANY}\t\+?\d{{1,3}}(?:\t{_ANY})*)$"


def _once(column: Column) -> Column:
    """The column, as a generator's: the optimizer neither copies its expression into each use nor into filters pushed below."""
    return F.explode(F.array(column))


def parse_motifs(lines: DataFrame) -> DataFrame:
    """lines(value) -> motifs. A line needs 6 columns with good numbers; with 11 columns and a contig the DNA side must be good too; other lines are dropped."""
    c = lambda i: F.get(F.col("c"), F.lit(i))
    good = lines.select(_once(F.col("value")).alias("value")).filter(F.col("value").rlike(LINE))
    rows = good.select(_once(F.split("value", "\t", -1)).alias("c")).withColumn("dna", (F.size("c") >= 11) & (c(6) != ""))
    dna = lambda i, kind: F.when(F.col("dna"), c(i).cast(kind))
    _, offset = fragment_of(c(1))
    out = rows.select(
        F.regexp_replace(c(0), "^(motif_)*", "").cast("int").alias("motif_id"), c(1).alias("protein_sequence_id"), c(2).cast("bigint").alias("position"), c(3).alias("protein_sequence"), c(4).cast("double").alias("pvalue"), c(5).cast("double").alias("score"),
        dna(6, "string").alias("contig_id"), dna(7, "bigint").alias("dna_start"), dna(8, "bigint").alias("dna_end"), F.when(F.col("dna") & (c(9) == "-"), "-").otherwise("+").alias("strand"), F.coalesce(dna(10, "int"), F.lit(0)).alias("frame"), offset.alias("frag_offset"),
    )
    return out.filter("motif_id <= 255 AND frame <= 255")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    return parse_motifs(spark.read.text(path))
