"""The whole annotation: contigs or fragments -> motifs -> loci."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.operators.assemble import AssembleParams, assemble
from locusforge.operators.fragments import chop
from locusforge.operators.motifs import dedup_adjacent, deduped
from locusforge.operators.scan import scan_fragments
from locusforge.schemas import MOTIF
from locusforge.sources.config import Motifs, as_text, synthetic


@dataclass(frozen=True)
class Params:
    fragment_length: int = 20_000
    overlap: int = 5_000
    assemble: AssembleParams = field(default_factory=AssembleParams)
    #: Partitions that fragments are dealt over before the scan; None where the source already deals them.
    spread: int | None = None
    #: Folder for the motif table; a rerun with the same motifs, parameters and input name reads it and skips the scan.
    checkpoint: str | None = None


@dataclass(frozen=True)
class Result:
    motifs: DataFrame
    loci: DataFrame


def fingerprint(motifs: Motifs, params: Params, source: str) -> str:
    text = repr((as_text(motifs), params.fragment_length, params.overlap, source))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def scan(fragments: DataFrame, motifs: Motifs, params: Params) -> DataFrame:
    """Fragments -> deduplicated motifs with coordinates. Dealing by fragment, not by contig, evens out chromosomes of different size."""
    if params.spread:
        fragments = fragments.repartition(params.spread, "contig_id", "frag_offset")
    return dedup_adjacent(scan_fragments(fragments, motifs), whole=True)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def annotate(fragments: DataFrame, motifs: Motifs | None = None, params: Params = Params(), source: str = "") -> Result:  # noqa: B008
    """With a checkpoint the motif table is written once, as Parquet under the run's fingerprint; partial runs leave no _SUCCESS mark and are not read."""
    motifs = motifs or synthetic()
    spark = fragments.sparkSession
    table = None
    if params.checkpoint:
        path = f"{params.checkpoint.rstrip('/')}/motifs-{fingerprint(motifs, params, source)}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            scan(fragments, motifs, params).write.mode("overwrite").parquet(path)
        table = spark.read.schema(MOTIF).parquet(path)
    else:
        table = scan(fragments, motifs, params)
    return Result(table, assemble(table, params.assemble, whole=not params.checkpoint))


def annotate_contigs(contigs: DataFrame, motifs: Motifs | None = None, params: Params = Params(), source: str = "") -> Result:  # noqa: B008
    return annotate(chop(contigs, params.fragment_length, params.overlap), motifs, params, source)


def resume(motif_table: DataFrame, params: AssembleParams = AssembleParams()) -> Result:  # noqa: B008
    """From an imported motif table: order, dedup, assembly."""
    table, turns = deduped(motif_table.filter(F.col("contig_id").isNotNull()))
    return Result(table, assemble(table, params, turns))
