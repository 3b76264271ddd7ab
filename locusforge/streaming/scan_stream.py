"""Streaming scan: contigs arrive as files, motifs are appended; assembly reads the motif table as a batch.

The scan keeps no state between contigs, so there is no watermark. Each file is scanned once (the stream's checkpoint
remembers it), and a stopped stream leaves the batches it committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from locusforge.operators.fragments import chop
from locusforge.operators.motifs import dedup_adjacent
from locusforge.operators.scan import scan_fragments
from locusforge.plans.annotate import Params, Result
from locusforge.schemas import CONTIG, MOTIF
from locusforge.sources.config import Motifs, synthetic


def stream_motifs(spark: SparkSession, contig_dir: str, motifs: Motifs | None = None, params: Params = Params()) -> DataFrame:  # noqa: B008
    """A streaming DataFrame of motifs from Parquet files of contigs."""
    contigs = spark.readStream.schema(CONTIG).parquet(contig_dir)
    return scan_fragments(chop(contigs, params.fragment_length, params.overlap), motifs or synthetic())


def start(spark: SparkSession, contig_dir: str, out_dir: str, checkpoint: str, motifs: Motifs | None = None, params: Params = Params()) -> StreamingQuery:  # noqa: B008
    return stream_motifs(spark, contig_dir, motifs, params).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out_dir)


def loci(spark: SparkSession, out_dir: str, params: Params = Params()) -> Result:  # noqa: B008
    from locusforge.operators.assemble import assemble

    table = dedup_adjacent(spark.read.schema(MOTIF).parquet(out_dir))
    return Result(table, assemble(table, params.assemble))
