"""Overlapping fragments, translation and coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.operators.scan import shown, six
from locusforge.schemas import PROTEIN


def chop(contigs: DataFrame, length: int = 20_000, overlap: int = 5_000) -> DataFrame:
    """(contig_id, frag_offset, frag_len, frag): the closed form; an empty contig gives nothing.

    The sequence is cut as bytes (a slice of UTF-8 text would be counted from its start each time), and bound once.
    """
    if not 0 <= overlap < length:
        raise ValueError("overlap must be at least 0 and less than the fragment length")
    step = length - overlap
    n = "length(b)"
    last = f"greatest(0, cast(ceil(({n} - {length}) / {step}) AS int))"
    cut = f"transform(array(cast(upper(sequence) AS binary)), b -> transform(sequence(0, {last}), k -> named_struct('o', cast(k AS bigint) * {step}, 's', cast(substring(b, k * {step} + 1, {length}) AS string))))[0]"
    rows = contigs.filter(F.length("sequence") > 0).select("contig_id", F.explode(F.expr(cut)).alias("x"))
    return rows.select("contig_id", F.col("x.o").alias("frag_offset"), F.length("x.s").alias("frag_len"), F.col("x.s").alias("frag"))


def translate_frames(fragments: DataFrame) -> DataFrame:
    """(contig_id, frag_offset, frag_len, strand, frame, protein): six rows a fragment. In numpy, as the scan does it: a lookup a codon costs an interpreted expression ten times as much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, frag in enumerate(batch.column("frag")):
                if not frag.is_valid:
                    continue
                strands, frames, proteins = zip(*((s, f, shown(p)) for s, f, p in six(frag.as_py().encode())), strict=True)
                same = [batch.column(c).take(pa.array([i] * len(frames))) for c in ("contig_id", "frag_offset", "frag_len")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(strands), pa.array(frames, pa.int32()), pa.array(proteins)], ["contig_id", "frag_offset", "frag_len", "strand", "frame", "protein"])

    return fragments.select("contig_id", "frag_offset", "frag_len", "frag").mapInArrow(run, PROTEIN)


def dna_span(strand: Column, frame: Column, offset: Column, frag_len: Column, position: Column, width: Column) -> tuple[Column, Column]:
    """(start, end), 0-based and half open, of a protein match at a 1-based position, on either strand."""
    along = frame + 3 * (position - 1)
    near = F.when(strand == "-", offset + frag_len - along - 3 * width).otherwise(offset + along)
    return near.cast("bigint"), (near + 3 * width).cast("bigint")
