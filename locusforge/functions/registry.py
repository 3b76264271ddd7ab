"""Functions for Spark SQL: revcomp, translate_frame, domain_string, has_signature, and the table functions chop and six_frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from locusforge import rules
from locusforge.operators import scan
from locusforge.sources.fasta import cut


def _revcomp(s: str | None) -> str | None:
    return s and s.translate(str.maketrans("ATGCatgc", "TACGtacg"))[::-1]


def _frame(s: str | None, strand: str, frame: int) -> str | None:
    if s is None or strand not in ("+", "-") or frame not in (0, 1, 2):
        return None
    return scan.shown(scan.translated(scan.strand_bases(s.encode(), strand), frame))


def _domains(ids) -> str:
    out, last = [], None
    for i in ids:
        kind = rules.CATEGORY.get(int(i), "NA")
        if kind != last and kind not in ("NA", "LINKER"):
            out.append(kind)
        last = kind
    return "-".join(out)


@pandas_udf(T.StringType())
def revcomp(s: pd.Series) -> pd.Series:
    return s.map(_revcomp)


@pandas_udf(T.StringType())
def translate_frame(s: pd.Series, strand: pd.Series, frame: pd.Series) -> pd.Series:
    return pd.Series([_frame(a, b, c) for a, b, c in zip(s, strand, frame, strict=True)], dtype=object)


@pandas_udf(T.StringType())
def domain_string(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: None if x is None else _domains(x))


@pandas_udf(T.BooleanType())
def has_signature(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: None if x is None else scan.has_signature([int(i) for i in x]))


@udtf(returnType=T.StructType([T.StructField("frag_offset", T.LongType()), T.StructField("frag", T.StringType())]))
class Chop:
    def eval(self, sequence: str, length: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from cut(iter([sequence or ""]), length, overlap)


@udtf(returnType=T.StructType([T.StructField("strand", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("protein", T.StringType())]))
class SixFrames:
    def eval(self, dna: str) -> Iterator[tuple[str, int, str]]:
        for strand, frame, protein in scan.six((dna or "").encode()):
            yield strand, frame, scan.shown(protein)


def register(spark: SparkSession) -> None:
    for name, f in (("revcomp", revcomp), ("translate_frame", translate_frame), ("domain_string", domain_string), ("has_signature", has_signature)):
        spark.udf.register(name, f)
    spark.udtf.register("chop", Chop)
    spark.udtf.register("six_frames", SixFrames)
