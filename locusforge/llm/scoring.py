"""Adds what a model says of each text, batch by batch, with every other column passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textarrays as ta


def with_columns(docs: DataFrame, score: Callable[[pa.Array], list], fields: list[T.StructField], text_col: str = "text") -> DataFrame:
    """docs with the fields that score(texts) gives as one array a field; a column of the same name is replaced."""
    names = [f.name for f in fields]
    kept = docs.drop(*names)
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, text_col):
                made = [pa.array(x, kind) for x, kind in zip(score(part.column(text_col)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
