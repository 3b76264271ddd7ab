"""Language ID by compression: a text belongs to the language whose zstandard raw-content dictionary makes it smallest.

A text is cut into pieces of PIECE bytes, each compressed on its own with every language's dictionary, and the sizes are
summed over the whole text: so a long text is judged by the dictionaries to its end and not by its own repetitions.

Defined cases: a null text or one without a letter is `und` with score 0; where no language could be learned, all are
`und`; equal sizes go to the language that sorts first, with score 0; a margin under MARGIN is rejected (identify()
then gives null, the query's digest still names the nearest language and marks it in `rejected`).
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold
from .sampling import language_sample
from .scoring import with_columns

#: Bound of the training sample: whole texts a language, and bytes of them together.
SAMPLE_TEXTS, SAMPLE_BYTES = 96, 144_000
PIECE, LEVEL, MARGIN = 4096, 6, 0.01

_plain = re.compile(r"[\W\d_]+").sub


def plain(text: str) -> bytes:
    """What is compressed: lower case, letters only, single spaces between words."""
    return _plain(" ", text.lower()).encode()


class Compressors:
    """Made anew in each Python worker: a compressor can't be pickled."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries, self.ready = dictionaries, None

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.dictionaries, self.ready = state, None

    def sizes(self, text: str) -> list[int]:
        if self.ready is None:
            self.ready = []
            for k in sorted(self.dictionaries):
                d = zstandard.ZstdCompressionDict(self.dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        data = plain(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(f(p)) for p in pieces) for f in self.ready]


def fit(docs: DataFrame) -> Compressors:
    return Compressors({k: plain("\n".join(v)) for k, v in language_sample(docs, SAMPLE_TEXTS, SAMPLE_BYTES).items()})


def identify(docs: DataFrame, model: Compressors, text_col: str = "text") -> DataFrame:
    """docs with lang_near, lang_pred (null where rejected), score and rejected."""
    names = sorted(model.dictionaries)

    def score(column: pa.Array) -> list:
        near, margins = [], []
        for text in column.to_pylist():
            if not names or text is None or not any(map(str.isalpha, text)):
                near.append("und")
                margins.append(0.0)
                continue
            sizes = model.sizes(text)
            order = sorted(range(len(names)), key=lambda i: (sizes[i], i))
            near.append(names[order[0]])
            margins.append(1 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0)
        return [near, margins]

    out = with_columns(docs, score, [T.StructField("lang_near", T.StringType()), T.StructField("score", T.DoubleType())], text_col)
    rejected = (F.col("lang_near") != "und") & (F.col("score") < MARGIN)
    return out.withColumn("rejected", rejected).withColumn("lang_pred", F.when(~F.col("rejected"), F.col("lang_near")))


def digest(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("lang_near").alias("lang_pred"), "score", "rejected")
