"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

The least and the greatest id of a hash stand for the count of its documents. A document loses lines by position. Hashes
of very many lines are looked up in a broadcast table, the others by a shuffle join: so a line that a third of all
documents hold is never dealt to one task.

Defined cases: a null or empty text is one empty line; a null id takes no part (its lines are neither counted nor
dropped); rows that share an id are one document for the counts and are each rewritten by their own text; other columns
pass through, but for columns named n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, BROADCAST_ROWS, ascii_lower, materialize, scratch

#: A hash is hot from so many lines on (more in a corpus of over HOT_LINES * BROADCAST_ROWS lines, so that hot hashes stay few enough to broadcast).
HOT_LINES = 2_000


def _lines(text: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hash(key: Column) -> tuple[Column, Column]:
    """128 bits, so that a corpus of 1e12 lines has no chance collision."""
    return F.xxhash64(key), F.xxhash64(F.lit("locusforge"), key)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, th, drop): the positions, from 0, of the lines that each document loses; th: hash of the text."""
    key = _key(F.col("line"))
    lines = (
        docs.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(_lines(text_col)).alias("at", "line"))
        .select("id", "th", "at", key.alias("key"))
        .filter(F.length("key") >= min_chars)
    )
    h1, h2 = _hash(F.col("key"))
    lines = lines.select("id", "th", "at", h1.alias("h1"), h2.alias("h2"))
    shared = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last").drop("last")
    shared = materialize(shared, "shared-lines")
    # at most BROADCAST_ROWS / 2 hashes can have more lines than this
    most = max(HOT_LINES, 2 * (shared.agg(F.sum("n")).first()[0] or 0) // BROADCAST_ROWS)
    hot = shared.filter(F.col("n") > most).select("h1", "h2", F.col("first").alias("hot"))
    cold = shared.filter(F.col("n") <= most).select("h1", "h2", "first")
    # a line of a hot hash brings its answer along and meets nothing in the join below, under a key of its own
    own = F.when(F.col("hot").isNull(), F.col("h1")).otherwise(F.xxhash64("id", "th", "at"))
    looked = lines.join(F.broadcast(hot), ["h1", "h2"], "left").select("id", "th", "at", "hot", own.alias("h1"), F.when(F.col("hot").isNull(), F.col("h2")).alias("h2"))
    found = looked.join(cold, ["h1", "h2"], "left").filter(F.col("id") > F.coalesce("hot", "first"))
    return found.groupBy("id", "th").agg(F.collect_set("at").alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with the text rewritten and the columns n_lines, n_dropped added."""
    with scratch() as tables:
        gone = dropped_lines(docs, id_col, text_col, min_chars).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("drop").alias("__drop"))
        gone = tables.keep(materialize(gone, "dropped-lines"))
    lines = _lines(text_col)
    joined = docs.join(gone, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left")
    # the positions that stay, in order
    stay = F.expr("transform(array(__lines), l -> transform(array_except(sequence(0, size(l) - 1), __drop), i -> l[i]))[0]")
    joined = joined.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(stay))
    out = joined.withColumns({"__text": F.when(F.col("__drop").isNull(), F.coalesce(text_col, F.lit(""))).otherwise(F.array_join("__kept", "\n")), "n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long")})
    return out.withColumn(text_col, F.col("__text")).drop("__id", "__th", "__drop", "__lines", "__kept", "__text")


def digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, h.first IS NOT NULL AND k.doc_id <> h.first AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
