"""Bounded training samples of whole texts. Their bounds are parameters; nothing else in these operators is sampled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: tuple[int, int], bytes_: int) -> list[tuple[str, int]]:
    """At most rows[y] (text, label) of each class y = 0, 1, outside the held-out fold, in a fixed order, of at most bytes_ bytes a class.

    Rows are drawn by the hash of their id, so every part of the table has the same chance; a text that would exceed the
    bytes is not drawn, and no text is cut. Null labels, ids and texts are left out; of rows that share an id one text is
    drawn; an id labelled 0 and 1 may come twice.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), 5) != 0)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    drawn = None
    for y in (0, 1):
        some = usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[y])
        drawn = some if drawn is None else drawn.union(some)
    # at most sum(rows) ids
    found = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("th")).join(F.broadcast(drawn), "doc_id")
    sizes = found.groupBy("doc_id", "y").agg(F.min(F.struct("th", F.octet_length("text").alias("n"))).alias("x")).select("doc_id", "y", "x.*", F.xxhash64("doc_id").alias("order")).collect()
    chosen, held = [], [0, 0]
    for r in sorted(sizes, key=lambda r: (r.order, r.doc_id, r.y)):
        if held[r.y] + r.n <= bytes_:
            held[r.y] += r.n
            chosen.append((r.doc_id, r.y, r.th))
    if not chosen:
        return []
    want = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int, th long").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(F.broadcast(want), ["doc_id", "th"]).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return [(r.text, r.y) for r in sorted(texts.collect(), key=lambda r: (r.doc_id, r.y))]


def language_sample(docs: DataFrame, slots: int, bytes_: int) -> dict[str, list[str]]:
    """At most `slots` whole texts of each non-null language outside the fold 1 of 3, of at most bytes_ bytes together.

    The first pass reads ids and languages only: one row a language and slot, combined before the shuffle. Texts are then
    taken slot by slot; one that would exceed the bytes is left out, and no text is cut.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    h = F.xxhash64("doc_id")
    drawn = usable.groupBy("lang", F.pmod(h, F.lit(slots)).alias("slot")).agg(F.min(h).alias("h")).select(F.col("lang").alias("l"), F.col("h").alias("drawn"))
    near = usable.filter(F.octet_length("text") <= bytes_).select("lang", h.alias("h"), "text").join(F.broadcast(drawn), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("drawn")))
    out: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for r in sorted(near.groupBy("lang", "h").agg(F.min("text").alias("text")).collect(), key=lambda r: (r.lang, r.h)):
        n = held.get(r.lang, 0) + len(r.text.encode())
        if n <= bytes_:
            held[r.lang] = n
            out.setdefault(r.lang, []).append(r.text)
    return out
