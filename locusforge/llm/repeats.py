"""Substring dedup by paragraph MinHash banding.

A paragraph here is a sentence: a line cut at sentence ends, for passages are often glued into lines; a sentence of over
LONG words is cut again after words that their own hash picks. Runs of one word count as one word. Paragraphs of at
least 7 words (with fewer, no two different shingle sets reach 0.75) get BANDS bands of ROWS minhashes on 5-word
shingles: a pair at 0.75 collides with probability 1 - (1 - 0.75**2)**8 = 0.9987. In each band key the paragraphs meet
the least and the greatest paragraph of the key, the pair is verified by exact Jaccard on full shingle sets; then all
pairs of the key that verified links leave in different components are compared exactly, in pairs of blocks (across.py).
Verified links are clustered by components.

Equal paragraphs are one class at once, however their hosts are punctuated: a text is also cut into exact pieces, by its
words alone. In every window of PICK words the word of least hash ends a piece, so a shared span of PASSAGE words holds
equal pieces of 20 words or more, whatever stands around it.

A piece repeats if two documents hold it, a paragraph if its cluster is in two documents or more. Adjoining repeats are
a run. A run of at least RUN words is a candidate: it is extended by PICK words at both ends, and every window of PASSAGE
words that another document's candidate holds word by word is a passage, to the word. Of a run of SURE words or more all
repeats are passages, and so are those of a run of PASSAGE words that holds a paragraph with near copies; there, windows
only find the exact ends, and windows from inside such runs are looked up for the others' sake alone (a Bloom filter
keeps those that may be wanted). A document loses the passages that a smaller id holds too.

Defined cases: null, empty and blank texts have no paragraphs; a null id takes no part; repeats within one document
stay; rows that share an id are one document for what repeats, and are each cut by their own text; an empty table gives
an empty result; other columns pass through remove_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import across
from . import textarrays as ta
from .common import few, materialize, scratch, sieve
from .components import components
from .near_dedup import PERCENT, confirmed

LONG, PICK = 40, 16
BANDS, ROWS = 8, 2
LEAST_WORDS, RUN, PASSAGE = 7, 20, 50
SURE = PASSAGE + 2 * PICK

_ENDS = np.zeros(256, bool)
_ENDS[[0x2E, 0x21, 0x3F]] = True  # . ! ?


class Parts:
    """Stretches of words that cover the texts of a batch: first word, words, text, first word's place in the text, hash."""

    def __init__(self, words: np.ndarray, first: np.ndarray, stop: np.ndarray):
        n = len(words)
        self.first = np.flatnonzero(np.append(True, stop[:-1])) if n else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, n))
        self.text = np.searchsorted(first, self.first, side="right") - 1
        self.at = self.first - first[self.text]
        self.hash = spans_hash(words, self.first, self.size)


def spans_hash(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    up, down = ta._powers_to(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return ta.mix((total[first + size] - total[first]) * down[first] + size.astype(np.uint64)).view(np.int64)


class Texts:
    """The words of a batch of texts, runs of one word as one word; `first`: each text's first word."""

    def __init__(self, part: pa.RecordBatch):
        self.data, self.offs = ta.texts(part.column("text"))
        self.starts, self.ends, self.first = ta.spans(self.data, self.offs)
        words = ta.word_hashes(self.data, self.starts, self.ends)
        keep = np.append(True, words[1:] != words[:-1])[: len(words)]
        keep[self.first[:-1][self.first[:-1] < len(words)]] = True
        self.words, self.starts, self.ends = words[keep], self.starts[keep], self.ends[keep]
        self.first = np.concatenate([[0], np.cumsum(keep)])[self.first]

    def _stops(self) -> np.ndarray:
        stop = np.zeros(len(self.words), bool)
        stop[self.first[1:][self.first[1:] > 0] - 1] = True
        return stop

    def paragraphs(self) -> Parts:
        stop, n = self._stops(), len(self.words)
        if n:
            stop |= _ENDS[self.data[self.ends - 1]]
            lines = np.cumsum(self.data == 10)
            stop[:-1] |= lines[self.starts[1:]] != lines[self.ends[:-1] - 1]
            begin = np.flatnonzero(np.append(True, stop[:-1]))
            size = np.diff(np.append(begin, n))
            stop |= (np.repeat(size, size) > LONG) & (self.words % np.uint64(PICK) == 0)
        return Parts(self.words, self.first, stop)

    def pieces(self) -> Parts:
        stop = self._stops()
        if len(self.words) >= PICK:
            order = ta.mix(self.words ^ np.uint64(ta._BASE))
            least = np.lib.stride_tricks.sliding_window_view(order, PICK).argmin(axis=1) + np.arange(len(order) - PICK + 1)
            text = np.searchsorted(self.first, np.arange(len(order)), side="right")
            whole = text[: len(least)] == text[PICK - 1 :]
            stop[least[whole]] = True
        return Parts(self.words, self.first, stop)

    def grams(self, p: Parts) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hash at each word, the paragraphs long enough to have near copies)."""
        weights = ta._weights(5)
        g = np.zeros(max(0, len(self.words) - 4), np.uint64)
        for j in range(5):
            g += self.words[j : j + len(g)] * weights[j]
        return ta.mix(g), np.flatnonzero(p.size >= LEAST_WORDS)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.chunks(batch, "text"):
            p = Texts(part).pieces()
            text = pa.array(p.text)
            yield pa.record_batch([part.column("id").take(text), part.column("th").take(text), pa.array(p.at, pa.int32()), pa.array(p.size, pa.int32()), pa.array(p.hash)], ["id", "th", "at", "n", "h"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = ta.hash_family(BANDS * ROWS, 1)
    for batch in batches:
        for part in ta.chunks(batch, "text"):
            t = Texts(part)
            p = t.paragraphs()
            g, wide = t.grams(p)
            if not len(wide):
                continue
            cuts = np.stack([p.first[wide], p.first[wide] + p.size[wide] - 4], 1).ravel()
            keys = []
            padded = np.append(g, np.uint64(0))
            for band in range(BANDS):
                key = np.full(len(wide), band + 1, np.uint64)
                for row in range(band * ROWS, (band + 1) * ROWS):
                    key = ta.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(padded * a[row] + b[row], cuts)[::2])
                keys.append(key.view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.tile(p.hash[wide], BANDS))], ["key", "h"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.chunks(batch, "text"):
            t = Texts(part)
            p = t.paragraphs()
            g, wide = t.grams(p)
            g = g.view(np.int64)
            size = p.size[wide] - 4
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            flat = g[np.repeat(p.first[wide] - offsets[:-1], size) + np.arange(offsets[-1])] if len(wide) else g[:0]
            text = pa.array(p.text[wide])
            yield pa.record_batch([part.column("id").take(text), part.column("th").take(text), pa.array(p.at[wide], pa.int32()), pa.array(p.size[wide], pa.int32()), pa.array(p.hash[wide]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "th", "at", "n", "node", "set"])


def _near(sets: pa.Array, i: np.ndarray, j: np.ndarray, forest: across.Forest) -> Iterator[tuple[int, int]]:
    """The pairs of sets that reach the threshold, exactly; shingles of one set alone can't be shared."""
    size = np.diff(sets.offsets.to_numpy())
    _, at, held = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = held > 1
    place, keep = np.cumsum(shared) - 1, shared[at]
    owner, column = np.repeat(np.arange(len(sets)), size)[keep], place[at[keep]]
    both = np.zeros(len(i), np.int64)
    for begin in range(0, int(shared.sum()), 8192):  # so many shingles at a time: a bounded matrix
        on = (column >= begin) & (column < begin + 8192)
        has = np.zeros((len(sets), min(8192, int(shared.sum()) - begin)), np.float32)
        has[owner[on], column[on] - begin] = 1
        both += (has @ has.T)[i, j].astype(np.int64)
    for k in np.flatnonzero(100 * both >= PERCENT * (size[i] + size[j] - both)).tolist():
        yield int(i[k]), int(j[k])


def _links(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified links (u, v) between different paragraphs, (id, th, at, n, node) of every paragraph that met another): the two stars of each key first, then all pairs these leave apart."""
    rows = base.select("text").mapInArrow(_bands, "key long, h long")
    live = materialize(rows.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least < most"), "bands")
    rows = base.select("text").mapInArrow(sieve(_bands, "key", live.select("key")), "key long, h long")
    met = materialize(rows.join(few(live), "key").distinct(), "met")
    ends = F.explode(F.array(F.struct(F.col("least").alias("a"), F.col("h").alias("b")), F.struct(F.col("h").alias("a"), F.col("most").alias("b"))))
    pairs = materialize(met.select(ends.alias("p")).select("p.a", "p.b").filter("a < b").distinct(), "pairs")
    need = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "need")
    held = base.mapInArrow(sieve(_sets, "node", need), "id long, th long, at int, n int, node long, set array<long>")
    held = materialize(held.join(few(need), "node", "left_semi"), "held")
    sets = materialize(held.select("node", "set").dropDuplicates(["node"]).select("node", F.array_distinct("set").alias("set")), "sets")
    stars = materialize(confirmed(pairs, sets), "links")
    comp = few(components(stars).withColumnRenamed("node", "h"))
    members = met.join(comp, "h", "left").select(F.col("key").alias("region"), F.col("h").alias("node"), F.coalesce("comp", "h").alias("comp"), F.lit(LONG).alias("weight"))
    rest = across.unjoined(members, 3).join(sets, "node")  # in a key of three, the stars are all pairs
    return stars.union(materialize(across.met(rest, "set", _near).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")), held.drop("set")


def _windows(inside: bool):
    """Hashes of the windows of PASSAGE words in each candidate run and PICK words around it: of those inside long runs, or of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "text"):
                t = Texts(part)
                spans = []  # (text, first place of a window, one past the last)
                for i, own in enumerate(part.column("runs").to_pylist()):
                    low, high = t.first[i], t.first[i + 1]
                    for r in own:
                        a, b = max(low, low + r["a"] - PICK), min(high, low + r["b"] + PICK) - PASSAGE + 1
                        if r["b"] - r["a"] >= SURE:
                            left, right = low + r["a"] + 1, low + r["b"] - PASSAGE
                            spans += [(i, left, right)] if inside else [(i, a, left), (i, right, b)]
                        elif not inside:
                            spans.append((i, a, b))
                spans = np.array(spans, np.int64).reshape(-1, 3)
                size = np.maximum(spans[:, 2] - spans[:, 1], 0)
                total = np.concatenate([[0], np.cumsum(size)])
                places = np.repeat(spans[:, 1] - total[:-1], size) + np.arange(total[-1])
                which = np.repeat(spans[:, 0], size)
                text = pa.array(which)
                yield pa.record_batch([part.column("id").take(text), part.column("th").take(text), pa.array(places - t.first[which], pa.int32()), pa.array(spans_hash(t.words, places, np.full(len(places), PASSAGE)))], ["id", "th", "at", "g"])

    return run


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, at, n, keeper, removed): repeated passages, n words from word `at` on; th: hash of the text; keeper: least document that holds it."""
    base = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    with scratch() as tables:
        return tables.keep(materialize(_repeats(base), "repeats"))


def _repeats(base: DataFrame) -> DataFrame:
    units = materialize(base.mapInArrow(_units, "id long, th long, at int, n int, h long"), "units")
    equal = materialize(units.groupBy("h").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).filter("keeper < last").drop("last"), "repeating")
    rows = units.mapInArrow(sieve(iter, "h", equal.select("h")), units.schema).join(few(equal), "h").select("id", "th", "at", "n", "keeper", F.lit(0).alias("near"))
    links, held = _links(base)
    if not links.isEmpty():
        found = held.join(few(components(links)), "node")
        clusters = found.groupBy("comp").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).filter("keeper < last").drop("last")
        rows = rows.union(found.join(few(materialize(clusters, "clusters")), "comp").select("id", "th", "at", "n", "keeper", F.lit(1).alias("near")))
    along = Window.partitionBy("id", "th").orderBy("at", "n", "near", "keeper")
    rows = rows.groupBy("id", "th", "at", "n", "near").agg(F.min("keeper").alias("keeper"))  # equal rows are one
    reached = F.max(F.col("at") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.coalesce(F.col("at") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("run").over(along))
    rows = materialize(rows, "runs")
    runs = rows.groupBy("id", "th", "run").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("n")).alias("b"), F.max("near").alias("near")).filter(f"b - a >= {RUN}")
    runs = materialize(runs, "candidates")
    own = runs.groupBy(F.col("id").alias("i"), F.col("th").alias("t")).agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    ids = few(materialize(runs.select("id").distinct(), "ids"))
    texts = base.join(ids, "id", "left_semi").dropDuplicates(["id", "th"])
    texts = materialize(texts.join(own, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t"))).select("id", "th", "text", "runs"), "texts")
    form = "id long, th long, at int, g long"
    windows = materialize(texts.mapInArrow(_windows(False), form), "windows")
    grams = materialize(windows.select("g").distinct(), "grams")
    inner = materialize(texts.filter(f"exists(runs, r -> r.b - r.a >= {SURE})").mapInArrow(sieve(_windows(True), "g", grams), form), "inner")
    windows = windows.union(inner)
    shared = few(materialize(windows.groupBy("g").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).filter("keeper < last").drop("last"), "shared"))
    hits = windows.join(shared, "g").select("id", "th", "at", "keeper").distinct()
    exact = hits.withColumn("k", F.col("at") - F.row_number().over(Window.partitionBy("id", "th", "keeper").orderBy("at"))).groupBy("id", "th", "keeper", "k").agg(F.min("at").alias("at"), (F.max("at") - F.min("at") + PASSAGE).alias("n"))
    close = runs.filter(f"b - a >= {SURE} OR near = 1 AND b - a >= {PASSAGE}").select("id", "th", "run")
    found = rows.join(few(materialize(close, "passages")), ["id", "th", "run"], "left_semi").select("id", "th", "at", "n", "keeper").union(exact.select("id", "th", "at", "n", "keeper"))
    return found.select("id", "th", "at", "n", "keeper", (F.col("id") > F.col("keeper")).alias("removed"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.chunks(batch, "text"):
            t = Texts(part)
            out = part.column("text").to_pylist()
            for i, gone in enumerate(part.column("gone").to_pylist()):
                if gone:
                    # word k's stretch of bytes ends where word k + 1 begins
                    edge = np.append(t.starts[t.first[i] : t.first[i + 1]] - t.offs[i], t.offs[i + 1] - t.offs[i])
                    edge[0] = 0
                    drop = np.zeros(len(edge) - 1, bool)
                    for r in gone:
                        drop[r["at"] : r["at"] + r["n"]] = True
                    raw = out[i].encode()
                    out[i] = b"".join([raw[a:b] for a, b, d in zip(edge.tolist(), edge[1:].tolist(), drop.tolist(), strict=False) if not d]).decode()
            yield pa.record_batch([part.column("row"), pa.array(out, pa.string())], ["row", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeats of an earlier document's passage. Only texts that lose something go through Python."""
    gone = repeated_paragraphs(docs, id_col, text_col).filter("removed").groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("at", "n")).alias("__gone"))
    names = docs.columns
    joined = docs.join(gone, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left").drop("__id", "__th")
    cut = joined.filter("__gone IS NOT NULL").select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text"), F.col("__gone").alias("gone"))
    cut = cut.mapInArrow(_cut, T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType())]))
    cut = cut.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names])
    return joined.filter("__gone IS NULL").select(*[F.col(f"`{c}`") for c in names]).union(cut)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: how much repeats, the documents it repeats, and the least document that shared passages lead to."""
    with scratch() as tables:
        passages = repeated_paragraphs(docs)
        count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        per = passages.groupBy("id").agg(F.count(F.lit(1)).alias("n_repeated"), F.sum(F.col("removed").cast("long")).alias("n_removed"), F.sum(F.when(F.col("removed"), F.col("n")).otherwise(0)).alias("words_removed"), F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("keeper")))).alias("repeats_of"))
        comp = components(passages.select(F.col("keeper").alias("u"), F.col("id").alias("v")).distinct())
        least = comp.groupBy("comp").agg(F.min("node").alias("component_id"))
        per = per.join(comp.join(least, "comp").select(F.col("node").alias("id"), "component_id"), "id", "left")
        out = docs.select("doc_id").join(per, F.col("doc_id") == F.col("id"), "left")
        out = out.select("doc_id", count("n_repeated"), count("n_removed"), count("words_removed"), F.coalesce("repeats_of", F.array().cast("array<long>")).alias("repeats_of"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("n_removed", F.lit(0)) == 0).alias("kept"))
        return tables.keep(materialize(out, "digest"))
