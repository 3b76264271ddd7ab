"""MinHash near-dedup with an LSH forest.

Each distinct shingle set (an exact class: copies collapse here, before anything is paired) has 128 minhashes. Tree t
orders the sets by the first 64 of them rotated to start at component 3t. Sets that share the first 3 components in a
tree are a region. A region of more than REGION sets is cut again at the next depth (9, 27, 64 components), so
dense regions get deep keys and sparse ones shallow keys; at each depth the crowded sets are candidates of the region's
least set too. In a region all pairs are compared by signature, in order of likeness (the order of common prefixes, over
all components): those likely over the threshold are candidates, except where stronger candidates already connect the
two in WAYS separate ways (so each set keeps its WAYS likeliest partners; a first choice, the rest comes in round three). At the greatest depth the sets hold equal signatures and the star is enough.

Candidates are then confirmed on the full sets, in two rounds: first each set with the partner it shares most regions
with; then every candidate pair that the confirmed links have not yet put in one component. So no candidate is
left unjudged, and copies and large groups of near copies cost one comparison each. Deeper keys lose links, and ways
are made of pairs that may fail on the full sets; so a third round returns to all regions at depth 3: there the full
sets of all members meet in pairs of blocks (across.py), and every pair whose ends are still in different components
is compared by signature and, if likely, on the full sets, in the first tree whose region the two share. So only
confirmed links spare a likely pair its judgement. The work is quadratic in a crowd that stays a little under the
threshold; what is shuffled and what comes out is not: no pair leaves its block unless it is a link.

A pair at exactly 0.75 is missed by all 21 trees at depth 3 with probability (1 - 0.75**3)**21 = 1e-5, and falls under
LIKELY, in regions of three sets or more, with probability 1.4e-5: 2.4e-5 at most together.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a null id is linked with
nothing and kept; rows that share an id are judged by their own text, so that drop_near_duplicates() drops the one and
keeps the other if only one has a copy with a smaller id; equal rows stay or go together; ties do not arise (ids
decide); an empty table gives an empty result; other columns pass through drop_near_duplicates().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import across
from . import textarrays as ta
from .common import few, materialize, scratch
from .components import components

HASHES, TREE_HASHES, STEP = 128, 64, 3
TREES = TREE_HASHES // STEP
DEPTHS = (3, 9, 27, 64)
REGION = 256
#: Share of equal minhashes under which a pair at 0.75 falls with probability 1.4e-5; ways that connect two sets.
LIKELY, WAYS = 0.58, 4
PERCENT = 75


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in ta.chunks(batch, "text"):
        data, offs = ta.texts(part.column("text"))
        starts, ends, first = ta.spans(data, offs)
        yield part, ta.shingle_sets(ta.word_hashes(data, starts, ends), first)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = ta.hash_family(HASHES, 6)
    for batch in batches:
        for part, sets in _sets(batch):
            n, keys, sigs = [], [], []
            for s in sets:
                n.append(len(s))
                keys.append(ta.set_key(s))
                sigs.append(ta.minhash(s, family) if len(s) else None)
            trees = [None if x is None else x[:TREE_HASHES] for x in sigs]
            marks = [None if x is None else (x & 255).astype(np.uint8).tobytes() for x in sigs]
            yield pa.record_batch([part.column("id"), part.column("th"), pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(trees, pa.list_(pa.int32())), pa.array(marks, pa.binary())], ["id", "th", "n", "c1", "c2", "sig", "mark"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, sets in _sets(batch):
            found = list(sets)
            keys = [ta.set_key(s)[0] for s in found]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["node", "set"])


def _at_depth(rows: DataFrame, depth: int, kept: str = "mark") -> DataFrame:
    """rows(node, tree, sig, and the column to keep): the region at this depth."""
    return rows.select("node", "tree", kept, F.expr(f"xxhash64(tree, slice(concat(sig, sig), {STEP} * tree + 1, {depth}))").alias("region"))


def likely_pairs(nodes: np.ndarray, marks: np.ndarray) -> list[tuple[int, int]]:
    """Of a region's sets (at most REGION) the pairs worth confirming, the smaller node first."""
    n = len(nodes)
    i, j = np.triu_indices(n, 1)
    like = np.concatenate([(marks[i[k : k + 8192]] == marks[j[k : k + 8192]]).mean(axis=1) for k in range(0, len(i), 8192)])
    keep = np.flatnonzero(like >= LIKELY)
    keep = keep[np.argsort(-like[keep], kind="stable")]
    forests = [across.Forest(n) for _ in range(WAYS)]  # edge-disjoint: a link that fails doesn't part what it joined
    out = []
    for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
        if any(forest.join(x, y) for forest in forests):  # the first that it joins takes it
            out.append((int(min(nodes[x], nodes[y])), int(max(nodes[x], nodes[y]))))
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = []
        nodes, marks = batch.column("nodes"), batch.column("marks")
        for x, m in zip(nodes, marks, strict=True):
            x = x.values.to_numpy()
            pairs += likely_pairs(x, np.frombuffer(b"".join(m.values.to_pylist()), np.uint8).reshape(len(x), -1))
        yield pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def candidates(classes: DataFrame) -> DataFrame:
    """classes(node, sig, mark, ...) -> (a, b, w), a < b: candidate pairs and the number of regions that put them together."""
    slim = classes.select("node", "sig", "mark")
    rows = slim.select("*", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    parts = []
    for depth in DEPTHS:
        keyed = _at_depth(rows, depth)
        live = materialize(keyed.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"), F.max("node").alias("most")).filter("size > 1"), "regions")
        parts.append(live.filter("size = 2").select(F.col("least").alias("a"), F.col("most").alias("b")))
        wide = few(live.filter("size > 2").drop("most"))
        members = keyed.join(wide, "region")
        item = F.array_sort(F.collect_list(F.struct("node", "mark")))
        together = members.filter(f"size <= {REGION}").groupBy("region").agg(item.alias("m")).select(F.col("m.node").alias("nodes"), F.col("m.mark").alias("marks"))
        parts.append(together.mapInArrow(_near, "a long, b long"))
        if live.filter(f"size > {REGION}").isEmpty():
            break
        crowded = materialize(members.filter(f"size > {REGION}").select("node", "tree", "least"), "crowded")
        parts.append(crowded.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")))
        rows = crowded.select("node", "tree").join(slim, "node")
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.union(p)
    return pairs.filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) whose full sets reach the threshold, as edges (u, v)."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    # sizes first: they bound the similarity, and most pairs fail on them without a look at the sets
    near = both.filter(f"100 * least(size(sa), size(sb)) >= {PERCENT} * greatest(size(sa), size(sb))").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return near.filter(f"100 * both >= {PERCENT} * (size(sa) + size(sb) - both)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _linked(load: pa.Array, i: np.ndarray, j: np.ndarray, forest: across.Forest) -> Iterator[tuple[int, int]]:
    """Of the pairs the linked ones, likeliest first; pairs that links already join, or that share the region of an earlier tree, are passed over."""
    tree = load.field("tree")[0].as_py()
    marks = np.frombuffer(b"".join(load.field("mark").to_pylist()), np.uint8).reshape(len(load), -1)
    keys = load.field("sig").flatten().to_numpy()[: len(load) * TREE_HASHES].reshape(len(load), -1)[:, : STEP * tree]
    at, like = [], []
    for k in range(0, len(i), 8192):
        a, b = i[k : k + 8192], j[k : k + 8192]
        x = (marks[a] == marks[b]).mean(axis=1)
        on = np.flatnonzero(x >= LIKELY)
        on = on[~(keys[a[on]] == keys[b[on]]).reshape(len(on), tree, STEP).all(axis=2).any(axis=1)] if tree else on
        at.append(on + k)
        like.append(x[on])
    at, like = np.concatenate(at), np.concatenate(like)
    at = at[np.argsort(-like, kind="stable")]
    sets = load.field("set")
    edge = sets.offsets.to_numpy()
    flat = sets.values.to_numpy()
    size = np.diff(edge)
    for x, y in zip(i[at].tolist(), j[at].tolist(), strict=True):
        n, m = size[x], size[y]
        if 100 * min(n, m) < PERCENT * max(n, m) or forest.root(x) == forest.root(y):
            continue
        both = np.concatenate([flat[edge[x] : edge[x + 1]], flat[edge[y] : edge[y + 1]]])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        if 100 * shared >= PERCENT * (n + m - shared):
            yield x, y


def unjudged(classes: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between sets that share a region and that confirmed links have not put in one component."""
    slim = classes.select("node", "n", "sig").join(few(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = slim.select("node", "n", "sig", "comp", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    members = rows.select("node", "comp", F.col("n").alias("weight"), F.struct("tree", F.expr(f"xxhash64(tree, slice(concat(sig, sig), {STEP} * tree + 1, {DEPTHS[0]}))").alias("key")).alias("region"))
    rows = across.unjoined(members, 2)  # the one pair of a region of two has been judged
    # a set that is no candidate of any region has no likely partner and needs no set here
    load = F.struct(F.col("region.tree").alias("tree"), "sig", "mark", "set").alias("load")
    found = across.met(rows.join(sets, "node").select("region", "node", "comp", "lo", "hi", "one", load), "load", _linked)
    return found.select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, th (hash of its text), n_shingles, component_id (least id of its component; its own id if linked with nothing)."""
    with scratch() as tables:
        return tables.keep(materialize(_components(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))), "near"))


def _components(base: DataFrame) -> DataFrame:
    rows = materialize(base.mapInArrow(_sign, "id long, th long, n long, c1 long, c2 long, sig array<int>, mark binary"), "signed")
    owned = rows.filter("n > 0 AND id IS NOT NULL")
    classes = materialize(owned.groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("mark").alias("mark")).withColumnRenamed("c1", "node"), "classes")
    pairs = materialize(candidates(classes), "pairs")
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes.select("node", "rep"), "node")
    need = few(materialize(need.select(F.col("rep").alias("id"), F.col("node").alias("want")), "need"))
    sets = base.select("id", "text").join(need.select("id").distinct(), "id").mapInArrow(_expand, "node long, set array<bigint>")
    sets = sets.join(need.select(F.col("want").alias("node")), "node", "left_semi").dropDuplicates(["node"])
    sets = materialize(sets.join(classes.select("node", "sig", "mark"), "node"), "sets")
    # first each set with its closest partner
    closest = pairs.groupBy(F.col("b")).agg(F.max(F.struct("w", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    first = materialize(confirmed(closest, sets), "links")
    comp = components(first)
    of = lambda c, name: comp.select(F.col("node").alias(c), F.col("comp").alias(name))
    rest = pairs.join(closest, ["a", "b"], "left_anti").join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").filter("ca IS NULL OR cb IS NULL OR ca <> cb")
    second = materialize(confirmed(rest, sets), "links")
    if not second.isEmpty():
        comp = components(first.union(second))
    third = materialize(unjudged(classes, comp, sets), "links")
    if not third.isEmpty():
        comp = components(first.union(second).union(third))
    least = classes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = least.join(least.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select(F.col("node").alias("c1"), "component_id")
    out = rows.select("id", "th", "n", F.when(F.expr("n > 0 AND id IS NOT NULL"), F.col("c1")).alias("c1")).join(least, "c1", "left")
    return out.select("id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    c = near_components(docs)
    return c.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id."""
    with scratch() as tables:
        found = near_components(docs, id_col, text_col)
        gone = few(tables.keep(materialize(found.filter("id <> component_id").select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct(), "gone")))
    return docs.join(gone, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left_anti")
