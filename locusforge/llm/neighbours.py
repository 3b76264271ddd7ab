"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest of PIVOTS pivots, in order. The index is a table of blocks: a block holds
some thousand vectors, and for each pivot an inverted file of the vectors that have it in their prefix, with PREFIX minus
its rank there. It is posted once and written to the shared folder. A query reads the files of its own PREFIX pivots and
no others: with missing pivots at rank PREFIX, the footrule distance of a query and a vector is a constant minus twice
the sum of min(PREFIX - rank in query, posted value) over the pivots they share. The best SHARE of each block (never
fewer than LEAST) are reranked by exact cosine. A query so reads PREFIX**2 / PIVOTS postings a vector and multiplies out
SHARE of the vectors: for 64 dimensions 3 + 5 operations a vector, against 64 of the exact scan.

Queries are a table of blocks too. Index blocks are dealt over groups, the blocks of queries go to every group, and each
pair of blocks is one row: neither the driver nor a task holds more than some such pairs.

Defined cases: vectors that are null, zero, of another length than most of `vectors`, or hold null or non-finite
components take no part, as candidates or queries; a repeated id is one candidate with its best score and asks once,
with its least vector; fewer candidates than k give all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch

#: Pivots are a sample of the vectors, PIVOTS at most: the bound of what the index is fitted on.
PIVOTS, PREFIX = 512, 40
SHARE, LEAST = 0.08, 256
#: Vectors in a block, and bytes of their components; index blocks in a group.
BLOCK, BLOCK_BYTES, GROUP = 8192, 8 << 20, 4


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def prefixes(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(vectors, PREFIX): the nearest pivots of each, nearest first."""
    near = -(units @ pivots.T)
    n = min(PREFIX, len(pivots))
    some = np.argpartition(near, n - 1, axis=1)[:, :n] if n < len(pivots) else np.tile(np.arange(n), (len(units), 1))
    some.sort(axis=1)  # of equally near pivots the first
    return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def inverted(orders: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, places, values): pivot p's file is places[starts[p]:starts[p + 1]], ascending, with the posted values."""
    flat = orders.ravel()
    by = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[by], np.arange(pivots + 1)).astype(np.int32)
    n = orders.shape[1]
    return starts, (by // n).astype(np.uint16), (n - by % n).astype(np.uint8)


def _blocks(pivots: np.ndarray, post: bool):
    """Batches of (id, v) -> rows of a block: ids, unit vectors, and their inverted files (or, of queries, their prefixes)."""
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * pivots.shape[1])))

    def rows(ids: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        units = _unit(raw)
        orders = prefixes(units, pivots)
        extra = inverted(orders, len(pivots)) if post else (orders.astype(np.int32),)
        return pa.record_batch([pa.array([int(ids[0])]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (ids, units, *extra))], ["block", "ids", "units", *(("starts", "places", "vals") if post else ("orders",))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = np.zeros(0, np.int64), np.zeros((0, pivots.shape[1]))
        for batch in batches:
            if len(batch):
                ids, raw = np.append(ids, batch.column("id").to_numpy()), np.concatenate([raw, _matrix(batch.column("v"))])
            while len(ids) >= size:
                yield rows(ids[:size], raw[:size])
                ids, raw = ids[size:], raw[size:]
        if len(ids):
            yield rows(ids, raw)

    return run


INDEX = "block long, ids binary, units binary, starts binary, places binary, vals binary"


def _nearest(block: dict, asks: dict, dims: int, pivots: int, k: int, share: float, least: int) -> Iterator[tuple[int, int, float]]:
    own, units = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["units"]).reshape(-1, dims)
    starts, places, values = np.frombuffer(block["starts"], np.int32), np.frombuffer(block["places"], np.uint16), np.frombuffer(block["vals"], np.uint8)
    wants, theirs, orders = np.frombuffer(asks["q_ids"], np.int64), np.frombuffer(asks["q_units"]).reshape(-1, dims), np.frombuffer(asks["q_orders"], np.int32)
    orders = orders.reshape(len(wants), -1)
    n = min(len(own), max(least, int(np.ceil(share * len(own)))) + 1)  # the query itself may be one
    weight = np.arange(orders.shape[1], 0, -1).astype(np.uint8)
    for who, ask, order in zip(wants.tolist(), theirs, orders, strict=True):
        files = [(starts[p], starts[p + 1]) for p in order.tolist()]
        where = np.concatenate([places[a:b] for a, b in files])
        value = np.minimum(np.concatenate([values[a:b] for a, b in files]), np.repeat(weight, [b - a for a, b in files]))
        near = np.bincount(where, value, len(own))
        chosen = np.flatnonzero(near >= np.partition(near, len(near) - n)[len(near) - n])
        chosen = chosen[own[chosen] != who]
        score, ids = (units[chosen] * ask).sum(axis=1), own[chosen]
        best: dict[int, float] = {}
        for x in np.lexsort((ids, -score)):  # a repeated id counts once, with its best score
            if len(best) == k:
                break
            best.setdefault(int(ids[x]), float(score[x]))
        for i, s in best.items():
            yield who, i, s


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of queries (rows of the same columns as vectors)."""
    with scratch() as tables:
        return tables.keep(materialize(_search(vectors, queries, k, id_col, vec_col, pivots, share, least), "nearest"))


def _search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, pivots: int, share: float, least: int) -> DataFrame:
    rows = _usable(vectors, id_col, vec_col)
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = most["n"] if most else 1
    rows = rows.filter(F.size("v") == dims)
    drawn = rows.orderBy(F.xxhash64("id"), "id", "v").limit(4 * pivots).collect()
    drawn = list(dict.fromkeys(tuple(r.v) for r in drawn))[:pivots]  # a common vector is one pivot
    index = _unit(np.array(drawn)) if drawn else np.ones((1, dims))
    posted = materialize(rows.mapInArrow(_blocks(index, True), INDEX), "index")
    asked = _usable(queries, id_col, vec_col).filter(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked.mapInArrow(_blocks(index, False), "block long, ids binary, units binary, orders binary"), "queries")
    groups = max(1, -(-posted.count() // GROUP))
    spread = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.col("ids").alias("q_ids"), F.col("units").alias("q_units"), F.col("orders").alias("q_orders"))
    pairs = posted.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(spread, "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                pair = batch.slice(i, 1).to_pylist()[0]
                out = list(_nearest(pair, pair, dims, len(index), k, share, least))
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5).withColumn("rank", F.col("rank").cast("int"))
