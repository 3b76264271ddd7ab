"""Pairs of a group whose ends are not yet in one component: every one of them is compared, however large the group.

A group of up to MEMBERS members and WEIGHT weight is one block. In a larger one each component beyond a block has blocks
of its own, the other components share blocks, and each block meets every block but those of its own large component. So
a task holds two blocks at a time, and a crowd that is already one component costs nothing. What comes out of two blocks
is at most a spanning forest of the links found in them, so the output grows with the members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialize

#: A block's members, and the sum of their weights (words or shingles: 8 bytes each).
MEMBERS, WEIGHT = 1024, 1 << 19


class Forest:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        a, b = self.root(x), self.root(y)
        self.up[a] = b
        return a != b


def unjoined(members: DataFrame, over: int) -> DataFrame:
    """members(region, node, comp, weight): the same with the block pair (lo, hi) and whether the row is of its first block, one row a block pair; only of regions of over `over` members in two components or more."""
    sizes = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    blocks = F.ceil(F.greatest(F.col("n") / MEMBERS, F.col("w") / WEIGHT)).cast("int")
    large = blocks > 1
    part = lambda c: F.sum(F.when(large, 0).otherwise(F.col(c)))
    regions = sizes.groupBy("region").agg(
        F.count(F.lit(1)).alias("comps"),
        F.sum("n").alias("size"),
        F.ceil(F.greatest(part("n") / MEMBERS, part("w") / WEIGHT)).cast("int").alias("pool"),
        F.collect_list(F.when(large, F.struct("comp", blocks.alias("blocks")))).alias("large"),
    )
    regions = materialize(regions.filter(f"comps > 1 AND size > {over}").select("region", "pool", "large"), "unjoined")
    # `large` has an entry for each component beyond a block: a thousand members stand behind each, so rows are narrow
    regions = few(regions)
    block = "named_struct('large', {}, 'comp', {}, 'k', {})"
    pool = f"if(pool > 0, transform(sequence(0, greatest(pool, 1) - 1), k -> {block.format('0', '0L', 'k')}), array())"
    own = f"flatten(transform(large, x -> transform(sequence(0, x.blocks - 1), k -> {block.format('1', 'x.comp', 'k')})))"
    own_of = "filter(large, x -> x.comp = comp)"
    rows = members.join(regions, "region").withColumn("own", F.expr(f"get({own_of}, 0).blocks"))
    rows = rows.withColumn("mine", F.expr(f"if(own IS NULL, {block.format('0', '0L', 'cast(pmod(xxhash64(node), greatest(pool, 1)) AS int)')}, {block.format('1', 'comp', 'cast(pmod(xxhash64(node), greatest(own, 1)) AS int)')})"))
    met = F.expr(f"explode(filter(concat({pool}, {own}), o -> NOT (o.large = 1 AND mine.large = 1 AND o.comp = mine.comp)))")
    return rows.select("region", "node", "comp", "mine", met.alias("other")).select("region", "node", "comp", F.expr("least(mine, other)").alias("lo"), F.expr("greatest(mine, other)").alias("hi"), F.expr("mine <= other").alias("one"))


def met(rows: DataFrame, load: str, near: Callable[[pa.Array, np.ndarray, np.ndarray], Iterator[tuple[int, int]]]) -> DataFrame:
    """rows of unjoined() with a column `load` -> (a, b), a < b: links between components that join all members whom near(loads, i, j) links; i, j are the places of pairs in loads, and near gives the linked ones."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                m = batch.column("m")[at].values
                one, node, comp = (m.field(c).to_numpy(zero_copy_only=False) for c in ("one", "node", "comp"))
                i, j = np.triu_indices(len(node), 1) if one.all() else (x.ravel() for x in np.meshgrid(np.flatnonzero(one), np.flatnonzero(~one), indexing="ij"))
                apart = comp[i] != comp[j]
                i, j = i[apart], j[apart]
                if len(i):
                    forest = Forest(len(node))
                    _, first, where = np.unique(comp, return_index=True, return_inverse=True)
                    for x, y in enumerate(first[where].tolist()):  # what is one component needs no further link
                        forest.join(x, y)
                    kept = [(x, y) for x, y in near(m.field("load"), i, j, forest) if forest.join(x, y)]
                    if kept:
                        a, b = node[[x for x, _ in kept]], node[[y for _, y in kept]]
                        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    groups = rows.groupBy("region", "lo", "hi").agg(F.collect_list(F.struct("one", "node", "comp", F.col(load).alias("load"))).alias("m")).select("m")
    return groups.mapInArrow(judge, "a long, b long").distinct()
