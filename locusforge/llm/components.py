"""Connected components by contraction: hook each node to its least neighbour, jump pointers, map the edges, repeat.

Only ids move. A hub of any degree is one row a task before the shuffle (min combines map-side). Each round's tables
are written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in edges(u, v): comp is the same for connected nodes and is one of them. Loops and repeats do no harm; without edges it is empty."""
    labels = None
    now = materialize(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while labels is None or not now.isEmpty():
        both = now.union(now.select("v", "u"))
        parent = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parent")
        jumped = parent
        for _ in range(JUMPS):
            q = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = jumped.join(q, "p").select("u", F.col("pp").alias("p"))
        hop = materialize(jumped, "hop")
        if labels is None:
            new = hop.select(F.col("u").alias("node"), F.col("p").alias("comp"))
        else:
            new = labels.join(hop, labels.comp == hop.u, "left").select("node", F.coalesce("p", "comp").alias("comp"))
        old, labels = labels, materialize(new, "labels")
        a, b = hop.select("u", F.col("p").alias("pu")), hop.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        mapped = now.join(a, "u").join(b, "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        was, now = now, materialize(mapped, "edges")
        for x in (was, parent, hop, *([old] if old is not None else [])):
            drop(x)
    drop(now)
    return labels
