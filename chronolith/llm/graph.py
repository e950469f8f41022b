"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready, remove, written

#: Twice the logarithm of any real graph's longest path; never reached in practice.
MAX_ROUNDS = 60
#: Links that one task connects at the end: 16 MB of ids, whatever the graph was.
LAST_LINKS = 1 << 20


def components(links: DataFrame, a: str = "a", b: str = "b", last: int = LAST_LINKS) -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest
    node id reachable.  Alternates large-star and small-star rounds, which keep
    the number of links linear and end after a logarithmic number of rounds; once
    ``last`` links or fewer are there, one task connects them.

    Nulls and self links are ignored; repeated links count once; no links give
    an empty result.  Minima are pre-aggregated before the shuffle, and the
    joins are ones that adaptive execution can split when one node is hot.
    """
    e = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e, path = written(e, "cc")
    before = _state(e)
    for _ in range(MAX_ROUNDS):
        if before[0] <= last:
            return _connected(e)
        nxt, new_path = written(_small_star(_large_star(e)), "cc")
        after = _state(nxt)
        remove(e.sparkSession, path)
        e, path = nxt, new_path
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def least_reachable(u, v):
    """The nodes of the links (u, v), in order, and the smallest that each reaches."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(u):
        lo, hi = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = lo != hi
        u, v = u[apart], v[apart]
        np.minimum.at(root, hi[apart], lo[apart])  # roots all; each goes below a smaller one
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _connected(e: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            node, least = least_reachable(*(np.concatenate(x) for x in zip(*parts)))
            for i in range(0, len(node), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65_536]) for x in (node, least)], ["node", "component"])

    ready(e.sparkSession)
    return e.coalesce(1).mapInArrow(run, "node long, component long")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
