"""Connected components of an edge table by alternating stars; nothing comes to the driver but sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _contract(batches):
    """Union-find over each batch of edges: a batch leaves as stars, which saves rounds."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(a):
            continue
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = list(range(len(nodes)))

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        n = len(a)
        for x, y in zip(at[:n].tolist(), at[n:].tolist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        root = np.array([find(x) for x in range(len(nodes))])
        keep = root != np.arange(len(nodes))
        yield shared.batch_of(_EDGES, {"a": nodes[keep], "b": nodes[root[keep]]})


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't a root itself; root is the component's smallest node.

    Hot nodes: a node's minimum is a partial aggregate, and the join that hands it to its edges can be split by AQE.
    """
    now = shared.staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").mapInArrow(_contract, "a long, b long"), name)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = shared.staged(small.unionByName(first.select("a", F.col("m").alias("b"))).distinct(), name)
        sums = _sums(now)
        if sums == seen or not sums[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sums
