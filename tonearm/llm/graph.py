"""Connected components of edges between integer nodes.

Graphs of up to SMALL_EDGES edges (16 bytes each, so a bounded task) are joined up by one task, larger ones contracted
round by round in DataFrame operations; nothing is collected.

Defined results: an edge with a null end is no edge; loops and repeated edges add nothing; no edges, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


SMALL_EDGES = 1_000_000


def _union_find(batches):
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.fromiter(map(find, nodes.tolist()), np.int64, len(nodes)))], names=["node", "root"])


def components(edges: DataFrame, name: str = "components", small: int = SMALL_EDGES) -> DataFrame:
    """edges(a, b) -> (node, root) of every node with an edge; root is the component's smallest node.

    Each round every node points at its smallest neighbour if that is smaller, pointers are followed three times
    over, and the graph is contracted to the nodes pointed at. No edges, no rows.
    """
    edges = common.stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    if edges.count() <= small:
        out = common.stored(edges.coalesce(1).mapInArrow(_union_find, "node long, root long"), name)
        common.drop(edges)
        return out
    mapping = common.stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), name)
    while not common.is_empty(edges):
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        near = common.stored(parent, name)
        parent = near
        for _ in range(3):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        parent = common.stored(parent, name)
        old, mapping = mapping, common.stored(mapping.join(parent.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), name)
        left = edges.join(parent, "a").select(F.col("p").alias("a"), "b")
        right = left.join(parent.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b"))
        done, edges = edges, common.stored(right.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        common.drop(old, near, parent, done)
    common.drop(edges)
    return mapping
