"""Connected components of edges between 64-bit node ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges of one task."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[:len(u)], index[len(u):]
    label = np.arange(len(nodes))
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return nodes, nodes[label]


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (u, v) can reach.

    Alternates large-star and small-star steps, which link every node to the smallest
    neighbour it knows, until nothing changes. Each step keeps at most the number of edges
    and is written before the next, so a lost executor repeats one step only. Neighbours of a
    node are never gathered: the smallest is found by aggregation and joined back.
    """
    edges = stored(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(smallest, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
