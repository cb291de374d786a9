"""Connected components of an edge table, distributed: no edge list, component or label set reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.frames import checkpointed


def stars(pairs: np.ndarray) -> np.ndarray:
    """(node, least) for every node of the pairs but the least of each component: as connected as the pairs, and the same
    few rows wherever a component is seen whole, so what several tasks find of it falls together."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, before[a], low)  # a component's root hangs on the lower one
        np.minimum.at(label, before[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return np.column_stack([nodes[moved], nodes[label[moved]]])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the component's smallest node.

    Large-star / small-star: each round links every node's larger neighbours, then its smaller ones, to its minimum,
    so the edge set shrinks to one star per component in O(log^2 n) rounds. Minima are partial aggregates, so a hub
    node is no hot group; the joins on it are ordinary joins that adaptive execution can split. Each round is cut by a
    reliable checkpoint. Null ends and loops are dropped; repeated edges count once.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, total = e.count(), None
    while n:
        # large star: every neighbour above a node hangs on the smallest of the node and its neighbours
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lower neighbours hang on the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = checkpointed(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        row = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        e, n = after, int(row["n"])
        if (n, row["s"]) == total:
            break
        total = (n, row["s"])
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
