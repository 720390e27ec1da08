"""Connected components of a distributed graph, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def few_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low, x, y = np.minimum(root[a], root[b]), root[a], root[b]
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def connected_components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that it is connected with.

    Loops and repeated edges are harmless; an empty graph has no rows. Minima are aggregated before they are shuffled and
    joined back; each round's edges go to the shared checkpoint folder. The number of rounds grows with the logarithm of the
    components' size. A node with very many neighbours is a hot key of the joins, whose rows Spark splits (adaptive skew
    joins); it is never collected into one row. Up to few
    different links (longs) are joined by the driver, without rounds.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links, before = cut_lineage(links), None
    if few and links.count() <= few:
        told = links.toArrow()
        nodes, roots = few_components(*(told.column(i).to_numpy().astype(np.int64) for i in (0, 1)))
        return links.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots}), "node long, root long")
    while (now := links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before = now
        if not now[0]:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # large star: a node's larger neighbours turn to the least node next to it
        large = links.select(F.col("b").alias("a"), F.col("a").alias("far")).join(low, "a").select(F.col("far").alias("a"), F.col("low").alias("b")).distinct()
        large = cut_lineage(large)
        # small star: a node and its smaller neighbours turn to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        links = cut_lineage(small.where("a > b").distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
