"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows_a_partition: int = 200_000) -> DataFrame:
    """Rows (node, root) of every node with an edge; root is the least node of its component.

    Each round points neighbours at the least node near them; edges stay as many as nodes and
    links, no neighbourhood is ever collected, and each round is cut by a checkpoint, whose
    partitions are put together by the number of its rows.  Rounds end when all edges lead
    to roots, which have no edge onwards.

    Edges that are no more than one partition holds need no rounds: one task finds their roots,
    and the result, which is as bounded, is marked for broadcast.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).checkpoint()
    if e.count() <= rows_a_partition:
        return F.broadcast(roots_of_few(e).checkpoint())
    while True:
        e = e.coalesce(max(1, min(e.rdd.getNumPartitions(), -(-e.count() // rows_a_partition))))
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        large = large.where("u > v").distinct().checkpoint()
        large = large.coalesce(max(1, min(large.rdd.getNumPartitions(), -(-large.count() // rows_a_partition))))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = small.where("u != v").distinct().checkpoint()
        onward = e.select(F.col("v").alias("n"), F.lit(1).alias("root"), F.lit(0).alias("own")).union(e.select(F.col("u"), F.lit(0), F.lit(1)))
        open_ = onward.groupBy("n").agg(F.max("root").alias("root"), F.sum("own").alias("own")).where("own > 1 or (own > 0 and root > 0)")
        if open_.isEmpty():
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def roots_of_few(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of the edges (u, v), found by one task, which holds them all."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pd.concat(list(batches) or [pd.DataFrame({"u": [], "v": []})])
        node, at = np.unique(both[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        u, v = at.reshape(-1, 2).T
        root = np.arange(len(node))
        while (root[u] != root[v]).any():
            # A root hooks onto the least one across its edges; then all point at roots again.
            low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        if len(node):
            yield pd.DataFrame({"node": node, "root": node[root]})

    return edges.select("u", "v").coalesce(1).mapInPandas(run, f"node {kind}, root {kind}")
