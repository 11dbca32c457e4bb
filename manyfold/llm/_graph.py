"""Connected components: inside arrays by numpy, over a cluster by alternating star operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, mark, stage


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every node of the links (a[i], b[i])."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        on = ra != rb
        if not on.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[on], b[on], ra[on], rb[on]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a and b, long, no nulls), component
    being the smallest node reachable.

    Alternating large-star and small-star operations (Kiveris et al., 2014). A round is two joins
    on the nodes' minimum, which Spark computes with partial aggregates; the side with a hub's
    many rows is the one that adaptive execution may split. Each round is written to the shared
    folder, so lineage stays short. It ends when a round changes nothing.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    began = mark()
    edges, before = stage(spark, edges, "links"), None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if before == now or not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
        before = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "w")
        small = large.join(low, F.col("hi") == F.col("w"))
        small = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("w", "m")).distinct()
        edges = stage(spark, small, "stars")
        drop(spark, began, keep=[edges])
    raise RuntimeError("components did not settle; raise the number of rounds")
