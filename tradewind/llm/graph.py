"""Connected components by stars: every round joins each node's larger neighbours, then its smaller ones, to the smallest (Kiveris et al.).

Rounds end when all edges are such stars, after a number of rounds that grows with the logarithm of the graph. Callers
contract what a task knows to stars first (``contracted``), which saves rounds. Each round is written to the shared folder. The minima are written before they are joined, so that a node with many neighbours is split by Spark's skew join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.shared import stored


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a task as stars: every node but the smallest of its group, and that one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for i, j in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        parent[max(i, j)] = min(i, j)
    for i, p in enumerate(parent):  # parents are smaller, so theirs are final
        parent[i] = parent[p]
    least = np.array(parent, np.int64)
    rest = least != np.arange(len(nodes))
    return nodes[rest], nodes[least[rest]]


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) of every node of (a, b) with another one; the component is the smallest node."""
    one_way = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(one_way.distinct(), f"{folder}/round-0")
    step = 0
    while not _are_stars(edges):
        step += 1
        here = f"{folder}/round-{step}"
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{here}-large-minima")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, f"{here}-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), f"{here}-small-minima")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), here)
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionAll(members.select(F.col("component").alias("node"), "component").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a smaller node that has none itself."""
    n = edges.agg(F.count("*"), F.count_distinct("a")).first()
    return n[0] == n[1] and edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
