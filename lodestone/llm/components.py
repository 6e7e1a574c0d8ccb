"""Connected components of a table of links, by trees of least neighbours and pointer jumping.

Each task first joins the links that it reads anyway, so that in what it hands on a node points to one node of lesser id. Then, in
rounds: each node's least neighbour of lesser id is its parent; a node with several of them leaves the others to point to its
parent; and every link moves up to the parent of its lesser end. Once no node has several, pointers jump until all meet the roots.

No links reach the driver, and no table is broadcast. Each step's links are written to the shared folder, so a lost executor costs
one step. The number of steps grows with the logarithm of the longest path. Aggregates combine before their shuffle; the lesser end
of very many links is met in a join of two plain shuffles, which adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from ._skew import apart

#: Links that a task joins at once.
CHUNK = 1 << 20


def _tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least node that it reaches by the links (a, b), but for these least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(i):
        np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
        while (up[up] != up).any():
            up = up[up]
        i, j = up[i], up[j]
        i, j = i[i != j], j[i != j]
    low = up != np.arange(len(nodes))
    return nodes[low], nodes[up[low]]


def _joined(links: DataFrame) -> DataFrame:
    """Links (a > b) with the same components, no more than given: those of a task, ``CHUNK`` at once, make one tree a component."""

    def trees(batches):
        held, n = [], 0

        def tree():
            a, b = _tree(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= CHUNK:
                yield tree()
                held, n = [], 0
        if n:
            yield tree()

    return links.select("a", "b").mapInArrow(trees, "a long, b long")


def _up(links: DataFrame, tree: DataFrame) -> DataFrame:
    """(a, b, moved): links (a > b), those whose b has a parent in ``tree`` (a, b) moved to it."""
    parents = tree.select(F.col("a").alias("b"), F.col("b").alias("up"))
    return links.join(apart(parents), "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved"))


def stars(links: DataFrame) -> DataFrame:
    """(a, b) of every node a in a link but the least one of its component, which is b; each once. ``links``: as in ``components``."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(_joined(links), "links")
    while True:
        least = written(links.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("most")), "least")
        tree, several = least.select("a", "b"), least.where("b <> most")
        if several.isEmpty():
            break
        others = links.join(apart(several.select("a", F.col("b").alias("m"))), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(_joined(_up(tree.unionByName(others), tree)), "links")
    while True:
        found = written(_up(tree, tree), "stars")
        tree = found.select("a", "b")
        if found.where("moved").isEmpty():
            return tree


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in a link; the component is its least node. ``links``: columns a and b, long.

    Links with a null end or of a node to itself are ignored; their order and repetition don't matter.
    """
    found = stars(links)
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
