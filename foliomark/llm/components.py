"""Connected components of a graph of links, by alternating large and small stars.

Each round hangs every node's neighbours on the smallest of them; the rounds needed grow with the logarithm
of the longest path.  A round is two aggregations (combined before the shuffle) and joins on the node, whose
hot keys Spark can split; neighbours are never gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


class Forest:
    """Union-find over the rows of an array, for the links that one task finds."""

    def __init__(self, size: int) -> None:
        self.up = np.arange(size)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.up[rows]
        while not np.array_equal(more := self.up[found], found):
            found = more
        self.up[rows] = found
        return found

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Link row x[i] with row y[i] for every i."""
        while len(x):
            a, b = self.roots(x), self.roots(y)
            apart = a != b
            x, y = x[apart], y[apart]
            # where a root is given several times one of them holds; the next turn sees to the others
            self.up[np.maximum(a, b)[apart]] = np.minimum(a, b)[apart]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each joined row but the first of its tree, with this first one."""
        roots = self.roots(np.arange(len(self.up)))
        rows = np.flatnonzero(roots != np.arange(len(roots)))
        return rows, roots[rows]


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """``edges`` (a > b) with the larger (or not larger) neighbours of each node hung on its smallest one."""
    if larger:
        seen = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges
    least = seen.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
    hung = seen.join(least, seen["a"] == least["node"])
    if larger:
        hung = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("m").alias("b"))
        )
    return hung.where(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node with a link.

    ``edges`` has two integer columns a and b, in any order, repeated or not; loops and nulls are ignored.
    """
    now = checkpointed(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
        .distinct()
    )
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct()
            )
        mark = seen
        now = checkpointed(_stars(_stars(now, larger=True), larger=False))
