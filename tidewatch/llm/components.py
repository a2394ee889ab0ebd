"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.workspace import written


def local_roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The lowest index that each of ``count`` nodes reaches over links that one task holds."""
    root = np.arange(count)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        for end in (root[left], root[right], left, right):
            np.minimum.at(root, end, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _state(edges: DataFrame) -> tuple:
    """Enough to tell whether a round changed the edges: how many, and a sum over them."""
    found = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
    return tuple(found)


def _towards(edges: DataFrame, lowest: DataFrame, only: Column) -> DataFrame:
    """Each neighbour of a node that ``only`` allows, hung on the lowest node known there."""
    return edges.join(lowest, "node").filter(only).select(F.col("root").alias("node"), F.col("low").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node reaches.

    ``edges`` has the long columns ``node`` and ``root``, in either direction; NULL ends
    and loops are left out.  Returns ``node`` and ``root``, one row for each node that is
    not the smallest of its component; all other nodes are their own root.  Without edges
    the result is empty.

    Large-star and small-star rounds take turns until nothing changes, which needs a
    number of rounds that grows with the logarithm of the number of nodes.  A round is
    aggregations with map-side combine and joins with one row per node on the small side,
    so a hub with a third of all edges is split by Spark's skew handling.  Each round is
    written to the shared folder; no links reach the driver.
    """
    down = edges.filter("node <> root").select(
        F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")
    )
    down = written(down.distinct(), "edges")
    state = _state(down)
    while state[0]:
        both = down.unionByName(down.select(F.col("root").alias("node"), F.col("node").alias("root")))
        lowest = both.groupBy("node").agg(F.min("root").alias("low"))
        lowest = lowest.select("node", F.least("node", "low").alias("low"))
        large = _towards(both, lowest, F.expr("root > node")).distinct()
        lowest = large.groupBy("node").agg(F.min("root").alias("low"))
        small = _towards(large, lowest, F.expr("root <> low")).unionByName(
            lowest.select("node", F.col("low").alias("root"))
        )
        down = written(small.distinct(), "edges")
        before, state = state, _state(down)
        if state == before:
            break
    return down
