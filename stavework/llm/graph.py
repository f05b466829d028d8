"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stavework.session import share

HELD = 1 << 20  # edges that a task holds at once


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(above := root[root], root):
            root = above


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """(u, v): each task's edges as ties (u) to the least node that they connect with (v); a least node has a tie to itself."""
    def run(batches):
        held: list = []
        size = 0
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        table = lambda u, v: pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in ("u", "v")])
            size += len(batch)
            if size > most:
                held = [_least(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > most // 2:
                    yield table(*held.pop())
                    size = 0
        yield table(*_least(*(np.concatenate(x) for x in zip(none, *held))))

    return edges.mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most: int = HELD) -> DataFrame:
    """(node, component) for every node that `edges` (u, v: long) names; the component is its least node.

    While there are more edges than a task may hold (`most`), each task ties its own ones to their least nodes, and large and small
    stars connect what tasks share; that alternates until nothing changes, which takes about log n rounds whatever
    the shape. As soon as a task may hold them all, which a small table's are from the start, one contraction ends it, in
    place of rounds of joins. Each round is written to the shared folder, so lineage stays short; joins on a hub
    are split by Spark at run time. No edges give no rows; null ends and loops are ignored.
    """
    edges = share(edges.select("u", "v").where("u <> v"))
    count, before = edges.count(), None
    while count > most:
        edges = share(_small_star(_large_star(_contracted(edges, most).where("u <> v"))))
        mark = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if mark == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        count, before = mark[0], mark
    return share(_contracted(edges.coalesce(1), most).select(F.col("u").alias("node"), F.col("v").alias("component")))
