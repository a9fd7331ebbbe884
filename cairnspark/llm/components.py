"""Distributed union-find: connected components by alternating large and small stars.

Each round is a pair of aggregations and joins over the edges; labels are the
least node of a component.  Nothing is gathered by node, so a node of any degree
costs its edges only, and no link or label comes to the driver.  Up to
:data:`LOCAL_EDGES` edges are joined in one task instead, where rounds over the
cluster would cost more than the edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .textbytes import tidied


def _large(e: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node with the least of the node and its neighbours."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")


def _small(e: DataFrame) -> DataFrame:
    """Link a node and its lesser neighbours with the least of them (edges have a < b)."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    moved = e.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x < y")
    kept = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.unionByName(kept).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _is_star(e: DataFrame) -> bool:
    """Whether every node has one lesser neighbour and no label has any: then labels are final."""
    many = e.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
    linked = e.select("a").distinct().join(e.select("b").distinct(), F.col("a") == F.col("b"), "left_semi").select(F.col("a").alias("b"))
    return many.unionByName(linked).isEmpty()


#: Edges that one task joins by itself (16 MB); more go through rounds over the cluster.
LOCAL_EDGES = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the least node of each one's component: labels are lowered along edges and by pointers to the label's label."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        # the labels themselves are lowered too, so whole trees move
        for side in (label[x], label[y], x, y):
            np.minimum.at(label, side, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return ids, ids[label]


def _joined(edges: DataFrame) -> DataFrame:
    """(id, comp) of a bounded number of edges, in one task."""

    def run(batches):
        import pyarrow as pa

        held = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
        a, b = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        ids, comp = least_labels(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comp)], names=["id", "comp"])

    return edges.select("a", "b").coalesce(1).mapInArrow(tidied(run), "id long, comp long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, comp) of every node that has an edge to another; ``edges`` has longs a and b.

    Loops, repeats and null ends are dropped; without edges the result is empty.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if e.count() <= LOCAL_EDGES:
        return _joined(e)
    for _ in range(max_rounds):
        if _is_star(e):
            break
        nxt = written(_small(_large(e).distinct()), "edges")
        discard(e)
        e = nxt
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("id"), F.col("a").alias("comp")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())
