"""Connected components of an edge table by alternating large and small stars, with aggregates and joins only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a long, b long); root is the component's smallest node.

    A hub's neighbours are never gathered: their minimum is a partial aggregate, written before the join that hands it
    out, which Spark can then split when a key is skewed. Each round is checkpointed.
    """
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = checkpoint(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        low = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = checkpoint(small.distinct())
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places their smallest label, in place; labels point to places and every label is its own label."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
