"""Connected components by alternating large and small stars.

Every round turns the edges of each node towards the least node it knows: a large star links a node's larger
neighbours to its least neighbour, a small star links its smaller ones. The edges end as stars around
each component's least node. Rounds grow with the logarithm of the longest path, the
number of edges never grows, and a hub is only ever the key of a partial aggregate and of a join
with one row on the other side, which adaptive execution splits. Up to ``LOCAL_EDGES`` edges, 16 bytes each, are joined
by the driver, in place of rounds of small jobs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import checkpoint_dir


LOCAL_EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n nodes is linked to by edges a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            far = new[new]
            if (far == new).all():
                break
            new = far
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each edge's component; nodes without edges are not in it."""
    checkpoint_dir(edges.sparkSession)
    e = (edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct().checkpoint())
    if dict(e.dtypes) == {"a": "bigint", "b": "bigint"} and e.count() <= LOCAL_EDGES:
        known = e.toArrow()
        ends = [known[c].to_numpy() for c in ("a", "b")]
        node, at = np.unique(np.concatenate(ends), return_inverse=True)
        root = node[forest(at[:len(ends[0])], at[len(ends[0]):], len(node))]
        return edges.sparkSession.createDataFrame(pa.table([pa.array(node), pa.array(root)], names=["node", "root"]))
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .unionByName(least.select("a", F.col("m").alias("b"))).distinct().checkpoint())
        state = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if state == seen:
            break
        seen = state
    return (e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
