"""Connected components of links between whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.common import discard, stage

#: Links that one task may join.
ONE_TASK = 1_000_000


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins a[k] with b[k] in a forest whose roots are the least of their trees."""
    while len(a):
        ra, rb = root[a], root[b]
        while True:  # to the roots
            up_a, up_b = root[ra], root[rb]
            if (up_a == ra).all() and (up_b == rb).all():
                break
            ra, rb = up_a, up_b
        root[a], root[b] = ra, rb
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links, at most ONE_TASK of them, to (node, root)."""
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([t.column("u").to_numpy(), t.column("v").to_numpy()]), return_inverse=True)
        root = np.arange(len(nodes))
        join(root, at[: len(t)], at[len(t) :])
        while not (root[root] == root).all():
            root = root[root]
        below = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], names=["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(u, v) links to (node, root), root the least node of the component, for
    each node with a lesser one. Up to `one_task` links, some 16 MB, one task
    joins them; beyond, alternating large-star and small-star rounds do."""
    edges = stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if edges.count() <= one_task:
        out = stage(edges.coalesce(1).mapInArrow(_union, "node long, root long"), "roots")
        discard(edges)
        return out
    seen = None
    while True:  # the number of rounds grows with the logarithm of the longest path
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.where("u != v"), "large")  # u > v from here on
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = stage(small.where("u != v").distinct(), "small")
        discard(edges, large)
        edges = after
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
