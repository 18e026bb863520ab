"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosieve.llm.common import discard, shared_dir, stored


#: Edges (16 bytes each) that one task joins; more are joined by rounds over all tasks.
ONE_TASK = 1_000_000


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of i and j in place; ``root`` holds each node's smallest known node, before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _join_all(batches):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    ends = np.concatenate([t.column(c).to_numpy() for c in ("a", "b")])
    nodes, at = np.unique(ends, return_inverse=True)
    root = np.arange(len(nodes))
    merge(root, at[: t.num_rows], at[t.num_rows :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Rows (node, root) for all nodes of the edges (a, b); ``root`` is the smallest node that is connected.

    Up to ``one_task`` distinct edges are joined in one task. More take large-star and small-star rounds in turn, each
    written to the shared folder, until no edge changes; a round's table goes when the next one is written. Null ends and
    loops are left out; edges that repeat count once; no edges give no rows.
    """
    spark = edges.sparkSession
    flat = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = shared_dir(spark, "components")
    now = stored(flat, path)
    if now.count() <= one_task:
        kind = now.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_join_all, f"node {kind}, root {kind}")
    stamp = _stamp(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        before, path = path, shared_dir(spark, "components")
        now = stored(small, path)
        discard(spark, before)
        new = _stamp(now)
        if new == stamp:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        stamp = new


def _stamp(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
