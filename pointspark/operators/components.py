"""Connected components: forests within partitions, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.session import BROADCAST_ROWS, cut, drop_cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition to the smallest node that they lead to, one for each other node."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.int64)]) for k in (0, 1))
    node, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    out = np.flatnonzero(root != np.arange(len(node)))
    yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[root[out]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with an edge ``(a, b)``; root is the smallest node of its component.

    The edges of a partition become a forest of as many edges as it has nodes at most. What is left, if no more than
    BROADCAST_ROWS edges (counted), is solved in one task; else each step replaces edges by edges to the smallest neighbour.
    That needs a number of rounds that grows with the logarithm of the nodes, keeps at most as many edges as before, and
    gathers no neighbourhood. Edges with a null end are left out.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    e = cut(e.repartition(n, "v").mapInArrow(_forest, "u long, v long"))
    if e.count() <= BROADCAST_ROWS:
        stars = e.repartition(1).mapInArrow(_forest, "u long, v long")
        return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        old, e = e, cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct())
        drop_cut(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        state = now


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number the rows from 0 in order of a unique column without sorting them in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cut(df.repartitionByRange(n, column).sortWithinPartitions(column).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = r.groupBy(part.alias("_p")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_p", before.alias("_b"))
    return r.withColumn("_p", part).join(sizes, "_p").withColumn(name, F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_b")
