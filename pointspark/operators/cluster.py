"""Voxel grids and density clustering on voxels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.functions.vec import cell_index, linear_voxel_id
from pointspark.operators.components import components, numbered
from pointspark.session import cut

Bounds = tuple[float, float, float, float, float, float]


def grid_size(bounds: Bounds, cell: float) -> tuple[int, int, int]:
    return tuple(math.ceil((bounds[2 * k + 1] - bounds[2 * k]) / cell - 1e-9) for k in range(3))  # type: ignore[return-value]


def voxelize(points: DataFrame, bounds: Bounds, cell: float | tuple[float, float, float]) -> DataFrame:
    """The points with ``ix, iy, iz, voxel_id``; null where a coordinate is missing or outside the bounds."""
    cells = cell if isinstance(cell, tuple) else (cell, cell, cell)
    g = [math.ceil((bounds[2 * k + 1] - bounds[2 * k]) / cells[k] - 1e-9) for k in range(3)]
    # beyond the bounds lies also NaN, which Spark orders last
    near = {f"i{c}": F.when(F.col(c).between(bounds[2 * k], bounds[2 * k + 1] + cells[k]), cell_index(F.col(c), bounds[2 * k], cells[k])) for k, c in enumerate("xyz")}
    v = points.withColumns(near)
    inside = (F.col("ix") < g[0]) & (F.col("iy") < g[1]) & (F.col("iz") < g[2])
    v = v.withColumn("voxel_id", F.when(inside, linear_voxel_id(F.col("ix"), F.col("iy"), F.col("iz"), g[0], g[1])))
    return v.withColumns({i: F.when(F.col("voxel_id").isNotNull(), F.col(i)) for i in ("ix", "iy", "iz")})


def voxel_counts(voxelized: DataFrame, min_pts: int) -> DataFrame:
    """``(voxel_id, ix, iy, iz, n, is_core)`` of voxels that hold points."""
    g = voxelized.where("voxel_id IS NOT NULL").groupBy("voxel_id").agg(F.count("*").alias("n"), *[F.min(i).alias(i) for i in ("ix", "iy", "iz")])
    g = g.select("voxel_id", "ix", "iy", "iz", "n")
    return g.withColumn("is_core", F.col("n") >= min_pts)


def voxel_offsets(voxels: DataFrame) -> DataFrame:
    """``(voxel_id, n, start)``: how many points lie in voxels of smaller id. Counted within layers of the grid, whose totals
    are then added up, so that no task orders all voxels."""
    v = voxels.select("voxel_id", "n", "iz")
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    layers = v.groupBy("iz").agg(F.sum("n").alias("s"))
    layers = layers.select("iz", F.coalesce(F.sum("s").over(before(Window.orderBy("iz"))), F.lit(0)).alias("below"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy("iz").orderBy("voxel_id"))), F.lit(0))
    return v.withColumn("own", own).join(layers, "iz").select("voxel_id", "n", (F.col("own") + F.col("below")).alias("start"))


def voxel_adjacency(voxels: DataFrame) -> DataFrame:
    """``(src, dst)``: existing voxels whose indices differ by at most 1 on every axis, the voxel itself included."""
    r = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    e = voxels.select(F.col("voxel_id").alias("src"), "ix", "iy", "iz").withColumn("ox", F.explode(r)).withColumn("oy", F.explode(r)).withColumn("oz", F.explode(r))
    e = e.select("src", (F.col("ix") + F.col("ox")).alias("ix"), (F.col("iy") + F.col("oy")).alias("iy"), (F.col("iz") + F.col("oz")).alias("iz"))
    return e.join(voxels.select(F.col("voxel_id").alias("dst"), "ix", "iy", "iz"), ["ix", "iy", "iz"]).select("src", "dst")


def voxel_clusters(voxels: DataFrame) -> DataFrame:
    """``(voxel_id, is_core, cluster_id)`` of clustered voxels.

    Adjacent core voxels form a cluster, numbered from 0 in order of its smallest voxel; another voxel next to core
    voxels joins the cluster of the one with the smallest id; the rest is noise and does not come out.
    """
    voxels = cut(voxels)
    adj = voxel_adjacency(voxels)
    core = voxels.where("is_core").select("voxel_id")
    links = adj.where("src > dst").join(core.withColumnRenamed("voxel_id", "src"), "src", "left_semi").join(core.withColumnRenamed("voxel_id", "dst"), "dst", "left_semi")
    roots = components(links.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    label = core.join(roots.withColumnRenamed("node", "voxel_id"), "voxel_id", "left").select("voxel_id", F.coalesce("root", "voxel_id").alias("root"))
    ids = numbered(label.select("root").distinct(), "root", "cluster_id")
    label = cut(label.join(ids, "root").select("voxel_id", "cluster_id"))
    border = adj.join(label.withColumnRenamed("voxel_id", "dst"), "dst").join(core.withColumnRenamed("voxel_id", "src"), "src", "left_anti")
    border = border.groupBy("src").agg(F.min_by("cluster_id", "dst").alias("cluster_id"))
    return label.select("voxel_id", F.lit(True).alias("is_core"), "cluster_id").union(border.select("src", F.lit(False), "cluster_id"))


def voxel_dbscan(points: DataFrame, bounds: Bounds, cell: float = 0.8, min_pts: int = 10, eps: float = 0.5, keep_noise: bool = False) -> DataFrame:
    """The points of clusters with ``cluster_id``, their label set to it (as INT) if they have one.

    Density is counted per voxel and voxels link by adjacency; ``eps`` is accepted for the sake of the interface and
    has no effect. Points outside the bounds and noise are dropped, or kept with a null cluster_id.
    """
    del eps
    v = voxelize(points, bounds, cell)
    c = voxel_clusters(voxel_counts(v, min_pts)).select("voxel_id", "cluster_id")
    out = v.join(c, "voxel_id", "left" if keep_noise else "inner").drop("ix", "iy", "iz")
    if "label" in points.columns:
        out = out.withColumn("label", F.coalesce(F.col("cluster_id").cast("int"), F.col("label")))
    return out


def distribution(labelled: DataFrame, column: str = "cluster_id") -> DataFrame:
    """``(label, n)`` rows by label."""
    return labelled.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
