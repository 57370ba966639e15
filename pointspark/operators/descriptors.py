"""Local shape descriptors: FPFH (33 numbers) and SHOT (352 numbers)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.functions.linalg import with_eigenvector
from pointspark.functions.vec import angle_bin, binning_weight, col3, cross3, dot3, pair_features, spherical_in_frame, unit_bin
from pointspark.operators.neighbors import knn
from pointspark.operators.shape import eigenvalues, normals, weighted_covariance
from pointspark.session import cut

FPFH_BINS = 11


def spfh(neighbors: DataFrame, normals: DataFrame, radius: float, rho_over_dist: bool = False) -> DataFrame:
    """``(idx, bin, n)``: three histograms of 11 bins of the features of a point with its neighbours within the
    radius, alpha in bins 0-10, theta in 11-21, rho in 22-32. Coincident points and those without normal are skipped."""
    n = normals.select("idx", "nx", "ny", "nz").where("nx IS NOT NULL")
    pairs = neighbors.where((F.col("dist") <= radius) & (F.col("dist") > 0)).join(n, "idx").join(n.toDF("nidx", "mx", "my", "mz"), "nidx")
    alpha, theta, rho = pair_features(col3("dx", "dy", "dz"), F.col("dist"), col3("nx", "ny", "nz"), col3("mx", "my", "mz"), rho_over_dist)
    bins = F.array(unit_bin(alpha), angle_bin(theta) + FPFH_BINS, unit_bin(rho) + 2 * FPFH_BINS)
    return pairs.select("idx", F.explode(bins).alias("bin")).groupBy("idx", "bin").agg(F.count("*").alias("n"))


def fpfh(neighbors: DataFrame, normals: DataFrame, k: int, radius: float, keypoints: DataFrame | None = None, rho_over_dist: bool = False) -> DataFrame:
    """``(idx, bin, v)``: SPFH of the point plus, over neighbours within the radius, SPFH / distance / k.

    Bins without a value are left out. SPFH is worked out once for every point; with ``keypoints`` (a column idx) only
    those get a descriptor.
    """
    s = cut(spfh(neighbors, normals, radius, rho_over_dist))
    near = neighbors.where((F.col("dist") <= radius) & (F.col("dist") > 0)).select("idx", "nidx", "dist")
    own = s.select("idx", "bin", F.col("n").cast("double").alias("v"))
    if keypoints is not None:
        near, own = near.join(keypoints.select("idx"), "idx", "left_semi"), own.join(keypoints.select("idx"), "idx", "left_semi")
    others = near.join(s.select(F.col("idx").alias("nidx"), "bin", "n"), "nidx").select("idx", "bin", (F.col("n") / F.col("dist") / k).alias("v"))
    return own.union(others).groupBy("idx", "bin").agg(F.sum("v").alias("v"))


def dense(long: DataFrame, size: int, value: str = "v") -> DataFrame:
    """``(idx, f)`` with an ARRAY<DOUBLE> of ``size`` numbers out of long rows ``(idx, bin, value)``."""
    g = long.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col(value).cast("double")))).alias("m"))
    return g.select("idx", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("f"))


def reference_frame(neighbors: DataFrame, radius: float) -> DataFrame:
    """``(idx, xx, xy, xz, yx, yy, yz, zx, zy, zz)``: axes x (largest eigenvalue of the weighted scatter), z (smallest)
    turned to the side where most neighbours lie, y = z x x. Null axes where the frame is not determined."""
    e = eigenvalues(weighted_covariance(neighbors, radius))
    e = with_eigenvector(with_eigenvector(e, "l1", ("ax", "ay", "az")), "l3", ("bx", "by", "bz"))
    side = neighbors.groupBy("idx").agg(*[F.sum(f"d{c}").alias(f"s{c}") for c in "xyz"])
    e = e.join(side, "idx")
    s, a, b = col3("sx", "sy", "sz"), col3("ax", "ay", "az"), col3("bx", "by", "bz")
    fa, fb = F.when(dot3(s, a) < 0, -1.0).otherwise(1.0), F.when(dot3(s, b) < 0, -1.0).otherwise(1.0)
    x, z = tuple(v * fa for v in a), tuple(v * fb for v in b)
    y = cross3(z, x)
    ok = F.col("ax").isNotNull() & F.col("bx").isNotNull()
    return e.select("idx", *[F.when(ok, v).alias(f"{n}{c}") for n, axis in (("x", x), ("y", y), ("z", z)) for c, v in zip("xyz", axis, strict=True)])


def shot(neighbors: DataFrame, normals: DataFrame, radius: float, azimuth: int = 8, elevation: int = 2, radial: int = 2, cosine: int = 11) -> DataFrame:
    """``(idx, bin, v)``: histogram of neighbours within the radius over radial, elevation, azimuth and cosine bins,
    each neighbour shared linearly between bins on all four axes, brought to unit length.

    The cosine is that of the neighbour's normal with the point's z axis. Bin number: ((radial * elevation bins +
    elevation) * azimuth bins + azimuth) * cosine bins + cosine. Without a frame there are no rows.
    """
    lrf = reference_frame(neighbors, radius).where("xx IS NOT NULL")
    n = normals.select(F.col("idx").alias("nidx"), "nx", "ny", "nz").where("nx IS NOT NULL")
    p = neighbors.where(F.col("dist") <= radius).join(lrf, "idx").join(n, "nidx")
    x, y, z = col3("xx", "xy", "xz"), col3("yx", "yy", "yz"), col3("zx", "zy", "zz")
    rho, alpha, beta = spherical_in_frame(col3("dx", "dy", "dz"), x, y, z)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot3(z, col3("nx", "ny", "nz"))))
    p = p.select(
        "idx",
        binning_weight(rho, radius / radial, radius).alias("r"),
        binning_weight(beta, math.pi / elevation, math.pi).alias("e"),
        binning_weight(alpha + math.pi, 2 * math.pi / azimuth, 2 * math.pi).alias("a"),
        binning_weight(cos + 1, 2 / cosine, 2).alias("c"),
    )
    # the shares of one axis after the other: each doubles the rows, and all of it is generated code
    p = p.select("idx", "e", "a", "c", F.explode("r").alias("s")).select("idx", "e", "a", "c", F.col("s.bin").alias("bin"), F.col("s.w").alias("w"))
    for axis, bins, left in (("e", elevation, ("a", "c")), ("a", azimuth, ("c",)), ("c", cosine, ())):
        p = p.where("w > 0").select("idx", *left, "bin", "w", F.explode(axis).alias("s"))
        p = p.select("idx", *left, (F.col("bin") * bins + F.col("s.bin")).alias("bin"), (F.col("w") * F.col("s.w")).alias("w"))
    p = p.where("w > 0")
    h = p.groupBy("idx", "bin").agg(F.sum("w").alias("v"))
    h = h.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("idx"))))
    return h.select("idx", "bin", F.when(F.col("norm") > 1e-6, F.col("v") / F.col("norm")).otherwise(F.col("v")).alias("v"))


def shot_descriptor(points: DataFrame, k: int, radius: float, azimuth: int = 8, elevation: int = 2, radial: int = 2, cosine: int = 11) -> DataFrame:
    """``(idx, f)``: the SHOT vector of each point of a cloud, 352 numbers by default: neighbours, normals, frames and
    histograms in one call. Points without a frame or without a neighbour that has a normal have none."""
    nb = cut(knn(points, k))
    return dense(shot(nb, normals(nb), radius, azimuth, elevation, radial, cosine), azimuth * elevation * radial * cosine)
