"""Local shape: covariance, eigen-systems and normals of neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.functions.linalg import eigenvalues3, with_eigenvector

_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
COV = tuple(f"c{p}" for p in _PAIRS)


def covariance(neighbors: DataFrame) -> DataFrame:
    """``(idx, n, cxx, cxy, cxz, cyy, cyz, czz)``: population covariance of each point and its neighbours about their
    centroid. ``n`` counts the neighbours; sums are taken of offsets from the point, which itself adds zeros."""
    d = {c: F.col(f"d{c}") for c in "xyz"}
    sums = [F.sum(d[c]).alias(f"s{c}") for c in "xyz"] + [F.sum(d[p[0]] * d[p[1]]).alias(f"s{p}") for p in _PAIRS]
    g = neighbors.groupBy("idx").agg(F.count("*").alias("n"), *sums)
    m = F.col("n") + 1
    return g.select("idx", "n", *[(F.col(f"s{p}") / m - (F.col(f"s{p[0]}") / m) * (F.col(f"s{p[1]}") / m)).alias(f"c{p}") for p in _PAIRS])


def weighted_covariance(neighbors: DataFrame, radius: float) -> DataFrame:
    """``(idx, w, cxx, ..., czz)``: scatter about the point itself, weight |dist - radius|; null where the weights
    add up to no more than 1e-6."""
    w = F.abs(F.col("dist") - radius)
    sums = [F.sum(w * F.col(f"d{p[0]}") * F.col(f"d{p[1]}")).alias(f"s{p}") for p in _PAIRS]
    g = neighbors.groupBy("idx").agg(F.sum(w).alias("w"), *sums)
    return g.select("idx", "w", *[F.when(F.col("w") > 1e-6, F.col(f"s{p}") / F.col("w")).alias(f"c{p}") for p in _PAIRS])


def eigenvalues(cov: DataFrame) -> DataFrame:
    """Add ``l1 >= l2 >= l3``, the eigenvalues of the covariance columns."""
    e = cov.withColumn("_l", eigenvalues3(*[F.col(c) for c in COV]))
    return e.withColumns({k: F.col(f"_l.{k}") for k in ("l1", "l2", "l3")}).drop("_l")


def pca(neighbors: DataFrame) -> DataFrame:
    """Eigen-system of each neighbourhood: eigenvalues ``l1..l3`` and unit vectors ``e1, e3`` as structs; an
    eigenvector is null where its eigenvalue is repeated."""
    df = eigenvalues(covariance(neighbors))
    df = with_eigenvector(with_eigenvector(df, "l1", ("ax", "ay", "az")), "l3", ("bx", "by", "bz"))
    e1, e3 = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bz").alias("z"))
    return df.select("idx", "n", "l1", "l2", "l3", e1.alias("e1"), e3.alias("e3"))


def normals(neighbors: DataFrame) -> DataFrame:
    """``(idx, nx, ny, nz)``: unit eigenvector of the smallest eigenvalue, its largest component positive."""
    return with_eigenvector(eigenvalues(covariance(neighbors)), "l3", ("nx", "ny", "nz")).select("idx", "nx", "ny", "nz")
