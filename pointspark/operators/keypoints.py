"""Intrinsic shape signatures: keypoints by eigenvalue ratios and non-maximum suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.operators.shape import covariance, eigenvalues
from pointspark.session import cut


def is_candidate(g21: float, g32: float) -> Column:
    """l1 > l2 > l3, l2 / l1 < g21, l3 / l2 < g32; false where l1 or l2 is 0."""
    l1, l2, l3 = F.col("l1"), F.col("l2"), F.col("l3")
    ok = (l1 != 0) & (l2 != 0) & (l1 > l2) & (l2 > l3)
    return F.coalesce(ok & (F.try_divide(l2, l1) < g21) & (F.try_divide(l3, l2) < g32), F.lit(False))


def iss(neighbors: DataFrame, nms_radius: float, g21: float = 0.35, g32: float = 0.75, compat: str | None = None) -> DataFrame:
    """``(idx, l1, l2, l3, is_candidate, is_keypoint)``.

    A candidate is a keypoint unless a neighbour within ``nms_radius`` has a larger saliency. Saliency is the smallest
    eigenvalue, with ``compat='lambda_max'`` the largest. All neighbours are compared, candidates or not.
    """
    saliency = "l1" if compat == "lambda_max" else "l3"
    e = cut(eigenvalues(covariance(neighbors)).select("idx", "l1", "l2", "l3").withColumn("is_candidate", is_candidate(g21, g32)))
    near = neighbors.where(F.col("dist") <= nms_radius).select("idx", "nidx")
    best = near.join(e.select(F.col("idx").alias("nidx"), F.col(saliency).alias("s")), "nidx").groupBy("idx").agg(F.max("s").alias("best"))
    out = e.join(best, "idx", "left")
    keep = F.col("is_candidate") & (F.col(saliency) >= F.coalesce("best", F.col(saliency)))
    return out.select("idx", "l1", "l2", "l3", "is_candidate", keep.alias("is_keypoint"))
