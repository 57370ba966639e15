"""Statistical outlier removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_distance(neighbors: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """``(idx, mean_dist)``: sum of distances of neighbours within the radius over k, however many those are."""
    d = F.col("dist") if radius is None else F.when(F.col("dist") <= radius, F.col("dist")).otherwise(0.0)
    return neighbors.groupBy("idx").agg((F.sum(d) / k).alias("mean_dist"))


def outlier_stats(mean_dist: DataFrame) -> DataFrame:
    """One row ``(n, mu, sigma)``: mean and population standard deviation."""
    return mean_dist.agg(F.count("*").alias("n"), F.avg("mean_dist").alias("mu"), F.stddev_pop("mean_dist").alias("sigma"))


def statistical_outlier(points: DataFrame, neighbors: DataFrame, k: int, radius: float | None = None, alpha: float = 1.0) -> DataFrame:
    """The points with ``mean_dist``, ``is_outlier`` and a label of -2 for outliers (others keep theirs).

    An outlier has a mean distance of at least mu + alpha sigma. Points without neighbours have a null mean distance
    and are no outliers. The threshold is one row, read to the driver and put into the plan as a number.
    """
    m = mean_distance(neighbors, k, radius)
    s = outlier_stats(m).first()
    limit = F.lit(None).cast("double") if not s["n"] else F.lit(s["mu"] + alpha * s["sigma"])
    flag = F.coalesce(F.col("mean_dist") >= limit, F.lit(False))
    out = points.join(m, "idx", "left").withColumn("is_outlier", flag)
    return out.withColumn("label", F.when(flag, -2).otherwise(F.col("label"))) if "label" in points.columns else out
