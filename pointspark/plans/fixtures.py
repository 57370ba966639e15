"""Point clouds out of the star-schema tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions.linalg import rotation_z
from pointspark.operators.registration import transform
from pointspark.session import table

#: The rigid motion between the two clouds of the registration queries.
POSE: np.ndarray = rotation_z(5.0, (0.03, -0.02, 0.01))


def _e(k: int):
    return F.get("embedding", k).cast("double")


def cloud(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), _e(0).alias("x"), _e(1).alias("y"), _e(2).alias("z"), F.lit(1.0).alias("intensity"), F.lit(-1).alias("label"))


def moved_cloud(spark: SparkSession, d: str) -> DataFrame:
    return transform(cloud(spark, d), POSE)


def pseudo_normals(spark: SparkSession, d: str) -> DataFrame:
    n = F.sqrt(_e(3) * _e(3) + _e(4) * _e(4) + _e(5) * _e(5))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), (_e(3) / n).alias("nx"), (_e(4) / n).alias("ny"), (_e(5) / n).alias("nz"))


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.slice("embedding", 1, 33).cast("array<double>").alias("f"))


def event_cloud(spark: SparkSession, d: str) -> DataFrame:
    z = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0) / 86400.0
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), z.alias("z"))


def line_cloud(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), ((F.col("l_discount") + F.col("l_tax")) * 100).alias("z"))
