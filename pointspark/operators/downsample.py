"""Normal-space sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointspark.functions.vec import col3, normal_angles
from pointspark.operators.components import numbered
from pointspark.session import cut

_SALTS = 32


def bucket_counts(n: int, ratio: float) -> tuple[int, int, int]:
    """(target, theta buckets, phi buckets) for a cloud of n points; at least one bucket."""
    target = int(n * ratio)
    nt = max(1, int(math.sqrt(target / 2)))
    return target, nt, 2 * nt


def normal_bucket(n_theta: int, n_phi: int) -> Column:
    theta, phi = normal_angles(col3("nx", "ny", "nz"))
    t = F.least(F.floor(theta / (math.pi / n_theta)), F.lit(n_theta - 1))
    p = F.least(F.floor(phi / (2 * math.pi / n_phi)), F.lit(n_phi - 1))
    return (t * n_phi + p).cast("long")


def normal_buckets(normals: DataFrame, ratio: float) -> DataFrame:
    """``(idx, bucket)``; null or not finite normals take no part."""
    ok = F.lit(True)
    for c in ("nx", "ny", "nz"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    n = normals.where(ok)
    _, nt, np_ = bucket_counts(n.count(), ratio)
    return n.select("idx", normal_bucket(nt, np_).alias("bucket"))


def quotas(buckets: DataFrame, target: int) -> DataFrame:
    """``(bucket, n, quota)``: an equal share each, one more for the first ones, no more than the bucket holds.

    Buckets are numbered in order without bringing them together in one task.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    sizes = cut(numbered(sizes, "bucket", "no"))
    k = sizes.count()
    base, more = divmod(target, k) if k else (0, 0)
    return sizes.select("bucket", "n", F.least("n", F.lit(base) + (F.col("no") < more).cast("int")).cast("long").alias("quota"))


def portable_hash(idx: Column, seed: int) -> Column:
    return F.pmod(idx.cast("decimal(20,0)") * F.lit(2654435761) + F.lit(seed), F.lit(4294967296)).cast("long")


def normal_space(points: DataFrame, normals: DataFrame, ratio: float = 0.5, seed: int = 1) -> DataFrame:
    """About ``ratio`` of the points, spread evenly over the directions of their normals.

    Within a bucket points are taken in order of a seeded hash, so a retry takes the same. Large buckets are first cut
    to the quota within salted parts, then as a whole: no bucket passes through one task. A bucket's shortfall is not
    given to others. Points without a normal are not taken.
    """
    b = cut(normal_buckets(normals, ratio))
    target, _, _ = bucket_counts(b.count(), ratio)
    q = cut(quotas(b, target))
    r = b.join(q.select("bucket", "quota"), "bucket").withColumn("h", portable_hash(F.col("idx"), seed)).withColumn("salt", F.pmod(F.xxhash64("idx"), F.lit(_SALTS)))
    r = r.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("h", "idx"))).where("r <= quota")
    r = r.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("h", "idx"))).where("r <= quota")
    return points.join(r.select("idx", "bucket"), "idx")
