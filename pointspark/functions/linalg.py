"""Symmetric 3x3 eigen-systems as Columns, and rigid transforms in numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.functions.vec import Vec, cross3, dot3


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it.

    Nested expressions that use their parts many times would else grow exponentially when the optimizer moves a filter
    below them.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _fields(**c: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in c.items()])


def eigenvalues3(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """Struct ``(l1, l2, l3)``: eigenvalues of a symmetric 3x3 matrix, descending, in closed trigonometric form."""

    def scale(m):
        q = m["q"]
        p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
        return let(_fields(q=q, p=F.sqrt(p2 / 6)), angle)

    def angle(m):
        q, p = m["q"], m["p"]
        s = F.when(p > 0, p).otherwise(1.0)
        return let(_fields(q=q, p=p, a=(xx - q) / s, b=xy / s, c=xz / s, d=(yy - q) / s, e=yz / s, f=(zz - q) / s), roots)

    def roots(m):
        a, b, c, d, e, f = (m[k] for k in "abcdef")
        det = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
        phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
        return let(_fields(q=m["q"], p=m["p"], phi=phi), lambda n: let(
            _fields(q=n["q"], l1=n["q"] + 2 * n["p"] * F.cos(n["phi"]), l3=n["q"] + 2 * n["p"] * F.cos(n["phi"] + 2 * math.pi / 3)),
            lambda r: _fields(l1=r["l1"], l2=3 * r["q"] - r["l1"] - r["l3"], l3=r["l3"]),
        ))

    return let(_fields(q=(xx + yy + zz) / 3), scale)


def canonical_sign(v: Vec) -> Vec:
    """The component of largest absolute value is made positive (the first of equal ones)."""
    ax, ay, az = F.abs(v[0]), F.abs(v[1]), F.abs(v[2])
    lead = F.when((ax >= ay) & (ax >= az), v[0]).when(ay >= az, v[1]).otherwise(v[2])
    s = F.when(lead < 0, -1.0).otherwise(1.0)
    return (v[0] * s, v[1] * s, v[2] * s)


def with_eigenvector(df: DataFrame, value: str, out: tuple[str, str, str], m: tuple[str, ...] = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")) -> DataFrame:
    """Add the unit eigenvector of eigenvalue ``value``: the longest cross product of rows of A - value I.

    Null where the eigenvalue is repeated so that no direction is distinguished.
    """
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in m)
    size = F.abs(xx) + F.abs(yy) + F.abs(zz)

    def longest(a):
        lam = a["lam"]
        r0, r1, r2 = (xx - lam, xy, xz), (xy, yy - lam, yz), (xz, yz, zz - lam)
        c = [cross3(r0, r1), cross3(r0, r2), cross3(r1, r2)]
        return F.array_max(F.array(*[_fields(n=dot3(v, v), i=-F.lit(i), x=v[0], y=v[1], z=v[2]) for i, v in enumerate(c)]))

    def unit(b):
        n = F.sqrt(b["n"])
        return F.when(n > 1e-10 * size * size, let(_fields(x=b["x"] / n, y=b["y"] / n, z=b["z"] / n), lambda u: _fields(**dict(zip("xyz", canonical_sign((u["x"], u["y"], u["z"])), strict=True)))))

    df = df.withColumn("_v", let(let(_fields(lam=F.col(value)), longest), unit))
    return df.withColumns({o: F.col(f"_v.{c}") for o, c in zip(out, "xyz", strict=True)}).drop("_v")


def centroid(points: DataFrame) -> DataFrame:
    """One row ``(n, cx, cy, cz)``; an empty cloud has n 0 and null coordinates."""
    return points.agg(F.count("x").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))


# ---------------------------------------------------------------- rigid transforms (4x4, row-major)


def rotation_z(degrees: float, shift=(0.0, 0.0, 0.0)) -> np.ndarray:
    a = math.radians(degrees)
    t = np.eye(4)
    t[:2, :2] = [[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]
    t[:3, 3] = shift
    return t


def kabsch(h: np.ndarray, source_mean: np.ndarray, target_mean: np.ndarray) -> np.ndarray:
    """Best rigid transform from source to target of the cross-covariance H = sum target source^T.

    R = U V^T with the last singular direction flipped if R would be a reflection; t = target - R source.
    """
    u, _, vt = np.linalg.svd(h)
    if np.linalg.det(u @ vt) < 0:
        u[:, 2] *= -1
    t = np.eye(4)
    t[:3, :3] = u @ vt
    t[:3, 3] = target_mean - t[:3, :3] @ source_mean
    return t


def rigid_from_points(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = source.mean(0), target.mean(0)
    return kabsch((target - t).T @ (source - s), s, t)


def rigid_from_triples(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rigid transforms of many triples at once: (m, 3, 3) points each; returns (m, 4, 4)."""
    s, t = source.mean(1), target.mean(1)
    h = np.einsum("mki,mkj->mij", target - t[:, None], source - s[:, None])
    u, _, vt = np.linalg.svd(h)
    flip = np.linalg.det(u @ vt) < 0
    u[flip, :, 2] *= -1
    out = np.tile(np.eye(4), (len(source), 1, 1))
    out[:, :3, :3] = u @ vt
    out[:, :3, 3] = t - np.einsum("mij,mj->mi", out[:, :3, :3], s)
    return out
