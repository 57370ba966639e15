"""Scalar functions on points and vectors as Column expressions; all stay in the JVM's generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def col3(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def sub(a: Vec, b: Vec) -> Vec:
    return (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def scale(a: Vec, s: Column) -> Vec:
    return (a[0] * s, a[1] * s, a[2] * s)


def dot3(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm3(a: Vec) -> Column:
    return F.sqrt(dot3(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm3(sub(a, b))


def cross3(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def scaled_square_distance(a: Vec, b: Vec, by: float = 256.0) -> Column:
    """Squared distance of coordinates divided by ``by``."""
    d = sub(a, b)
    return dot3(d, d) / F.lit(by * by)


def distance_l2(a: Column, b: Column, dim: int | None = None) -> Column:
    """Euclidean distance of two arrays, of their first ``dim`` entries if given; null if lengths differ."""
    if dim is not None:
        a, b = F.slice(a, 1, dim), F.slice(b, 1, dim)
    d = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v))


def cell_index(value: Column, low: float | Column, cell: float) -> Column:
    return F.floor((value - low) * F.lit(1.0 / cell)).cast("long")


def linear_voxel_id(ix: Column, iy: Column, iz: Column, gx: int, gy: int) -> Column:
    return ((iz * gy + iy) * gx + ix).cast("long")


def voxel_indices(voxel_id: Column, gx: int, gy: int) -> Vec:
    return (F.pmod(voxel_id, F.lit(gx)), F.pmod(F.floor(voxel_id / gx), F.lit(gy)).cast("long"), F.floor(voxel_id / (gx * gy)).cast("long"))


def binning_weight(value: Column, step: float, top: float) -> Column:
    """At most two (bin, weight) shares of a value: linear interpolation, whole weight at both ends.

    With ``last = int(top / step)`` bins: below 0 all to bin 0, from the last bin on all to it; else the floor bin
    and the next one share, the next one clamped to the last.
    """
    last = int(top / step + 1e-9)
    v = value / F.lit(step)
    i = F.floor(v).cast("int")
    frac = v - F.floor(v)
    one = lambda b: F.array(F.struct(b.cast("int").alias("bin"), F.lit(1.0).alias("w")))
    two = F.array(F.struct(i.alias("bin"), (1 - frac).alias("w")), F.struct(F.least(i + 1, F.lit(last - 1)).cast("int").alias("bin"), frac.alias("w")))
    return F.when(v < 0, one(F.lit(0))).when(i >= last, one(F.lit(last - 1))).otherwise(two)


def spherical_in_frame(d: Vec, x: Vec, y: Vec, z: Vec) -> tuple[Column, Column, Column]:
    """Offset in a local frame as (rho, alpha, beta): length, azimuth in (-pi, pi], angle from the z axis."""
    rho = norm3(d)
    lx, ly, lz = dot3(d, x), dot3(d, y), dot3(d, z)
    beta = F.when(rho > 1e-6, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), lz / rho)))).otherwise(0.0)
    return rho, F.atan2(ly, lx), beta


def normal_angles(n: Vec) -> tuple[Column, Column]:
    """(theta, phi) of a normal, normalised where longer than 1e-6: angle from z, azimuth in [0, 2 pi)."""
    length = norm3(n)
    s = F.when(length > 1e-6, length).otherwise(1.0)
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n[2] / s)))
    phi = F.atan2(n[1] / s, n[0] / s)
    return theta, F.when(phi < 0, phi + 2 * math.pi).otherwise(phi)


def affine(p: Vec, t) -> Vec:
    """Rows 0-2 of a row-major 4x4 matrix (16 numbers) applied to a point."""
    m = [float(v) for row in t for v in (row if hasattr(row, "__len__") else [row])]
    return tuple(p[0] * m[4 * r] + p[1] * m[4 * r + 1] + p[2] * m[4 * r + 2] + F.lit(m[4 * r + 3]) for r in range(3))  # type: ignore[return-value]


def pair_features(offset: Vec, dist: Column, n_p: Vec, n_q: Vec, rho_over_dist: bool = False) -> tuple[Column, Column, Column]:
    """(alpha, theta, rho) of a point and its neighbour at ``offset`` (neighbour minus point is ``-offset``).

    With d = (p - q)/|p - q|, u = n_p, v = d x u, w = u x v: alpha = v.n_q, theta = atan2(w.n_q, u.n_q), rho = u.d;
    ``rho_over_dist`` divides rho by the distance once more.
    """
    d = scale(offset, -1 / dist)
    v = cross3(d, n_p)
    w = cross3(n_p, v)
    rho = dot3(n_p, d)
    return dot3(v, n_q), F.atan2(dot3(w, n_q), dot3(n_p, n_q)), rho / dist if rho_over_dist else rho


def unit_bin(value: Column, bins: int = 11) -> Column:
    """Bin of a value in [-1, 1]."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value + 1) * (bins / 2)))).cast("int")


def angle_bin(value: Column, bins: int = 11) -> Column:
    """Bin of an angle in [-pi, pi]."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value + math.pi) * (bins / (2 * math.pi))))).cast("int")


#: Fixed values of the mix that gives labels their colours: a factor and a mask, then by rounds how far the number is
#: shifted onto itself and the factor that follows; all modulo 2^32.
_COLOR_FIRST = (2654435761, 61)
_COLOR_ROUNDS = ((16, 9), (4, 668265261), (15, 1))


def label_color(label: Column) -> Column:
    """A stable colour (r, g, b in 0..1) of a label, white for 0: the three low bytes of the mixed label, red the lowest."""
    h = F.pmod(label.cast("long") * _COLOR_FIRST[0], F.lit(1 << 32))
    extra = F.lit(_COLOR_FIRST[1])
    for shift, factor in _COLOR_ROUNDS:
        h = F.pmod(h.bitwiseXOR(F.shiftright(h, shift)).bitwiseXOR(extra) * factor, F.lit(1 << 32))
        extra = F.lit(0)
    byte = lambda k: F.when(label == 0, 1.0).otherwise(F.shiftright(h, 8 * k).bitwiseAND(F.lit(255)) / 255.0)
    return F.struct(byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"))


def is_collinear(p1: Vec, p2: Vec, p3: Vec) -> Column:
    c = cross3(sub(p2, p1), sub(p3, p1))
    return dot3(c, c) < 1e-6
