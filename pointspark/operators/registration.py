"""Registration: descriptor matching, robust initial pose, iterative closest point."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.functions.linalg import kabsch, rigid_from_triples
from pointspark.functions.vec import affine, col3
from pointspark.operators.components import numbered
from pointspark.operators.descriptors import dense, fpfh
from pointspark.operators.keypoints import iss
from pointspark.operators.neighbors import Target, knn, positions, runs
from pointspark.operators.shape import normals
from pointspark.session import BROADCAST_ROWS, cut

#: Targets travel with the plan if they have no more numbers than this (counted).
BROADCAST_NUMBERS = 1_000_000
#: Beyond it anchors divide the targets, about the root of their number; read to the driver, so bounded.
PIVOTS = 1024


def transform(points: DataFrame, t) -> DataFrame:
    """The points moved by a 4x4 matrix; all other columns stay."""
    return points.withColumns(dict(zip("xyz", affine(col3("x", "y", "z"), t), strict=True)))


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _best(q: np.ndarray, t: np.ndarray, t_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of t, distance) of the nearest of t for each q, ties by smaller id; t comes in order of id."""
    at, dist = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
    scale = (t * t).sum(1).max()
    for f in range(0, len(q), 256):
        d = _sq(q[f : f + 256], t)
        margin = 1e-12 * (scale + (q[f : f + 256] ** 2).sum(1)) * t.shape[1]
        i, j = np.nonzero(d <= (d.min(1) + 2 * margin)[:, None])  # products preselect, differences decide
        e = np.sqrt(((q[f + i] - t[j]) ** 2).sum(1))
        o = np.lexsort((t_id[j], e, i))
        first = o[np.r_[True, i[o][1:] != i[o][:-1]]]
        at[f + i[first]], dist[f + i[first]] = j[first], e[first]
    return at, dist


def _features(b, column: str, dim: int) -> np.ndarray:
    c = b.column(column)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_MATCH = "src_idx long, tgt_idx long, dist double"


def feature_match(source: DataFrame, target: DataFrame, max_dist: float = 20.0, dim: int | None = None) -> DataFrame:
    """``(src_idx, tgt_idx, dist)``: for each source descriptor ``(idx, f)`` the nearest target one, if nearer than
    ``max_dist``; ties by smaller tgt_idx. Descriptors that are null, shorter than ``dim`` (or of another length than the
    first target, without it), or not finite take no part.

    Exact. Targets of a counted size travel with the plan, and sources stay where they are. Else targets belong to the
    nearest of some anchors; a source looks first into the part of its nearest anchor, then only into those parts that by
    the triangle inequality may hold a nearer one.
    """
    f = F.col("f").cast("array<double>")
    if dim is None:
        one = target.where("f IS NOT NULL").select(F.size("f").alias("n")).first()
        if one is None:
            return source.sparkSession.createDataFrame([], _MATCH)
        dim = one["n"]
        ok = F.size("f") == dim
    else:
        ok = F.size("f") >= dim
    ok = ok & F.col("idx").isNotNull() & F.forall(f, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    src, tgt = (d.where(ok).select("idx", F.slice(f, 1, dim).alias("f")) for d in (source, target))
    tgt = cut(tgt)
    n = tgt.count()
    if n * dim <= BROADCAST_NUMBERS:
        t = tgt.orderBy("idx").toArrow()
        t_id, tf = t.column("idx").to_numpy(), _features(t, "f", dim)

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(t_id) and len(b):
                    at, dist = _best(_features(b, "f", dim), tf, t_id)
                    yield pa.RecordBatch.from_arrays([b.column("idx"), pa.array(t_id[at]), pa.array(dist)], names=["src_idx", "tgt_idx", "dist"])

        return src.mapInArrow(direct, _MATCH).where(F.col("dist") < max_dist)
    n_parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, min(PIVOTS, n**0.5) / n)
    anchors = np.array([r["f"] for r in tgt.where(F.pmod(F.xxhash64("idx"), F.lit(1 << 32)) <= int(share * (1 << 32))).limit(2 * PIVOTS).collect()] or [tgt.first()["f"]])

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _sq(_features(b, "f", dim), anchors)
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1)), pa.array(np.sqrt(d.min(1))), b.column("idx"), b.column("f")], names=["part", "d", "idx", "f"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "part"):
            ids, x, asks = t.column("idx").to_numpy(), _features(t, "f", dim), t.column("asks").to_numpy()
            q, p = np.flatnonzero(asks), np.flatnonzero(~asks)
            p = p[np.argsort(ids[p], kind="stable")]
            if len(q) and len(p):
                at, dist = _best(x[q], x[p], ids[p])
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(ids[p[at]]), pa.array(dist)], names=["src_idx", "tgt_idx", "dist"])

    def visited(asked: DataFrame) -> DataFrame:
        both = tgt.select("part", "idx", "f", F.lit(False).alias("asks")).union(asked.select("part", "idx", "f", F.lit(True)))
        return both.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(visit, _MATCH)

    tgt = cut(tgt.mapInArrow(to_parts, "part long, d double, idx long, f array<double>"))
    reach = np.full(len(anchors), -np.inf)
    for r in tgt.groupBy("part").agg(F.max("d").alias("reach")).collect():  # one number an anchor
        reach[r["part"]] = r["reach"]
    src = src.mapInArrow(to_parts, "part long, d double, idx long, f array<double>")
    first = cut(visited(src))
    bound = src.join(first.select(F.col("src_idx").alias("idx"), "dist"), "idx", "left").select("idx", "f", "part", F.least(F.coalesce("dist", F.lit(float("inf"))), F.lit(float(max_dist))).alias("limit"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(_sq(_features(b, "f", dim), anchors)) * (1 - 1e-6) - reach[None]
            i, j = np.nonzero((d <= b.column("limit").to_numpy()[:, None] * (1 + 1e-9)) & (np.arange(len(anchors))[None] != b.column("part").to_numpy()[:, None]))
            rows = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(j), b.column("idx").take(rows), b.column("f").take(rows)], names=["part", "idx", "f"])

    more = visited(bound.mapInArrow(others, "part long, idx long, f array<double>"))
    both = first.union(more).groupBy("src_idx").agg(F.min(F.struct("dist", "tgt_idx")).alias("m"))
    return both.select("src_idx", F.col("m.tgt_idx").alias("tgt_idx"), F.col("m.dist").alias("dist")).where(F.col("dist") < max_dist)


def restricted_correspondence(source: DataFrame, target: DataFrame, neighbors: DataFrame, max_dist: float) -> DataFrame:
    """``(src_idx, tgt_idx, dist)``: nearest target among those whose idx the source's neighbour list names."""
    s, t = positions(source), positions(target)
    p = neighbors.select(F.col("idx").alias("src_idx"), F.col("nidx").alias("tgt_idx")).join(s.toDF("src_idx", "x", "y", "z"), "src_idx").join(t.toDF("tgt_idx", "tx", "ty", "tz"), "tgt_idx")
    dx, dy, dz = F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), F.col("tz") - F.col("z")
    p = p.withColumn("dist", F.sqrt(dx * dx + dy * dy + dz * dz)).where(F.col("dist") < max_dist)
    return p.groupBy("src_idx").agg(F.min(F.struct("dist", "tgt_idx")).alias("m")).select("src_idx", F.col("m.tgt_idx").alias("tgt_idx"), F.col("m.dist").alias("dist"))


def pair_sums(pairs: DataFrame) -> DataFrame:
    """One row of all a rigid fit needs of pairs ``(sx, sy, sz, tx, ty, tz, dist)``: number, mean distance, means and
    the cross-covariance ``h_ij = sum (t_i - mean)(s_j - mean)``."""
    agg = [F.count("*").alias("n"), F.avg("dist").alias("loss")]
    agg += [F.avg(c).alias(f"m{c}") for c in ("sx", "sy", "sz", "tx", "ty", "tz")]
    agg += [(F.covar_pop(f"t{a}", f"s{b}") * F.count("*")).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"]
    return pairs.agg(*agg)


def _fit(r) -> np.ndarray:
    h = np.array([[r[f"h{a}{b}"] for b in "xyz"] for a in "xyz"])
    return kabsch(h, np.array([r[f"ms{c}"] for c in "xyz"]), np.array([r[f"mt{c}"] for c in "xyz"]))


def matched_pairs(matches: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    s = positions(source).toDF("src_idx", "sx", "sy", "sz")
    t = positions(target).toDF("tgt_idx", "tx", "ty", "tz")
    return matches.select("src_idx", "tgt_idx", "dist").join(s, "src_idx").join(t, "tgt_idx")


@dataclass
class RansacResult:
    transform: np.ndarray
    inliers: int
    matches: int
    accepted: bool


def ransac(pairs: DataFrame, iterations: int = 500, threshold: float = 15.0, min_inliers: int | float = 0.3, seed: int = 1) -> RansacResult:
    """Robust rigid pose of pairs ``(src_idx, sx, sy, sz, tx, ty, tz)``.

    ``iterations`` triples are drawn with replacement by a seeded generator; collinear ones (and repeated points) are
    rejected. Every partition counts the inliers of all hypotheses (their number is a parameter, so they travel with the
    plan); the counts are summed, the first best hypothesis wins and is fitted again on its inliers. Fewer than 3 pairs
    or too few inliers (a share if ``min_inliers`` < 1) give the identity, not accepted.
    """
    p = numbered(pairs.select("src_idx", "sx", "sy", "sz", "tx", "ty", "tz", "dist"), "src_idx", "no")
    p = cut(p)
    n = p.count()
    need = max(3, int(np.ceil(min_inliers * n)) if min_inliers < 1 else int(min_inliers))
    nothing = RansacResult(np.eye(4), 0, n, False)
    if n < 3:
        return nothing
    draws = np.random.default_rng(seed).integers(0, n, (iterations, 3))
    rows = p.where(F.col("no").isin([int(v) for v in np.unique(draws)])).collect()  # at most 3 a hypothesis
    at = {r["no"]: ([r["sx"], r["sy"], r["sz"]], [r["tx"], r["ty"], r["tz"]]) for r in rows}
    s = np.array([[at[int(k)][0] for k in d] for d in draws])
    t = np.array([[at[int(k)][1] for k in d] for d in draws])
    flat = (np.cross(s[:, 1] - s[:, 0], s[:, 2] - s[:, 0]) ** 2).sum(1) < 1e-6
    poses = rigid_from_triples(s, t)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros(len(poses), np.int64)
        for b in batches:
            a, c = b[["sx", "sy", "sz"]].to_numpy(), b[["tx", "ty", "tz"]].to_numpy()
            for f in range(0, len(a), 1024):
                moved = np.einsum("hij,nj->hni", poses[:, :3, :3], a[f : f + 1024]) + poses[:, None, :3, 3]
                got += (((moved - c[None, f : f + 1024]) ** 2).sum(2) < threshold * threshold).sum(1)
        yield pd.DataFrame({"h": np.arange(len(poses)), "n": got})

    counts = np.zeros(len(poses), np.int64)
    for r in p.select("sx", "sy", "sz", "tx", "ty", "tz").mapInPandas(score, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect():
        counts[r["h"]] = r["n"]
    counts[flat] = -1
    h = int(counts.argmax())
    if counts[h] < need:
        return nothing
    moved = affine(col3("sx", "sy", "sz"), poses[h])
    gap = sum((m - F.col(f"t{c}")) * (m - F.col(f"t{c}")) for m, c in zip(moved, "xyz", strict=True))
    r = pair_sums(p.where(gap < threshold * threshold)).first()
    return RansacResult(_fit(r), int(r["n"]), n, True)


@dataclass
class IcpParams:
    max_correspondence_distance: float = 0.05
    max_iterations: int = 50
    transformation_epsilon: float = 1e-8
    euclidean_fitness_epsilon: float = 1.0
    initial: np.ndarray | None = None


@dataclass
class IcpResult:
    transform: np.ndarray
    reason: str
    history: list[float] = field(default_factory=list)


def _closest(source: DataFrame, target: Target, t: np.ndarray, max_dist: float) -> DataFrame:
    n = target.nearest(transform(source, t), max_dist)
    return n.select(F.col("idx").alias("src_idx"), F.col("nidx").alias("tgt_idx"), "dist", *[F.col(c).alias(f"s{c}") for c in "xyz"], *[(F.col(c) + F.col(f"d{c}")).alias(f"t{c}") for c in "xyz"])


def icp_point_to_point(source: DataFrame, target: DataFrame, params: IcpParams | None = None) -> IcpResult:
    """Rigid transform that lays the source onto the target.

    Each round moves the original source by the transform so far, pairs each point with its nearest target nearer than
    the maximum distance, and reads one row of sums. It ends with ``reason``: ``few`` (fewer than 3 pairs), ``fitness``
    (mean distance below its epsilon), ``transformation`` (change below its epsilon) or ``iterations``.
    """
    params = params or IcpParams()
    t = np.eye(4) if params.initial is None else np.array(params.initial, float).reshape(4, 4)
    s, g = cut(positions(source)), Target(target)
    history: list[float] = []
    for _ in range(params.max_iterations):
        r = pair_sums(_closest(s, g, t, params.max_correspondence_distance)).first()
        if r["n"] < 3:
            return IcpResult(t, "few", history)
        history.append(r["loss"])
        if r["loss"] < params.euclidean_fitness_epsilon:
            return IcpResult(t, "fitness", history)
        new = _fit(r) @ t
        change = float(np.linalg.norm(new - t))
        t = new
        if change < params.transformation_epsilon:
            return IcpResult(t, "transformation", history)
    return IcpResult(t, "iterations", history)


def _motion(x: np.ndarray) -> np.ndarray:
    """The rigid motion of a rotation vector and a shift."""
    k = np.array([[0, -x[2], x[1]], [x[2], 0, -x[0]], [-x[1], x[0], 0]])
    angle = np.linalg.norm(x[:3])
    step = np.eye(4)
    step[:3, :3] += k * (np.sinc(angle / np.pi)) + k @ k * (0.5 * np.sinc(angle / (2 * np.pi)) ** 2)
    step[:3, 3] = x[3:]
    return step


_SUMS = ["n", "loss", *[f"a{i}{j}" for i in range(6) for j in range(i, 6)], *[f"b{i}" for i in range(6)]]


def _weighted(pairs: DataFrame, metric) -> tuple[int, float, np.ndarray]:
    """Number and mean loss of pairs, and the small motion that lays their sources onto their targets best.

    ``metric(batch)`` gives for each pair a 3x3 metric, a weight and a loss. Each partition adds up 6x6 normal equations.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(_SUMS))
        for b in batches:
            p, t = (np.stack([b.column(f"{s}{c}").to_numpy() for c in "xyz"], 1) for s in "st")
            m, w, loss = metric(b)
            a = np.zeros((len(p), 3, 6))
            a[:, 0, 1], a[:, 0, 2], a[:, 1, 0], a[:, 1, 2], a[:, 2, 0], a[:, 2, 1] = p[:, 2], -p[:, 1], -p[:, 2], p[:, 0], p[:, 1], -p[:, 0]
            a[:, range(3), range(3, 6)] = 1
            am = np.einsum("nki,nkl,n->nil", a, m, w)
            h, g = np.einsum("nil,nlj->ij", am, a), np.einsum("nil,nl->i", am, t - p)
            total += np.r_[len(p), loss.sum(), h[np.triu_indices(6)], g]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=_SUMS)

    r = pairs.mapInArrow(part, ", ".join(f"{c} double" for c in _SUMS)).agg(*[F.sum(c).alias(c) for c in _SUMS]).first()
    n = int(r["n"] or 0)
    if n < 6:
        return n, 0.0, np.eye(4)
    h = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
    return n, r["loss"] / n, _motion(np.linalg.lstsq(h, np.array([r[f"b{i}"] for i in range(6)]), rcond=None)[0])


def _rounds(step, params: IcpParams) -> IcpResult:
    """Moves by ``step(t) -> (pairs, loss, motion)`` until one of the ends of ``icp_point_to_point``."""
    t = np.eye(4) if params.initial is None else np.array(params.initial, float).reshape(4, 4)
    history: list[float] = []
    for _ in range(params.max_iterations):
        n, loss, motion = step(t)
        if n < 6:
            return IcpResult(t, "few", history)
        history.append(loss)
        if loss < params.euclidean_fitness_epsilon:
            return IcpResult(t, "fitness", history)
        new = motion @ t
        change = float(np.linalg.norm(new - t))
        t = new
        if change < params.transformation_epsilon:
            return IcpResult(t, "transformation", history)
    return IcpResult(t, "iterations", history)


def icp_plane_to_plane(source: DataFrame, source_normals: DataFrame, target: DataFrame, target_normals: DataFrame, params: IcpParams | None = None, flat: float = 1e-3) -> IcpResult:
    """Like point to point, but both points of a pair stand for a piece of surface: their covariance is 1 along the surface
    and ``flat`` across it, and a pair counts by the inverse of the sum of both. Points without a normal take no part."""
    params = params or IcpParams()
    normal = lambda n, key, p: n.where("nx IS NOT NULL").select(F.col("idx").alias(key), *[F.col(f"n{c}").alias(f"{p}{c}") for c in "xyz"])
    sn, tn = cut(normal(source_normals, "src_idx", "u")), cut(normal(target_normals, "tgt_idx", "v"))
    s, g = cut(positions(source)), Target(target)

    def step(t: np.ndarray):
        turn = t[:3, :3]

        def metric(b):
            u, v = (np.stack([b.column(f"{p}{c}").to_numpy() for c in "xyz"], 1) for p in "uv")
            u = u @ turn.T
            c = 2 * np.eye(3) - (1 - flat) * (u[:, :, None] * u[:, None] + v[:, :, None] * v[:, None])
            return np.linalg.inv(c), np.ones(len(u)), b.column("dist").to_numpy()

        return _weighted(_closest(s, g, t, params.max_correspondence_distance).join(sn, "src_idx").join(tn, "tgt_idx"), metric)

    return _rounds(step, params)


def icp_point_to_plane(source: DataFrame, target: DataFrame, target_normals: DataFrame, params: IcpParams | None = None) -> IcpResult:
    """Like point to point, but each round solves the linearised distance to the target's tangent planes: 6 x 6 normal
    equations that are one aggregate."""
    params = params or IcpParams()
    t = np.eye(4) if params.initial is None else np.array(params.initial, float).reshape(4, 4)
    s, g = cut(positions(source)), Target(target)
    n = target_normals.select(F.col("idx").alias("tgt_idx"), "nx", "ny", "nz").where("nx IS NOT NULL")
    history: list[float] = []
    for _ in range(params.max_iterations):
        p = _closest(s, g, t, params.max_correspondence_distance).join(n, "tgt_idx")
        a = [F.col("sy") * F.col("nz") - F.col("sz") * F.col("ny"), F.col("sz") * F.col("nx") - F.col("sx") * F.col("nz"), F.col("sx") * F.col("ny") - F.col("sy") * F.col("nx"), F.col("nx"), F.col("ny"), F.col("nz")]
        b = sum((F.col(f"t{c}") - F.col(f"s{c}")) * F.col(f"n{c}") for c in "xyz")
        sums = [F.sum(a[i] * a[j]).alias(f"a{i}{j}") for i in range(6) for j in range(i, 6)] + [F.sum(v * b).alias(f"b{i}") for i, v in enumerate(a)]
        r = p.agg(F.count("*").alias("n"), F.avg("dist").alias("loss"), *sums).first()
        if r["n"] < 6:
            return IcpResult(t, "few", history)
        history.append(r["loss"])
        if r["loss"] < params.euclidean_fitness_epsilon:
            return IcpResult(t, "fitness", history)
        m = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
        x = np.linalg.lstsq(m, np.array([r[f"b{i}"] for i in range(6)]), rcond=None)[0]
        new = _motion(x) @ t
        change = float(np.linalg.norm(new - t))
        t = new
        if change < params.transformation_epsilon:
            return IcpResult(t, "transformation", history)
    return IcpResult(t, "iterations", history)


def ndt_cells(target: DataFrame, cell: float, min_pts: int = 5) -> DataFrame:
    """``(ix, iy, iz, n, mx, my, mz, cxx, ..., czz)``: normal distribution of the points of each voxel that holds enough."""
    p = positions(target)
    key = [F.floor(F.col(c) / cell).cast("long").alias(f"i{c}") for c in "xyz"]
    cov = [F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))]
    return p.groupBy(*key).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *cov).where(F.col("n") >= min_pts)


def ndt(source: DataFrame, target: DataFrame, cell: float, min_pts: int = 5, params: IcpParams | None = None) -> IcpResult:
    """Rigid transform by normal distributions: each source point is drawn to the mean of its target voxel by the inverse of
    the voxel's covariance, weighted by its likelihood there. Points in voxels without a distribution take no part.
    Variances are at least a thousandth of the voxel's largest. The loss of a round is 1 minus the mean likelihood."""
    params = params or IcpParams()
    cells = cut(ndt_cells(target, cell, min_pts))
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    s = cut(positions(source))

    def metric(b):
        get = lambda *names: [b.column(n).to_numpy() for n in names]
        xx, xy, xz, yy, yz, zz = get("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
        w, v = np.linalg.eigh(np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).reshape(-1, 3, 3))
        w = np.maximum(w, np.maximum(1e-3 * w[:, -1:], 1e-12))
        m = np.einsum("nij,nj,nkj->nik", v, 1 / w, v)
        d = np.stack(get("tx", "ty", "tz"), 1) - np.stack(get("sx", "sy", "sz"), 1)
        like = np.exp(-0.5 * np.einsum("ni,nij,nj->n", d, m, d))
        return m, like, 1 - like

    def step(t: np.ndarray):
        moved = transform(s, t).select(*[F.floor(F.col(c) / cell).cast("long").alias(f"i{c}") for c in "xyz"], *[F.col(c).alias(f"s{c}") for c in "xyz"])
        return _weighted(moved.join(cells, ["ix", "iy", "iz"]).withColumnsRenamed({f"m{c}": f"t{c}" for c in "xyz"}), metric)

    return _rounds(step, params)


def keypoint_features(points: DataFrame, k: int, nms_radius: float, radius: float, g21: float = 0.35, g32: float = 0.75) -> DataFrame:
    """``(idx, f)``: FPFH of the ISS keypoints of a cloud."""
    n = cut(knn(points, k))
    key = cut(iss(n, nms_radius, g21, g32).where("is_keypoint").select("idx"))
    return dense(fpfh(n, cut(normals(n)), k, radius, key), 33)


def initial_pose(source: DataFrame, target: DataFrame, k: int = 32, nms_radius: float = 5.0, radius: float = 5.0, g21: float = 0.35, g32: float = 0.75, max_feature_dist: float = 20.0, iterations: int = 500, threshold: float = 15.0, min_inliers: float = 0.3, seed: int = 1) -> RansacResult:
    """Keypoints and descriptors of both clouds, matched and fitted robustly."""
    m = feature_match(keypoint_features(source, k, nms_radius, radius, g21, g32), keypoint_features(target, k, nms_radius, radius, g21, g32), max_feature_dist)
    return ransac(matched_pairs(m, source, target), iterations, threshold, min_inliers, seed)


