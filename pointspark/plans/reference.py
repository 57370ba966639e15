"""Queries of the point-cloud operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import math
import struct
import uuid

from pyspark.sql import functions as F

from pointspark.functions import vec
from pointspark.functions.linalg import centroid
from pointspark.operators import cluster, denoise, descriptors, downsample, keypoints, neighbors, registration, shape
from pointspark.plans import fixtures as fx
from pointspark.session import cut, shared_dir, table
from pointspark.sources import clouds

BOX = (-0.5, 0.5, -0.5, 0.5, -0.5, 0.5)
V_BOX, V_CELL = (0.0, 1600.0, 0.0, 600.0, 0.0, 32.0), (4.0, 4.0, 2.0)
L_BOX = (0.0, 60.0, 0.0, 60.0, 0.0, 20.0)

QUERIES = {}
SQL = {}


def _q(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(*names: str, digits: int = 6):
    return [(F.round(n, digits) + 0.0).alias(n) for n in names]


# ---------------------------------------------------------------- SQL parts

E = "e AS (SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
EN = "m AS (SELECT vec_id AS idx, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c FROM embeddings), en AS (SELECT idx, a / sqrt(a*a+b*b+c*c) AS nx, b / sqrt(a*a+b*b+c*c) AS ny, c / sqrt(a*a+b*b+c*c) AS nz FROM m)"


def _r_sql(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def _moved_sql(src: str = "e", name: str = "em") -> str:
    m = fx.POSE
    row = lambda r: f"x * ({m[r, 0]!r}) + y * ({m[r, 1]!r}) + z * ({m[r, 2]!r}) + ({m[r, 3]!r})".replace("np.float64(", "(")
    return f"{name} AS (SELECT idx, {row(0)} AS x, {row(1)} AS y, {row(2)} AS z FROM {src})"


def _knn_sql(k: int, src: str = "e") -> str:
    return (
        f"d0 AS (SELECT p.idx, q.idx AS nidx, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM {src} p JOIN {src} q ON p.idx <> q.idx), "
        "d AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS dist FROM d0), "
        "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY idx ORDER BY dist, nidx) AS INTEGER) AS rank FROM d), "
        f"nb AS (SELECT * FROM r WHERE rank <= {k})"
    )


_P = ("xx", "xy", "xz", "yy", "yz", "zz")
COV_SQL = (
    "s AS (SELECT idx, count(*) AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dz) AS sz, " + ", ".join(f"sum(d{p[0]} * d{p[1]}) AS s{p}" for p in _P) + " FROM nb GROUP BY idx), "
    "cov AS (SELECT idx, n, " + ", ".join(f"s{p} / (n + 1) - (s{p[0]} / (n + 1)) * (s{p[1]} / (n + 1)) AS c{p}" for p in _P) + " FROM s)"
)


def _wcov_sql(radius: float) -> str:
    w = f"abs(dist - {radius})"
    return (
        f"s AS (SELECT idx, sum({w}) AS w, sum(dx) AS sx, sum(dy) AS sy, sum(dz) AS sz, " + ", ".join(f"sum({w} * d{p[0]} * d{p[1]}) AS s{p}" for p in _P) + " FROM nb GROUP BY idx), "
        "cov AS (SELECT idx, w, sx, sy, sz, " + ", ".join(f"CASE WHEN w > 1e-6 THEN s{p} / w END AS c{p}" for p in _P) + " FROM s)"
    )


EIG_SQL = (
    "g1 AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM cov), "
    "g2 AS (SELECT *, sqrt(((cxx-q)*(cxx-q) + (cyy-q)*(cyy-q) + (czz-q)*(czz-q) + 2*(cxy*cxy + cxz*cxz + cyz*cyz)) / 6) AS p FROM g1), "
    "g3 AS (SELECT *, CASE WHEN p > 0 THEN p ELSE 1.0 END AS sc FROM g2), "
    "g4 AS (SELECT *, ((cxx-q)/sc) * (((cyy-q)/sc) * ((czz-q)/sc) - (cyz/sc)*(cyz/sc)) - (cxy/sc) * ((cxy/sc)*((czz-q)/sc) - (cyz/sc)*(cxz/sc)) + (cxz/sc) * ((cxy/sc)*(cyz/sc) - ((cyy-q)/sc)*(cxz/sc)) AS det FROM g3), "
    "g5 AS (SELECT *, acos(greatest(-1.0, least(1.0, det / 2))) / 3 AS phi FROM g4), "
    f"eig AS (SELECT *, q + 2*p*cos(phi) AS l1, 3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + {2 * math.pi / 3!r})) AS l2, q + 2*p*cos(phi + {2 * math.pi / 3!r}) AS l3 FROM g5)"
)


def _vec_sql(src: str, lam: str, out: str, name: str) -> str:
    """Common table expressions for the unit eigenvector of ``lam`` as columns out || x, y, z."""
    rows = [(f"(cxx-{lam})", "cxy", "cxz"), ("cxy", f"(cyy-{lam})", "cyz"), ("cxz", "cyz", f"(czz-{lam})")]

    def cross(a, b):
        return [f"({a[1]}*{b[2]} - {a[2]}*{b[1]})", f"({a[2]}*{b[0]} - {a[0]}*{b[2]})", f"({a[0]}*{b[1]} - {a[1]}*{b[0]})"]

    c = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    t = f"{name}1 AS (SELECT *, " + ", ".join(f"{v} AS {out}{k}{a}" for k in range(3) for a, v in zip("xyz", c[k], strict=True)) + f" FROM {src}), "
    t += f"{name}2 AS (SELECT *, " + ", ".join(f"{out}{k}x*{out}{k}x + {out}{k}y*{out}{k}y + {out}{k}z*{out}{k}z AS {out}n{k}" for k in range(3)) + f" FROM {name}1), "
    pick = lambda a: f"CASE WHEN {out}n0 >= {out}n1 AND {out}n0 >= {out}n2 THEN {out}0{a} WHEN {out}n1 >= {out}n2 THEN {out}1{a} ELSE {out}2{a} END"
    t += f"{name}3 AS (SELECT *, sqrt(greatest({out}n0, {out}n1, {out}n2)) AS {out}n, {pick('x')} AS {out}px, {pick('y')} AS {out}py, {pick('z')} AS {out}pz FROM {name}2), "
    lead = f"CASE WHEN abs({out}px) >= abs({out}py) AND abs({out}px) >= abs({out}pz) THEN {out}px WHEN abs({out}py) >= abs({out}pz) THEN {out}py ELSE {out}pz END"
    t += f"{name} AS (SELECT *, " + ", ".join(f"{out}p{a} / {out}n * (CASE WHEN ({lead}) < 0 THEN -1.0 ELSE 1.0 END) AS {out}{a}" for a in "xyz") + f" FROM {name}3)"
    return t


# ---------------------------------------------------------------- scans and scalar functions


@_q(f"WITH {E} SELECT idx, x, y, z, CAST(1.0 AS DOUBLE) AS intensity, CAST(-1 AS INTEGER) AS label FROM e")
def point_scan(spark, d):
    return fx.cloud(spark, d)


def _next(spark, d, step: int = 1, names: str = "uvw"):
    p = fx.cloud(spark, d).select((F.col("idx") - step).alias("idx"), *[F.col(c).alias(n) for c, n in zip("xyz", names, strict=True)])
    return p


@_q(f"WITH {E} SELECT a.idx, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) + 0.0 AS dist, round(a.x*b.x+a.y*b.y+a.z*b.z, 6) + 0.0 AS dot, round(a.y*b.z-a.z*b.y, 6) + 0.0 AS cx, round(a.z*b.x-a.x*b.z, 6) + 0.0 AS cy, round(a.x*b.y-a.y*b.x, 6) + 0.0 AS cz FROM e a JOIN e b ON b.idx = a.idx + 1")
def vec_dist_dot_cross(spark, d):
    p = fx.cloud(spark, d).join(_next(spark, d), "idx")
    a, b = vec.col3("x", "y", "z"), vec.col3("u", "v", "w")
    c = vec.cross3(a, b)
    return p.select("idx", vec.distance(a, b).alias("dist"), vec.dot3(a, b).alias("dot"), c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz")).select("idx", *_r("dist", "dot", "cx", "cy", "cz"))


@_q(f"WITH {E} SELECT a.idx, round(1e6*((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))/65536.0, 6) + 0.0 AS sq FROM e a JOIN e b ON b.idx = a.idx + 1")
def scaled_distance(spark, d):
    p = fx.cloud(spark, d).join(_next(spark, d), "idx")
    return p.select("idx", (vec.scaled_square_distance(vec.col3("x", "y", "z"), vec.col3("u", "v", "w")) * 1e6).alias("sq")).select("idx", *_r("sq"))


@_q("SELECT a.vec_id AS idx, round(list_distance(CAST(a.embedding[1:33] AS DOUBLE[]), CAST(b.embedding[1:33] AS DOUBLE[])), 6) + 0.0 AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_l2_33(spark, d):
    f = fx.features(spark, d)
    g = f.select((F.col("idx") - 1).alias("idx"), F.col("f").alias("g"))
    return f.join(g, "idx").select("idx", vec.distance_l2(F.col("f"), F.col("g"), 33).alias("dist")).select("idx", *_r("dist"))


@_q(f"WITH {E}, {_moved_sql()} SELECT idx, {_r_sql('x', 'y', 'z')}, CAST(1.0 AS DOUBLE) AS intensity, CAST(-1 AS INTEGER) AS label FROM em")
def rigid_transform(spark, d):
    return fx.moved_cloud(spark, d).select("idx", *_r("x", "y", "z"), "intensity", "label")


@_q(f"WITH {E} SELECT count(x) AS n, round(avg(x), 9) + 0.0 AS cx, round(avg(y), 9) + 0.0 AS cy, round(avg(z), 9) + 0.0 AS cz FROM e")
def centroid_of_cloud(spark, d):
    return centroid(fx.cloud(spark, d)).select("n", *_r("cx", "cy", "cz", digits=9))


@_q(f"WITH {E} SELECT idx, round(x - (SELECT avg(x) FROM e), 6) + 0.0 AS x, round(y - (SELECT avg(y) FROM e), 6) + 0.0 AS y, round(z - (SELECT avg(z) FROM e), 6) + 0.0 AS z FROM e")
def center_points(spark, d):
    p = fx.cloud(spark, d)
    c = centroid(p).first()
    return p.select("idx", *[(F.col(a) - F.lit(c[f"c{a}"])).alias(a) for a in "xyz"]).select("idx", *_r("x", "y", "z"))


@_q(f"WITH {E}, g AS (SELECT idx, CAST(floor((x + 0.5) * 10.0) AS BIGINT) AS ix, CAST(floor((y + 0.5) * 10.0) AS BIGINT) AS iy, CAST(floor((z + 0.5) * 10.0) AS BIGINT) AS iz FROM e) SELECT idx, (iz * 10 + iy) * 10 + ix AS voxel_id, ix, iy, iz FROM g WHERE ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 9 AND iz BETWEEN 0 AND 9")
def voxel_decode(spark, d):
    v = cluster.voxelize(fx.cloud(spark, d), BOX, 0.1).where("voxel_id IS NOT NULL").select("idx", "voxel_id")
    ix, iy, iz = vec.voxel_indices(F.col("voxel_id"), 10, 10)
    return v.select("idx", "voxel_id", ix.cast("long").alias("ix"), iy.alias("iy"), iz.alias("iz"))


@_q(
    f"WITH {E}, v AS (SELECT idx, (x + 0.3) / 0.05 AS v FROM e), f AS (SELECT idx, v, CAST(floor(v) AS INTEGER) AS i, v - floor(v) AS fr FROM v), "
    "o AS (SELECT idx, CASE WHEN v < 0 THEN 0 WHEN i >= 12 THEN 11 ELSE i END AS bin, CASE WHEN v < 0 OR i >= 12 THEN 1.0 ELSE 1 - fr END AS w FROM f UNION ALL SELECT idx, least(i + 1, 11) AS bin, fr AS w FROM f WHERE v >= 0 AND i < 12) "
    "SELECT idx, CAST(bin AS INTEGER) AS bin, round(w, 6) + 0.0 AS w FROM o"
)
def binning_weights(spark, d):
    p = fx.cloud(spark, d).select("idx", F.explode(vec.binning_weight(F.col("x") + 0.3, 0.05, 0.6)).alias("b"))
    return p.select("idx", F.col("b.bin").alias("bin"), F.col("b.w").alias("w")).select("idx", "bin", *_r("w"))


@_q(f"WITH {E} SELECT idx, round(sqrt(x*x+y*y+z*z), 6) + 0.0 AS rho, round(atan2(z, y), 6) + 0.0 AS alpha, round(acos(greatest(-1.0, least(1.0, x / sqrt(x*x+y*y+z*z)))), 6) + 0.0 AS beta FROM e")
def spherical_frame(spark, d):
    """Spherical coordinates in the frame with axes (y, z, x)."""
    one = lambda *v: tuple(F.lit(float(a)) for a in v)
    rho, alpha, beta = vec.spherical_in_frame(vec.col3("x", "y", "z"), one(0, 1, 0), one(0, 0, 1), one(1, 0, 0))
    return fx.cloud(spark, d).select("idx", rho.alias("rho"), alpha.alias("alpha"), beta.alias("beta")).select("idx", *_r("rho", "alpha", "beta"))


@_q(f"WITH {EN} SELECT idx, round(acos(greatest(-1.0, least(1.0, nz / sqrt(nx*nx+ny*ny+nz*nz)))), 6) + 0.0 AS theta, round(CASE WHEN atan2(ny, nx) < 0 THEN atan2(ny, nx) + {2 * math.pi!r} ELSE atan2(ny, nx) END, 6) + 0.0 AS phi FROM en")
def normal_angle(spark, d):
    theta, phi = vec.normal_angles(vec.col3("nx", "ny", "nz"))
    return fx.pseudo_normals(spark, d).select("idx", theta.alias("theta"), phi.alias("phi")).select("idx", *_r("theta", "phi"))


@_q(f"WITH {E} SELECT a.idx, ((b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y))*((b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y)) + ((b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z))*((b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z)) + ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x))*((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) < 1e-6 AS collinear FROM e a JOIN e b ON b.idx = a.idx + 1 JOIN e c ON c.idx = a.idx + 2")
def collinear_triples(spark, d):
    p = fx.cloud(spark, d).join(_next(spark, d), "idx").join(_next(spark, d, 2, "pqr"), "idx")
    return p.select("idx", vec.is_collinear(vec.col3("x", "y", "z"), vec.col3("u", "v", "w"), vec.col3("p", "q", "r")).alias("collinear"))


@_q(
    "WITH h0 AS (SELECT DISTINCT label, (CAST(label AS BIGINT) * 2654435761) % 4294967296 AS u FROM embeddings), h1 AS (SELECT label, (xor(xor(u, u >> 16), 61) * 9) % 4294967296 AS u FROM h0), "
    "h2 AS (SELECT label, (xor(u, u >> 4) * 668265261) % 4294967296 AS u FROM h1), h3 AS (SELECT label, xor(u, u >> 15) AS u FROM h2) "
    "SELECT label, CASE WHEN label = 0 THEN 1.0 ELSE (u % 256) / 255.0 END AS r, CASE WHEN label = 0 THEN 1.0 ELSE ((u >> 8) % 256) / 255.0 END AS g, CASE WHEN label = 0 THEN 1.0 ELSE ((u >> 16) % 256) / 255.0 END AS b FROM h3"
)
def label_colors(spark, d):
    return table(spark, d, "embeddings").select("label").distinct().select("label", vec.label_color(F.col("label")).alias("c")).select("label", "c.*")


# ---------------------------------------------------------------- neighbours and outliers


def _nb(spark, d, k):
    return neighbors.knn(fx.cloud(spark, d), k)


@_q(f"WITH {E}, {_knn_sql(8)} SELECT idx, nidx, rank, round(dist, 6) + 0.0 AS dist FROM nb")
def knn_k8(spark, d):
    return _nb(spark, d, 8).select("idx", "nidx", "rank", *_r("dist"))


@_q(f"WITH {E}, {_knn_sql(32)} SELECT idx, nidx, rank, round(dist, 6) + 0.0 AS dist FROM nb")
def knn_k32(spark, d):
    return _nb(spark, d, 32).select("idx", "nidx", "rank", *_r("dist"))


_MAP = "e AS (SELECT idx, min(x) AS x, min(y) AS y, min(z) AS z FROM points WHERE cloud_id = 'map-000' AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) GROUP BY idx)"


@_q(f"WITH {_MAP}, {_knn_sql(8)} SELECT idx, nidx, rank, round(dist, 6) + 0.0 AS dist FROM nb")
def knn_map(spark, d):
    """The largest cloud of the point table, of many blocks and very unequal density."""
    return neighbors.knn(table(spark, d, "points").where("cloud_id = 'map-000'"), 8).select("idx", "nidx", "rank", *_r("dist"))


@_q(f"WITH {E}, {_knn_sql(8)} SELECT idx, list(nidx ORDER BY rank) AS nn FROM nb GROUP BY idx")
def knn_wide(spark, d):
    g = _nb(spark, d, 8).groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("rank", "nidx"))).alias("s"))
    return g.select("idx", F.transform("s", lambda s: s["nidx"]).alias("nn"))


@_q(f"WITH {E}, {_knn_sql(1)} SELECT idx, nidx, round(dist, 6) + 0.0 AS dist FROM d WHERE dist <= 0.1")
def radius_neighbors(spark, d):
    return neighbors.radius_neighbors(fx.cloud(spark, d), 0.1).select("idx", "nidx", *_r("dist"))


@_q(f"WITH {E}, {_knn_sql(32)} SELECT idx, round(sum(CASE WHEN dist <= 0.1 THEN dist ELSE 0.0 END) / 32, 6) + 0.0 AS mean_dist FROM nb GROUP BY idx")
def knn_mean_dist(spark, d):
    return denoise.mean_distance(_nb(spark, d, 32), 32, 0.1).select("idx", *_r("mean_dist"))


_OUT = f"WITH {E}, {_knn_sql(32)}, md AS (SELECT idx, sum(dist) / 32 AS mean_dist FROM nb GROUP BY idx), st AS (SELECT count(*) AS n, avg(mean_dist) AS mu, stddev_pop(mean_dist) AS sigma FROM md)"


@_q(f"{_OUT} SELECT n, round(mu, 6) + 0.0 AS mu, round(sigma, 6) + 0.0 AS sigma FROM st")
def outlier_stats(spark, d):
    return denoise.outlier_stats(denoise.mean_distance(_nb(spark, d, 32), 32)).select("n", *_r("mu", "sigma"))


@_q(f"{_OUT} SELECT md.idx, round(mean_dist, 6) + 0.0 AS mean_dist, mean_dist >= mu + 1.0 * sigma AS is_outlier, CAST(CASE WHEN mean_dist >= mu + 1.0 * sigma THEN -2 ELSE -1 END AS INTEGER) AS label FROM md, st")
def outlier_flag(spark, d):
    p = fx.cloud(spark, d)
    return denoise.statistical_outlier(p, cut(neighbors.knn(p, 32)), 32, alpha=1.0).select("idx", *_r("mean_dist"), "is_outlier", "label")


# ---------------------------------------------------------------- voxels and clusters

_V = "v AS (SELECT event_id AS idx, CAST(user_id AS DOUBLE) AS x, value AS y, (CAST(epoch_us(ts) AS DOUBLE) / 1e6 - 1704067200.0) / 86400.0 AS z FROM events), vv AS (SELECT idx, CAST(floor(x * 0.25) AS BIGINT) AS ix, CAST(floor(y * 0.25) AS BIGINT) AS iy, CAST(floor(z * 0.5) AS BIGINT) AS iz FROM v WHERE x >= 0 AND y >= 0 AND z >= 0), vx AS (SELECT idx, (iz * 150 + iy) * 400 + ix AS voxel_id, ix, iy, iz FROM vv WHERE ix < 400 AND iy < 150 AND iz < 16)"
_L = "l AS (SELECT l_quantity AS x, l_extendedprice / 2000 AS y, (l_discount + l_tax) * 100 AS z FROM lineitem), ll AS (SELECT CAST(floor(x * 0.5) AS BIGINT) AS ix, CAST(floor(y * 0.5) AS BIGINT) AS iy, CAST(floor(z * 0.5) AS BIGINT) AS iz FROM l WHERE x >= 0 AND y >= 0 AND z >= 0), lx AS (SELECT (iz * 30 + iy) * 30 + ix AS voxel_id, ix, iy, iz FROM ll WHERE ix < 30 AND iy < 30 AND iz < 10)"


@_q(f"WITH {_V} SELECT idx, ix, iy, iz, voxel_id FROM vx")
def voxelize(spark, d):
    return cluster.voxelize(fx.event_cloud(spark, d), V_BOX, V_CELL).where("voxel_id IS NOT NULL").select("idx", "ix", "iy", "iz", "voxel_id")


@_q(f"WITH {_L} SELECT voxel_id, ix, iy, iz, count(*) AS n, count(*) >= 10 AS is_core FROM lx GROUP BY ALL")
def voxel_count(spark, d):
    return cluster.voxel_counts(cluster.voxelize(fx.line_cloud(spark, d), L_BOX, 2.0), 10)


@_q(f"WITH {_V}, c AS (SELECT voxel_id, count(*) AS n FROM vx GROUP BY voxel_id) SELECT voxel_id, n FROM c WHERE n >= 5")
def voxel_core(spark, d):
    return cluster.voxel_counts(cluster.voxelize(fx.event_cloud(spark, d), V_BOX, V_CELL), 5).where("is_core").select("voxel_id", "n")


@_q(f"WITH {_L}, c AS (SELECT voxel_id, count(*) AS n FROM lx GROUP BY voxel_id) SELECT voxel_id, n, CAST(coalesce(sum(n) OVER (ORDER BY voxel_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def voxel_offsets(spark, d):
    return cluster.voxel_offsets(cluster.voxel_counts(cluster.voxelize(fx.line_cloud(spark, d), L_BOX, 2.0), 10))


def _evox(g: int) -> str:
    return f"gi AS (SELECT idx, CAST(floor((x + 0.5) * {float(g)}) AS BIGINT) AS ix, CAST(floor((y + 0.5) * {float(g)}) AS BIGINT) AS iy, CAST(floor((z + 0.5) * {float(g)}) AS BIGINT) AS iz FROM e), gx AS (SELECT idx, (iz * {g} + iy) * {g} + ix AS voxel_id, ix, iy, iz FROM gi WHERE ix BETWEEN 0 AND {g - 1} AND iy BETWEEN 0 AND {g - 1} AND iz BETWEEN 0 AND {g - 1}), vo AS (SELECT voxel_id, ix, iy, iz, count(*) AS n FROM gx GROUP BY voxel_id, ix, iy, iz), adj AS (SELECT p.voxel_id AS src, q.voxel_id AS dst, p.n AS sn, q.n AS dn FROM vo p JOIN vo q ON q.ix BETWEEN p.ix - 1 AND p.ix + 1 AND q.iy BETWEEN p.iy - 1 AND p.iy + 1 AND q.iz BETWEEN p.iz - 1 AND p.iz + 1)"


@_q(f"WITH {E}, {_evox(10)} SELECT src, dst FROM adj")
def voxel_adjacency(spark, d):
    return cluster.voxel_adjacency(cluster.voxel_counts(cluster.voxelize(fx.cloud(spark, d), BOX, 0.1), 5))


_DB = (
    f"WITH RECURSIVE {E}, {_evox(25)}, ce AS (SELECT src, dst FROM adj WHERE sn >= 3 AND dn >= 3), "
    "reach AS (SELECT voxel_id AS a, voxel_id AS b FROM vo WHERE n >= 3 UNION SELECT r.a, c.dst FROM reach r JOIN ce c ON c.src = r.b), "
    "ro AS (SELECT a AS voxel_id, min(b) AS root FROM reach GROUP BY a), "
    "cl AS (SELECT voxel_id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS cluster_id FROM ro), "
    "bo AS (SELECT adj.src AS voxel_id, arg_min(cl.cluster_id, adj.dst) AS cluster_id FROM adj JOIN cl ON cl.voxel_id = adj.dst WHERE adj.sn < 3 GROUP BY adj.src), "
    "va AS (SELECT voxel_id, true AS is_core, cluster_id FROM cl UNION ALL SELECT voxel_id, false, cluster_id FROM bo)"
)


@_q(f"{_DB} SELECT voxel_id, is_core, cluster_id FROM va")
def voxel_components(spark, d):
    return cluster.voxel_clusters(cluster.voxel_counts(cluster.voxelize(fx.cloud(spark, d), BOX, 0.04), 3))


@_q(f"{_DB} SELECT gx.idx, gx.voxel_id, va.cluster_id, CAST(va.cluster_id AS INTEGER) AS label FROM gx JOIN va USING (voxel_id)")
def dbscan_points(spark, d):
    return cluster.voxel_dbscan(fx.cloud(spark, d), BOX, 0.04, 3).select("idx", "voxel_id", "cluster_id", "label")


@_q(f"{_DB} SELECT va.cluster_id AS label, count(*) AS n FROM gx JOIN va USING (voxel_id) GROUP BY va.cluster_id")
def cluster_distribution(spark, d):
    return cluster.distribution(cluster.voxel_dbscan(fx.cloud(spark, d), BOX, 0.04, 3))


# ---------------------------------------------------------------- shape, keypoints, sampling


@_q(f"WITH {E}, {_knn_sql(32)}, {COV_SQL} SELECT idx, n, {_r_sql(*[f'c{p}' for p in _P])} FROM cov")
def covariance(spark, d):
    return shape.covariance(_nb(spark, d, 32)).select("idx", "n", *_r(*shape.COV))


@_q(f"WITH {E}, {_knn_sql(32)}, {_wcov_sql(0.15)} SELECT idx, round(w, 6) + 0.0 AS w, {_r_sql(*[f'c{p}' for p in _P])} FROM cov")
def weighted_covariance(spark, d):
    return shape.weighted_covariance(_nb(spark, d, 32), 0.15).select("idx", *_r("w", *shape.COV))


@_q(f"WITH {E}, {_knn_sql(32)}, {COV_SQL}, {EIG_SQL} SELECT idx, {_r_sql('l1', 'l2', 'l3')} FROM eig")
def eigenvalues(spark, d):
    return shape.eigenvalues(shape.covariance(_nb(spark, d, 32))).select("idx", *_r("l1", "l2", "l3"))


@_q(f"WITH {E}, {_knn_sql(8)}, {COV_SQL}, {EIG_SQL}, {_vec_sql('eig', 'l1', 'a', 'va')}, {_vec_sql('va', 'l3', 'b', 'vb')} SELECT idx, {_r_sql('l1', 'l2', 'l3')}, round(ax, 5) + 0.0 AS ax, round(ay, 5) + 0.0 AS ay, round(az, 5) + 0.0 AS az, round(bx, 5) + 0.0 AS bx, round(\"by\", 5) + 0.0 AS \"by\", round(bz, 5) + 0.0 AS bz FROM vb")
def pca(spark, d):
    p = shape.pca(_nb(spark, d, 8)).select("idx", "l1", "l2", "l3", *[F.col(f"e1.{c}").alias(f"a{c}") for c in "xyz"], *[F.col(f"e3.{c}").alias(f"b{c}") for c in "xyz"])
    return p.select("idx", *_r("l1", "l2", "l3"), *_r("ax", "ay", "az", "bx", "by", "bz", digits=5))


@_q(f"WITH {E}, {_knn_sql(32)}, {COV_SQL}, {EIG_SQL}, {_vec_sql('eig', 'l3', 'n', 'vn')} SELECT idx, {_r_sql('nx', 'ny', 'nz', digits=5)} FROM vn")
def normals(spark, d):
    return shape.normals(_nb(spark, d, 32)).select("idx", *_r("nx", "ny", "nz", digits=5))


_ISS = f"WITH {E}, {_knn_sql(8)}, {COV_SQL}, {EIG_SQL}, ca AS (SELECT idx, l1, l2, l3, l1 <> 0 AND l2 <> 0 AND l1 > l2 AND l2 > l3 AND l2 / l1 < 0.6 AND l3 / l2 < 0.75 AS is_candidate FROM eig), be AS (SELECT nb.idx, max(ca.l3) AS best FROM nb JOIN ca ON ca.idx = nb.nidx WHERE nb.dist <= 0.1 GROUP BY nb.idx)"


@_q(f"{_ISS} SELECT ca.idx, {_r_sql('l1', 'l2', 'l3')}, is_candidate, is_candidate AND l3 >= coalesce(best, l3) AS is_keypoint FROM ca LEFT JOIN be ON be.idx = ca.idx")
def iss_keypoints(spark, d):
    return keypoints.iss(cut(_nb(spark, d, 8)), 0.1, 0.6, 0.75).select("idx", *_r("l1", "l2", "l3"), "is_candidate", "is_keypoint")


def _nss_sql(ratio: float) -> str:
    return (
        f"{EN}, tg AS (SELECT CAST(floor(count(*) * {ratio}) AS BIGINT) AS target FROM en), tn AS (SELECT target, greatest(1, CAST(floor(sqrt(target / 2.0)) AS BIGINT)) AS nt FROM tg), "
        f"an AS (SELECT idx, acos(greatest(-1.0, least(1.0, nz / sqrt(nx*nx+ny*ny+nz*nz)))) AS theta, CASE WHEN atan2(ny, nx) < 0 THEN atan2(ny, nx) + {2 * math.pi!r} ELSE atan2(ny, nx) END AS phi FROM en), "
        f"bk AS (SELECT idx, CAST(least(floor(theta / ({math.pi!r} / nt)), nt - 1) AS BIGINT) * (2 * nt) + CAST(least(floor(phi / ({2 * math.pi!r} / (2 * nt))), 2 * nt - 1) AS BIGINT) AS bucket FROM an, tn), "
        "bs AS (SELECT bucket, count(*) AS n FROM bk GROUP BY bucket), kk AS (SELECT count(*) AS k FROM bs), "
        "qo AS (SELECT bucket, n, CAST(least(n, target // k + CASE WHEN row_number() OVER (ORDER BY bucket) <= target % k THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM bs, kk, tn)"
    )


@_q(f"WITH {_nss_sql(0.5)} SELECT idx, bucket FROM bk")
def normal_buckets(spark, d):
    return downsample.normal_buckets(fx.pseudo_normals(spark, d), 0.5)


@_q(f"WITH {_nss_sql(0.5)} SELECT bucket, n, quota FROM qo")
def nss_quota(spark, d):
    n = fx.pseudo_normals(spark, d)
    return downsample.quotas(downsample.normal_buckets(n, 0.5), downsample.bucket_counts(n.count(), 0.5)[0])


def _sample_sql(ratio: float) -> str:
    return f"WITH {_nss_sql(ratio)}, rk AS (SELECT bk.idx, bk.bucket, quota, row_number() OVER (PARTITION BY bk.bucket ORDER BY (bk.idx * 2654435761 + 1) % 4294967296, bk.idx) AS r FROM bk JOIN qo USING (bucket)) SELECT idx, bucket FROM rk WHERE r <= quota"


@_q(_sample_sql(0.5))
def nss_sample(spark, d):
    return downsample.normal_space(fx.cloud(spark, d), fx.pseudo_normals(spark, d), 0.5).select("idx", "bucket")


@_q(_sample_sql(0.03))
def nss_sample_small(spark, d):
    return downsample.normal_space(fx.cloud(spark, d), fx.pseudo_normals(spark, d), 0.03).select("idx", "bucket")


# ---------------------------------------------------------------- descriptors

_SPFH = (
    f"WITH {E}, {EN}, {_knn_sql(16)}, pr AS (SELECT nb.idx, nb.nidx, dist, -dx/dist AS ex, -dy/dist AS ey, -dz/dist AS ez, p.nx AS ux, p.ny AS uy, p.nz AS uz, q.nx AS mx, q.ny AS my, q.nz AS mz FROM nb JOIN en p ON p.idx = nb.idx JOIN en q ON q.idx = nb.nidx WHERE dist <= 0.12 AND dist > 0), "
    "pv AS (SELECT *, ey*uz - ez*uy AS vx, ez*ux - ex*uz AS vy, ex*uy - ey*ux AS vz FROM pr), "
    "pw AS (SELECT *, uy*vz - uz*vy AS wx, uz*vx - ux*vz AS wy, ux*vy - uy*vx AS wz FROM pv), "
    "ft AS (SELECT idx, nidx, dist, vx*mx + vy*my + vz*mz AS alpha, atan2(wx*mx + wy*my + wz*mz, ux*mx + uy*my + uz*mz) AS theta, ux*ex + uy*ey + uz*ez AS rho FROM pw), "
    f"bi AS (SELECT idx, CAST(greatest(0, least(10, floor((alpha + 1) * 5.5))) AS INTEGER) AS bin FROM ft UNION ALL SELECT idx, CAST(greatest(0, least(10, floor((theta + {math.pi!r}) * {11 / (2 * math.pi)!r}))) AS INTEGER) + 11 FROM ft UNION ALL SELECT idx, CAST(greatest(0, least(10, floor((rho + 1) * 5.5))) AS INTEGER) + 22 FROM ft), "
    "sp AS (SELECT idx, bin, count(*) AS n FROM bi GROUP BY idx, bin)"
)


@_q(f"{_SPFH} SELECT idx, bin, n FROM sp")
def spfh(spark, d):
    return descriptors.spfh(_nb(spark, d, 16), fx.pseudo_normals(spark, d), 0.12)


@_q(f"{_SPFH}, al AS (SELECT idx, bin, CAST(n AS DOUBLE) AS v FROM sp UNION ALL SELECT nb.idx, sp.bin, sp.n / nb.dist / 16 FROM nb JOIN sp ON sp.idx = nb.nidx WHERE nb.dist <= 0.12 AND nb.dist > 0) SELECT idx, bin, round(sum(v), 5) + 0.0 AS v FROM al GROUP BY idx, bin")
def fpfh(spark, d):
    return descriptors.fpfh(cut(_nb(spark, d, 16)), fx.pseudo_normals(spark, d), 16, 0.12).select("idx", "bin", *_r("v", digits=5))


_LRF = f"WITH {E}, {_knn_sql(16)}, {_wcov_sql(0.15)}, {EIG_SQL}, {_vec_sql('eig', 'l1', 'a', 'va')}, {_vec_sql('va', 'l3', 'b', 'vb')}, "
_LRF += 'ls AS (SELECT idx, ax * (CASE WHEN sx*ax + sy*ay + sz*az < 0 THEN -1.0 ELSE 1.0 END) AS xx, ay * (CASE WHEN sx*ax + sy*ay + sz*az < 0 THEN -1.0 ELSE 1.0 END) AS xy, az * (CASE WHEN sx*ax + sy*ay + sz*az < 0 THEN -1.0 ELSE 1.0 END) AS xz, bx * (CASE WHEN sx*bx + sy*"by" + sz*bz < 0 THEN -1.0 ELSE 1.0 END) AS zx, "by" * (CASE WHEN sx*bx + sy*"by" + sz*bz < 0 THEN -1.0 ELSE 1.0 END) AS zy, bz * (CASE WHEN sx*bx + sy*"by" + sz*bz < 0 THEN -1.0 ELSE 1.0 END) AS zz FROM vb), '
_LRF += "lf AS (SELECT idx, xx, xy, xz, zy*xz - zz*xy AS yx, zz*xx - zx*xz AS yy, zx*xy - zy*xx AS yz, zx, zy, zz FROM ls)"
_AXES = [f"{a}{b}" for a in "xyz" for b in "xyz"]


@_q(f"{_LRF} SELECT idx, {_r_sql(*_AXES, digits=4)} FROM lf")
def lrf(spark, d):
    return descriptors.reference_frame(_nb(spark, d, 16), 0.15).select("idx", *_r(*_AXES, digits=4))


def _shares_sql(value: str, step: float, top: float, out: str) -> str:
    """A list of (bin, weight) shares of a value, as ``binning_weight`` gives them."""
    last = int(top / step + 1e-9)
    v = f"(({value}) / {step!r})"
    one = lambda b: f"[{{'b': {b}, 'w': 1.0::DOUBLE}}]"
    return f"CASE WHEN {v} < 0 THEN {one(0)} WHEN floor({v}) >= {last} THEN {one(last - 1)} ELSE [{{'b': CAST(floor({v}) AS INTEGER), 'w': 1 - ({v} - floor({v}))}}, {{'b': CAST(least(floor({v}) + 1, {last - 1}) AS INTEGER), 'w': {v} - floor({v})}}] END AS {out}"


_SHOT = (
    f"{_LRF}, {EN}, pr AS (SELECT nb.idx, dist, dx*xx + dy*xy + dz*xz AS lx, dx*yx + dy*yy + dz*yz AS ly, dx*zx + dy*zy + dz*zz AS lz, greatest(-1.0, least(1.0, zx*nx + zy*ny + zz*nz)) AS co FROM nb JOIN lf ON lf.idx = nb.idx JOIN en ON en.idx = nb.nidx WHERE dist <= 0.15 AND xx IS NOT NULL), "
    f"ax AS (SELECT idx, {_shares_sql('dist', 0.075, 0.15, 'r')}, {_shares_sql('CASE WHEN dist > 1e-6 THEN acos(greatest(-1.0, least(1.0, lz / dist))) ELSE 0.0 END', math.pi / 2, math.pi, 'e')}, "
    f"{_shares_sql(f'atan2(ly, lx) + {math.pi!r}', 2 * math.pi / 8, 2 * math.pi, 'a')}, {_shares_sql('co + 1', 2 / 11, 2, 'c')} FROM pr), "
    "u1 AS (SELECT idx, unnest(r) AS r, e, a, c FROM ax), u2 AS (SELECT idx, r, unnest(e) AS e, a, c FROM u1), u3 AS (SELECT idx, r, e, unnest(a) AS a, c FROM u2), u4 AS (SELECT idx, r, e, a, unnest(c) AS c FROM u3), "
    "hi AS (SELECT idx, CAST(((r.b * 2 + e.b) * 8 + a.b) * 11 + c.b AS INTEGER) AS bin, sum(r.w * e.w * a.w * c.w) AS v FROM u4 WHERE r.w * e.w * a.w * c.w > 0 GROUP BY ALL), "
    "no AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY idx)) AS norm FROM hi)"
)


@_q(f"{_SHOT} SELECT idx, bin, round(CASE WHEN norm > 1e-6 THEN v / norm ELSE v END, 4) + 0.0 AS v FROM no WHERE v / norm > 1e-3")
def shot_hist(spark, d):
    """Bins that hold more than a thousandth, as rounding decides whether the others are there at all."""
    return descriptors.shot(cut(_nb(spark, d, 16)), fx.pseudo_normals(spark, d), 0.15).where("v > 1e-3").select("idx", "bin", *_r("v", digits=4))


@_q()
def shot_vectors(spark, d):
    """From the cloud to the vector of 352 numbers of each point, normals worked out on the way."""
    return descriptors.shot_descriptor(fx.cloud(spark, d), 16, 0.15)


# ---------------------------------------------------------------- registration


@_q("WITH s AS (SELECT vec_id AS i, CAST(embedding[1:33] AS DOUBLE[]) AS f FROM embeddings), dd AS (SELECT a.i AS src_idx, b.i AS tgt_idx, list_distance(a.f, b.f) AS dist FROM s a JOIN s b ON a.i % 2 = 0 AND b.i % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY src_idx ORDER BY dist, tgt_idx) AS k FROM dd WHERE dist < 20) SELECT src_idx, tgt_idx, round(dist, 6) + 0.0 AS dist FROM r WHERE k = 1")
def feature_match(spark, d):
    f = fx.features(spark, d)
    return registration.feature_match(f.where("idx % 2 = 0"), f.where("idx % 2 = 1"), 20.0, 33).select("src_idx", "tgt_idx", *_r("dist"))


_NN = f"{_moved_sql()}, dd AS (SELECT e.idx AS src_idx, em.idx AS tgt_idx, sqrt((em.x-e.x)*(em.x-e.x)+(em.y-e.y)*(em.y-e.y)+(em.z-e.z)*(em.z-e.z)) AS dist FROM e, em)"


@_q(f"WITH {E}, {_NN}, r AS (SELECT *, row_number() OVER (PARTITION BY src_idx ORDER BY dist, tgt_idx) AS k FROM dd WHERE dist < 0.05) SELECT src_idx, tgt_idx, round(dist, 6) + 0.0 AS dist FROM r WHERE k = 1")
def nn_correspondence(spark, d):
    return neighbors.nearest_within(fx.cloud(spark, d), fx.moved_cloud(spark, d), 0.05).select("src_idx", "tgt_idx", *_r("dist"))


@_q(f"WITH {E}, {_NN}, {_knn_sql(8)}, rr AS (SELECT dd.*, row_number() OVER (PARTITION BY src_idx ORDER BY dd.dist, tgt_idx) AS k FROM dd JOIN nb ON nb.idx = src_idx AND nb.nidx = tgt_idx WHERE dd.dist < 0.1) SELECT src_idx, tgt_idx, round(dist, 6) + 0.0 AS dist FROM rr WHERE k = 1")
def restricted_correspondence(spark, d):
    p = fx.cloud(spark, d)
    return registration.restricted_correspondence(p, fx.moved_cloud(spark, d), neighbors.knn(p, 8), 0.1).select("src_idx", "tgt_idx", *_r("dist"))


_HS = ["n", "loss", *[f"m{c}" for c in ("sx", "sy", "sz", "tx", "ty", "tz")], *[f"h{a}{b}" for a in "xyz" for b in "xyz"]]


@_q(
    f"WITH {E}, {_moved_sql()}, pa AS (SELECT e.x AS sx, e.y AS sy, e.z AS sz, em.x AS tx, em.y AS ty, em.z AS tz, sqrt((em.x-e.x)*(em.x-e.x)+(em.y-e.y)*(em.y-e.y)+(em.z-e.z)*(em.z-e.z)) AS dist FROM e JOIN em ON em.idx = e.idx) "
    "SELECT count(*) AS n, round(avg(dist), 6) + 0.0 AS loss, " + ", ".join(f"round(avg({c}), 6) + 0.0 AS m{c}" for c in ("sx", "sy", "sz", "tx", "ty", "tz")) + ", " + ", ".join(f"round(covar_pop(t{a}, s{b}) * count(*), 6) + 0.0 AS h{a}{b}" for a in "xyz" for b in "xyz") + " FROM pa"
)
def kabsch_sums(spark, d):
    p = fx.cloud(spark, d).select("idx", *[F.col(c).alias(f"s{c}") for c in "xyz"]).join(fx.moved_cloud(spark, d).select("idx", *[F.col(c).alias(f"t{c}") for c in "xyz"]), "idx")
    p = p.withColumn("dist", vec.distance(vec.col3("sx", "sy", "sz"), vec.col3("tx", "ty", "tz")))
    return registration.pair_sums(p).select("n", *_r(*_HS[1:]))


def _pose(spark, t, **more):
    names = [f"m{r}{c}" for r in range(4) for c in range(4)]
    values = [round(float(v), 6) + 0.0 for v in t.ravel()]
    return spark.createDataFrame([(*values, *more.values())], ", ".join([f"{n} double" for n in names] + [f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in more.items()]))


_TRUE = "SELECT " + ", ".join(f"CAST({round(float(fx.POSE[r, c]), 6) + 0.0!r} AS DOUBLE) AS m{r}{c}" for r in range(4) for c in range(4))


@_q(_TRUE)
def ransac_pose(spark, d):
    """Pose out of pairs of which a third are wrong."""
    s = fx.cloud(spark, d).select(F.col("idx").alias("src_idx"), "x", "y", "z")
    wrong = F.when(F.col("src_idx") % 3 == 0, F.col("src_idx") + 1).otherwise(F.col("src_idx"))
    m = s.select("src_idx", wrong.alias("tgt_idx"), F.lit(0.0).alias("dist"))
    r = registration.ransac(registration.matched_pairs(m, fx.cloud(spark, d), fx.moved_cloud(spark, d)), 500, 0.02, 0.3)
    return _pose(spark, r.transform)


@_q(_TRUE)
def icp_pose(spark, d):
    r = registration.icp_point_to_point(fx.cloud(spark, d), fx.moved_cloud(spark, d), registration.IcpParams(0.5, 60, 1e-9, 1e-9))
    return _pose(spark, r.transform)


@_q(_TRUE)
def icp_plane_pose(spark, d):
    g = fx.moved_cloud(spark, d)
    r = registration.icp_point_to_plane(fx.cloud(spark, d), g, cut(shape.normals(neighbors.knn(g, 16))), registration.IcpParams(0.5, 60, 1e-9, 1e-9))
    return _pose(spark, r.transform)


@_q(_TRUE)
def icp_surface_pose(spark, d):
    """Plane to plane."""
    p, g = fx.cloud(spark, d), fx.moved_cloud(spark, d)
    r = registration.icp_plane_to_plane(p, cut(shape.normals(neighbors.knn(p, 16))), g, cut(shape.normals(neighbors.knn(g, 16))), registration.IcpParams(0.5, 60, 1e-9, 1e-9))
    return _pose(spark, r.transform)


@_q()
def ndt_pose(spark, d):
    r = registration.ndt(fx.cloud(spark, d), fx.moved_cloud(spark, d), 0.2, 5, registration.IcpParams(max_iterations=40, transformation_epsilon=1e-6, euclidean_fitness_epsilon=0))
    return _pose(spark, r.transform, reason=r.reason)


@_q(_TRUE)
def initial_pose(spark, d):
    """Keypoints, descriptors, matching and robust fit of the two clouds."""
    r = registration.initial_pose(fx.cloud(spark, d), fx.moved_cloud(spark, d), 8, 0.1, 0.12, 0.6, 0.75, 20.0, 500, 0.02, 0.1)
    return _pose(spark, r.transform)


@_q(f"WITH {E} SELECT CAST(floor(x / 0.1) AS BIGINT) AS ix, CAST(floor(y / 0.1) AS BIGINT) AS iy, CAST(floor(z / 0.1) AS BIGINT) AS iz, count(*) AS n, round(avg(x), 6) + 0.0 AS mx, round(avg(y), 6) + 0.0 AS my, round(avg(z), 6) + 0.0 AS mz, " + ", ".join(f"round(covar_pop({p[0]}, {p[1]}), 6) + 0.0 AS c{p}" for p in _P) + " FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def ndt_cells(spark, d):
    return registration.ndt_cells(fx.cloud(spark, d), 0.1).select("ix", "iy", "iz", "n", *_r("mx", "my", "mz", *shape.COV))


# ---------------------------------------------------------------- sources and sinks


@_q(f"WITH {E} SELECT round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, CAST(1.0 AS DOUBLE) AS intensity, CAST(-1 AS INTEGER) AS label FROM e")
def txt_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/txt-{uuid.uuid4().hex}"
    clouds.write_txt(fx.cloud(spark, d), path)
    return clouds.read_txt_xyz(spark, path).select(*[(F.col(c) + 0.0).alias(c) for c in "xyz"], "intensity", "label")


@_q(f"WITH {E} SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM e")
def txt_running_index(spark, d):
    """One file in order of idx: what is read counts its lines."""
    path = _folder(spark)
    clouds.write_txt(fx.cloud(spark, d).repartition(1).sortWithinPartitions("idx"), path)
    return clouds.read_txt_xyz(spark, path).select("idx", *[(F.col(c) + 0.0).alias(c) for c in "xyz"])


@_q()
def pcd_read(spark, d):
    """Whole PCD files put together from their headers and records, and read again."""
    h = table(spark, d, "pcd_header").where("fields IS NOT NULL AND size(fields) = size(sizes) AND size(fields) = size(types) AND size(fields) = size(counts)")
    h = h.groupBy("file_id").agg(F.min_by(F.struct(*h.columns), F.struct("registered_at", "captured_at", "file_path")).alias("h")).select("h.*")  # as first registered
    join = lambda c: F.concat_ws(" ", F.transform(c, lambda v: F.trim(v.cast("string"))))
    text = F.concat(F.lit("VERSION .7\nFIELDS "), join("fields"), F.lit("\nSIZE "), join("sizes"), F.lit("\nTYPE "), F.upper(join("types")), F.lit("\nCOUNT "), join("counts"), F.lit("\nWIDTH "), F.col("width").cast("string"), F.lit("\nHEIGHT "), F.col("height").cast("string"), F.lit("\nPOINTS "), F.col("points").cast("string"), F.lit("\nDATA "), F.lower(F.trim("data_type")), F.lit("\n"))
    b = table(spark, d, "pcd_body").groupBy("file_id", "rec_no").agg(F.min("payload").alias("payload"))
    width = F.aggregate(F.zip_with("sizes", "counts", lambda s, c: s * c), F.lit(0), lambda a, v: a + v)
    h = h.select("file_id", "file_path", F.encode(text, "UTF-8").alias("head"), (F.lower(F.trim("data_type")) == "ascii").alias("ascii"), width.alias("width"))
    line = F.when(F.col("ascii"), F.concat(F.encode(F.regexp_replace(F.decode("payload", "UTF-8"), r"[\r\n]+", ""), "UTF-8"), F.encode(F.lit("\n"), "UTF-8"))).otherwise(F.substring("payload", F.lit(1), F.col("width")))
    g = b.join(h, "file_id").withColumn("line", line).groupBy("file_path", "head").agg(F.array_sort(F.collect_list(F.struct("rec_no", "line"))).alias("rows"))
    body = F.aggregate("rows", F.encode(F.lit(""), "UTF-8"), lambda a, r: F.concat(a, r["line"]))
    return clouds.decode_files(g.select(F.col("file_path").alias("path"), F.concat("head", body).alias("content")))


def _put(spark, path: str, data: bytes) -> None:
    """A small file on the shared file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


_HEAD = "# .PCD v.7\nVERSION .7\nFIELDS x y z intensity label\nSIZE 4 4 4 4 4\nTYPE F F F F I\nCOUNT 1 1 1 1 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA "
_THREE = [(0.5, 0.25, -1.0, 7.0, 3), (1.5, -0.125, 2.0, 0.5, -1), (-3.0, 0.0, 8.0, 1.0, 12)]


def _pcd_folder(spark) -> str:
    """Two files of the same three points, ascii and binary, and one of the coordinates only."""
    at = _folder(spark)
    _put(spark, f"{at}/a.pcd", (_HEAD + "ascii\n" + "".join(" ".join(map(str, p)) + "\n" for p in _THREE)).encode())
    _put(spark, f"{at}/b.pcd", (_HEAD + "binary\n").encode() + b"".join(struct.pack("<ffffi", *p) for p in _THREE))
    _put(spark, f"{at}/c.pcd", b"VERSION .7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nDATA ascii\n1 2 3\n4 5 6\n")
    return at


_PCD_ROWS = ", ".join(f"('{n}', {i}, {p[0]!r}, {p[1]!r}, {p[2]!r}, {p[3]!r}, {p[4]})" for n in ("a.pcd", "b.pcd") for i, p in enumerate(_THREE)) + ", ('c.pcd', 0, 1.0, 2.0, 3.0, 1.0, -1), ('c.pcd', 1, 4.0, 5.0, 6.0, 1.0, -1)"


def _named(df):
    return df.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).drop("path")


@_q(f"SELECT name, CAST(idx AS BIGINT) AS idx, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(intensity AS DOUBLE) AS intensity, CAST(label AS INTEGER) AS label FROM (VALUES {_PCD_ROWS}) t(name, idx, x, y, z, intensity, label)")
def pcd_files(spark, d):
    return _named(clouds.read_pcd(spark, _pcd_folder(spark)))


@_q("SELECT name, version, CAST(points AS INTEGER) AS points, data_type, has_rgb, valid, n_fields FROM (VALUES ('a.pcd', '.7', 3, 'ascii', false, true, CAST(5 AS INTEGER)), ('b.pcd', '.7', 3, 'binary', false, true, 5), ('c.pcd', '.7', 2, 'ascii', false, true, 3)) t(name, version, points, data_type, has_rgb, valid, n_fields)")
def pcd_header_files(spark, d):
    h = _named(clouds.pcd_headers(spark, _pcd_folder(spark)))
    return h.select("name", "version", "points", "data_type", "has_rgb", "valid", F.size("fields").alias("n_fields"))


@_q(f"WITH {E} SELECT idx, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, CAST(1.0 AS DOUBLE) AS intensity FROM (SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, x, y, z FROM e WHERE idx < 100)")
def bin_frames(spark, d):
    """A packed frame of the first points, with half a row too much."""
    rows = fx.cloud(spark, d).where("idx < 100").orderBy("idx").select("x", "y", "z").collect()
    at = f"{_folder(spark)}/0.bin"
    _put(spark, at, b"".join(struct.pack("<ffff", *r, 1.0) for r in rows) + b"\0" * 8)
    return clouds.read_bin(spark, at).select("idx", "x", "y", "z", "intensity")


_OFF = "OFF\n4 2 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n3 0 1 2\n3 0 2 3\n"


def _off_folder(spark) -> str:
    at = _folder(spark)
    for c, part, name in (("chair", "train", "chair_0001"), ("chair", "test", "chair_0002"), ("desk", "train", "desk_0001")):
        _put(spark, f"{at}/{c}/{part}/{name}.off", _OFF.encode())
    return at


@_q("SELECT * FROM (VALUES ('chair', 'train', 'chair_0001'), ('chair', 'test', 'chair_0002'), ('desk', 'train', 'desk_0001')) t(\"class\", \"split\", name)")
def mesh_files(spark, d):
    return clouds.list_files(spark, _off_folder(spark)).select("class", "split", "name")


@_q("SELECT * FROM (VALUES ('chair', 'train', CAST(256 AS BIGINT), true), ('chair', 'test', 256, true), ('desk', 'train', 256, true)) t(\"class\", \"split\", n, inside)")
def mesh_to_points(spark, d):
    """Meshes of a tree turned into text and read again: as many points as wanted, all on the surface."""
    to = _folder(spark)
    clouds.off_to_points(spark, _off_folder(spark), to)
    p = clouds.read_txt_xyz(spark, to)
    part = lambda k: F.regexp_extract("path", f"{k}=([^/]+)", 1)
    ok = F.min(F.col("x").between(0, 1) & F.col("y").between(0, 1) & (F.col("z") == 0))
    return p.groupBy(part("class").alias("class"), part("split").alias("split")).agg(F.count("*").alias("n"), ok.alias("inside"))


@_q("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), (1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 1.0)) t(vid, nx, ny, nz)")
def mesh_vertex_normals(spark, d):
    at = _folder(spark)
    _put(spark, f"{at}/one.off", _OFF.encode())
    return clouds.vertex_normals(*clouds.read_off(spark, at)).select("vid", *_r("nx", "ny", "nz"))


@_q()
def off_sample(spark, d):
    """Points on the surface of a mesh whose triangles join three consecutive points each."""
    p = fx.cloud(spark, d)
    v = p.select(F.lit("e").alias("mesh"), F.col("idx").alias("vid"), "x", "y", "z")
    f = p.where("idx % 3 = 2").select(F.lit("e").alias("mesh"), (F.col("idx") / 3).cast("long").alias("fid"), (F.col("idx") - 2).alias("v0"), (F.col("idx") - 1).alias("v1"), F.col("idx").alias("v2"))
    return clouds.sample_surface(v, f, 4096)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
