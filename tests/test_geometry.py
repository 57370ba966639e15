"""Point-cloud operators against numpy brute force and on awkward input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointspark.functions import vec
from pointspark.functions.linalg import eigenvalues3, kabsch, rigid_from_points, rotation_z, with_eigenvector
from pointspark.operators import cluster, components, denoise, descriptors, downsample, keypoints, neighbors, registration, shape

SCHEMA = "idx long, x double, y double, z double, intensity double, label int"


def cloud(spark, xyz, extra=()):
    rows = [(i, float(a), float(b), float(c), 1.0, -1) for i, (a, b, c) in enumerate(xyz)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


@pytest.fixture(scope="module")
def xyz():
    r = np.random.default_rng(0)
    return np.concatenate([r.normal(0, 0.05, (150, 3)), r.normal(2, 1.0, (100, 3)), [[90, 90, 90]]])


def brute(xyz, k):
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return [[(int(j), d[i, j]) for j in np.lexsort((np.arange(len(xyz)), d[i]))[:k]] for i in range(len(xyz))]


@pytest.mark.parametrize(("block", "least", "leaf"), [(4096, 8, 64), (16, 8, 64), (16, 2, 4)])
def test_knn_is_exact(spark, xyz, block, least, leaf, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbors, "LEAST", least)
    monkeypatch.setattr(neighbors, "LEAF", leaf)
    bad = [(900, None, 1.0, 1.0, 1.0, 1), (None, 1.0, 1.0, 1.0, 1.0, 1), (901, float("nan"), 0.0, 0.0, None, None), (3, *map(float, xyz[3]), 1.0, -1)]
    got = {}
    for r in neighbors.knn(cloud(spark, xyz, bad), 5).collect():
        got.setdefault(r["idx"], {})[r["rank"]] = (r["nidx"], r["dist"])
    want = brute(xyz, 5)
    assert set(got) == set(range(len(xyz)))
    for i, w in enumerate(want):
        assert [got[i][k + 1][0] for k in range(5)] == [j for j, _ in w]
        assert np.allclose([got[i][k + 1][1] for k in range(5)], [e for _, e in w])


def test_knn_with_far_outliers_and_a_hot_position(spark, monkeypatch):
    """A dense cloud with a point 10^6 times as far out, and a third of all points at one position."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    r = np.random.default_rng(9)
    p = np.concatenate([r.uniform(0, 1, (250, 3)), np.full((150, 3), 0.5), [[1e6, 0, 0], [-1e6, 5, 5]]])[r.permutation(402)]
    got = {}
    for q in neighbors.knn(cloud(spark, p), 2).collect():
        got.setdefault(q["idx"], {})[q["rank"]] = (q["nidx"], q["dist"])
    for i, w in enumerate(brute(p, 2)):
        assert [got[i][1][0], got[i][2][0]] == [w[0][0], w[1][0]] and abs(got[i][2][1] - w[1][1]) < 1e-6
    s = neighbors.Space(p, len(p), 2)
    assert s.hot == [(0.5, 0.5, 0.5)] and len(s.lows) > 8
    assert np.bincount(s.block(p)).sum() == len(p)


def test_knn_small_clouds_and_repeated_positions(spark, monkeypatch):
    assert neighbors.knn(cloud(spark, []), 3).count() == 0
    assert neighbors.knn(cloud(spark, [(1, 2, 3)]), 3).count() == 0
    r = neighbors.knn(cloud(spark, [(1, 1, 1)] * 6), 2).orderBy("idx", "rank").collect()
    assert [(x["idx"], x["nidx"], x["dist"]) for x in r][:4] == [(0, 1, 0.0), (0, 2, 0.0), (1, 0, 0.0), (1, 2, 0.0)]
    with pytest.raises(ValueError):
        neighbors.knn(cloud(spark, []), 0)


def test_radius_and_nearest(spark, xyz, monkeypatch):
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    got = {(r["idx"], r["nidx"]) for r in neighbors.radius_neighbors(cloud(spark, xyz), 0.2).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 0.2)) if i != j}
    near = {r["src_idx"]: r["tgt_idx"] for r in neighbors.nearest_within(cloud(spark, xyz), cloud(spark, xyz + 0.001), 0.5).collect()}
    e = np.sqrt(((xyz[:, None] - xyz[None] - 0.001) ** 2).sum(2))
    assert near == {i: int(e[i].argmin()) for i in range(len(xyz)) if e[i].min() < 0.5}
    monkeypatch.setattr(neighbors, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    near = {r["src_idx"]: r["tgt_idx"] for r in neighbors.nearest_within(cloud(spark, xyz), cloud(spark, xyz + 0.3), 0.9).collect()}
    e = np.sqrt(((xyz[:, None] - xyz[None] - 0.3) ** 2).sum(2))
    assert near == {i: int(e[i].argmin()) for i in range(len(xyz)) if e[i].min() < 0.9}
    assert neighbors.nearest_within(cloud(spark, []), cloud(spark, xyz), 0.9).count() == 0 == neighbors.nearest_within(cloud(spark, xyz), cloud(spark, []), 0.9).count()


def test_eigen_matches_lapack(spark):
    r = np.random.default_rng(1)
    ms = [m @ m.T for m in r.normal(size=(50, 3, 3))] + [np.eye(3), np.zeros((3, 3)), np.diag([1e-8, 2e-8, 3e-8])]
    rows = [(i, *[float(m[a, b]) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]) for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "idx long, cxx double, cxy double, cxz double, cyy double, cyz double, czz double")
    e = with_eigenvector(df.withColumn("l", eigenvalues3(*[F.col(c) for c in shape.COV])).select("*", "l.*"), "l3", ("nx", "ny", "nz"))
    for q in e.where("nx IS NOT NULL OR idx >= 50").collect():
        w, v = np.linalg.eigh(ms[q["idx"]])
        assert np.allclose([q["l3"], q["l2"], q["l1"]], w, atol=1e-9)
        if q["nx"] is not None:
            assert abs(abs(np.dot([q["nx"], q["ny"], q["nz"]], v[:, 0])) - 1) < 1e-6
    assert e.where("idx = 50").first()["nx"] is None


def test_plane_normals(spark):
    g = [(a * 0.1, b * 0.1, 0.0) for a in range(8) for b in range(8)]
    n = shape.normals(neighbors.knn(cloud(spark, g), 8)).collect()
    assert len(n) == 64 and all(abs(r["nz"] - 1) < 1e-9 for r in n)
    # a filter on a normal must not make the plan explode
    assert shape.normals(neighbors.knn(cloud(spark, g), 8)).where("nx IS NOT NULL AND nz > 0.5").count() == 64


def test_outliers(spark, xyz):
    p = cloud(spark, xyz)
    o = denoise.statistical_outlier(p, neighbors.knn(p, 8), 8, alpha=3.0)
    assert {r["idx"] for r in o.where("is_outlier").collect()} == {len(xyz) - 1}
    assert o.where("label = -2").count() == 1 and o.count() == len(xyz)
    assert denoise.statistical_outlier(cloud(spark, [(0, 0, 0)]), neighbors.knn(cloud(spark, [(0, 0, 0)]), 8), 8).first()["is_outlier"] is False


def test_voxel_clusters(spark):
    blob = [(0.05 + 0.1 * a, 0.05, 0.05) for a in (0, 1, 5, 6) for _ in range(4)] + [(0.25, 0.05, 0.05), (0.95, 0.95, 0.95)]
    extra = [(100, None, 0.1, 0.1, 1.0, 1), (101, float("nan"), 0.1, 0.1, 1.0, 1), (102, 7.0, 0.1, 0.1, 1.0, 1)]
    p = cloud(spark, blob, extra)
    c = cluster.voxel_dbscan(p, (0, 1, 0, 1, 0, 1), 0.1, 3)
    assert {(r["label"], r["n"]) for r in cluster.distribution(c).collect()} == {(0, 9), (1, 8)}
    assert cluster.voxel_dbscan(p, (0, 1, 0, 1, 0, 1), 0.1, 3, keep_noise=True).count() == len(blob) + 3
    assert cluster.voxel_dbscan(cloud(spark, []), (0, 1, 0, 1, 0, 1), 0.1, 3).count() == 0


@pytest.mark.parametrize("most", [0, 20_000])
def test_components(spark, most, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_ROWS", most)
    r = np.random.default_rng(2)
    e = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in e:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {q["node"]: q["root"] for q in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {n: root(n) for n in {x for a, b in e if a != b for x in (a, b)}}
    n = components.numbered(spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v long"), "v", "no").collect()
    assert all(q["v"] == q["no"] for q in n) and len(n) == 101


def test_normal_space_sampling(spark, xyz):
    p = cloud(spark, xyz)
    n = spark.createDataFrame([(i, *map(float, v / np.linalg.norm(v))) for i, v in enumerate(np.random.default_rng(3).normal(size=(len(xyz), 3)))] + [(999, None, None, None)], "idx long, nx double, ny double, nz double")
    s = downsample.normal_space(p, n, 0.4)
    b = downsample.normal_buckets(n, 0.4)
    q = downsample.quotas(b, downsample.bucket_counts(b.count(), 0.4)[0])
    assert s.count() == q.agg(F.sum("quota")).first()[0] == s.select("idx").distinct().count()
    assert downsample.bucket_counts(3, 0.1) == (0, 1, 2)


def test_iss_suppression(spark, xyz):
    p = cloud(spark, xyz)
    n = neighbors.knn(p, 8)
    e = {r["idx"]: r for r in keypoints.iss(n, 0.3, 0.9, 0.9).collect()}
    for i, near in enumerate(brute(xyz, 8)):
        best = max([e[j]["l3"] for j, d in near if d <= 0.3], default=-1)
        assert e[i]["is_keypoint"] == (e[i]["is_candidate"] and e[i]["l3"] >= best)


def test_descriptors(spark, xyz):
    p = cloud(spark, xyz)
    n = neighbors.knn(p, 8)
    nor = shape.normals(n)
    within = n.where("dist <= 1.0 AND dist > 0").groupBy("idx").count()
    s = descriptors.spfh(n, nor, 1.0).groupBy("idx").agg(F.sum("n").alias("s")).join(within, "idx")
    assert s.where("s <> 3 * count").count() == 0 and s.count() > 200
    f = descriptors.dense(descriptors.fpfh(n, nor, 8, 1.0), 33)
    assert all(len(r["f"]) == 33 for r in f.collect())
    h = descriptors.shot(n, nor, 1.0).groupBy("idx").agg(F.sum(F.col("v") * F.col("v")).alias("q"), F.max("bin").alias("b")).collect()
    assert all(abs(r["q"] - 1) < 1e-9 and r["b"] < 352 for r in h)
    frame = descriptors.reference_frame(n, 1.0).where("xx IS NOT NULL").first()
    m = np.array([[frame[a + b] for b in "xyz"] for a in "xyz"])
    assert np.allclose(m @ m.T, np.eye(3), atol=1e-6)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_feature_match_is_exact(spark, most, monkeypatch):
    monkeypatch.setattr(registration, "BROADCAST_NUMBERS", most)
    r = np.random.default_rng(4)
    a, b = r.normal(size=(60, 6)), r.normal(size=(70, 6))
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(99, None)], "idx long, f array<double>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "idx long, f array<double>")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    got = {q["src_idx"]: q["tgt_idx"] for q in registration.feature_match(s, t, 1.5).collect()}
    assert got == {i: int(d[i].argmin()) for i in range(60) if d[i].min() < 1.5}
    assert registration.feature_match(s, t.limit(0)).count() == 0


def test_rigid_fits():
    r = np.random.default_rng(5)
    t = rotation_z(33, (1, 2, 3))
    p = r.normal(size=(20, 3))
    q = p @ t[:3, :3].T + t[:3, 3]
    assert np.allclose(rigid_from_points(p, q), t)
    flat = p * [1, 1, 0]
    m = kabsch((flat - flat.mean(0)).T @ (flat - flat.mean(0)), flat.mean(0), flat.mean(0))
    assert abs(np.linalg.det(m[:3, :3]) - 1) < 1e-9


def test_ransac_and_icp(spark, xyz):
    t = rotation_z(5, (0.03, -0.02, 0.01))
    p = cloud(spark, xyz[:200])
    g = registration.transform(p, t)
    assert g.columns == p.columns
    m = p.select(F.col("idx").alias("src_idx"), F.when(F.col("idx") % 4 == 0, (F.col("idx") + 1) % 200).otherwise(F.col("idx")).alias("tgt_idx"), F.lit(0.0).alias("dist"))
    r = registration.ransac(registration.matched_pairs(m, p, g), 200, 0.01)
    assert r.accepted and np.allclose(r.transform, t, atol=1e-6) and r.inliers >= 150
    assert not registration.ransac(registration.matched_pairs(m.limit(2), p, g)).accepted
    i = registration.icp_point_to_point(p, g, registration.IcpParams(1.0, 40, 1e-9, 1e-9))
    assert np.allclose(i.transform, t, atol=1e-6)
    assert registration.icp_point_to_point(p, registration.transform(p, rotation_z(0, (500, 0, 0)))).reason == "few"


def test_plane_to_plane_and_ndt(spark):
    r = np.random.default_rng(6)
    walls = np.concatenate([np.c_[r.uniform(0, 4, (300, 2)), r.normal(0, 0.01, 300)], np.c_[r.normal(0, 0.01, 300), r.uniform(0, 4, (300, 2))], np.c_[r.uniform(0, 4, 300), r.normal(0, 0.01, 300), r.uniform(0, 4, 300)]])
    t = rotation_z(3, (0.05, -0.04, 0.03))
    p = cloud(spark, walls)
    g = registration.transform(p, t)
    i = registration.icp_plane_to_plane(p, shape.normals(neighbors.knn(p, 8)), g, shape.normals(neighbors.knn(g, 8)), registration.IcpParams(0.5, 30, 1e-7, 1e-9))
    assert np.abs(i.transform - t).max() < 5e-3
    n = registration.ndt(p, g, 1.0, 5, registration.IcpParams(max_iterations=30, transformation_epsilon=1e-5, euclidean_fitness_epsilon=0))
    assert np.abs(n.transform - t).max() < 3e-2 and n.history[-1] < n.history[0]
    assert registration.ndt(p, cloud(spark, []), 1.0).reason == "few"
    assert registration.icp_plane_to_plane(p, shape.normals(neighbors.knn(p, 8)).limit(0), g, shape.normals(neighbors.knn(g, 8))).reason == "few"


def test_label_colours(spark):
    def mixed(label):
        x = label * 2654435761 % 2**32
        x = (x ^ 61 ^ (x >> 16)) * 9 % 2**32
        x = (x ^ (x >> 4)) * 668265261 % 2**32
        x ^= x >> 15
        return [(x >> 8 * k & 255) / 255 for k in range(3)]

    got = {r["v"]: list(r["c"]) for r in spark.createDataFrame([(v,) for v in (-2, -1, 0, 1, 77, 2**31 - 1)], "v int").select("v", vec.label_color(F.col("v")).alias("c")).collect()}
    assert got == {v: [1.0, 1.0, 1.0] if v == 0 else mixed(v) for v in got}


def test_shot_vector_of_a_cloud(spark, xyz):
    f = descriptors.shot_descriptor(cloud(spark, xyz), 8, 1.0).collect()
    assert len(f) > 200 and all(len(r["f"]) == 352 and abs(np.linalg.norm(r["f"]) - 1) < 1e-6 for r in f)


def test_scalar_functions(spark):
    df = spark.createDataFrame([(-0.2,), (0.0,), (0.26,), (0.99,), (1.0,), (5.0,)], "v double")
    b = [[(x["bin"], round(x["w"], 6)) for x in r["b"]] for r in df.select(vec.binning_weight(F.col("v"), 0.5, 1.0).alias("b")).collect()]
    assert b == [[(0, 1.0)], [(0, 1.0), (1, 0.0)], [(0, 0.48), (1, 0.52)], [(1, 0.02), (1, 0.98)], [(1, 1.0)], [(1, 1.0)]]
    a = df.select(vec.distance_l2(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("d"), vec.angle_bin(F.lit(math.pi)).alias("b")).first()
    assert a["d"] == 5.0 and a["b"] == 10
