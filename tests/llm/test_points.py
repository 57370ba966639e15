"""Markov clusters and varied subsets against brute force and on awkward input."""

import datetime as dt

import numpy as np
import pytest

from pointspark.llm import dispersion, markov

SCHEMA = "idx long, cloud_id string, x double, y double, z double, intensity double, label int, received_at timestamp, head_idx long, block string"


def frame(spark, rows):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, c, x, y, z, None, lab, t, 5, "clash") for i, c, x, y, z, lab in rows], SCHEMA)


def linked(rows, radius, least):
    rows = {r[0]: r for r in rows if r[0] is not None and r[1] is not None and all(v is not None and np.isfinite(v) for v in r[2:5]) and any(r[2:5])}
    ids = list(rows)
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    none = (None, -1)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            p, q = rows[a], rows[b]
            if p[1] == q[1] and sum((u - v) ** 2 for u, v in zip(p[2:5], q[2:5], strict=True)) <= radius**2 and (p[5] == q[5] or p[5] in none or q[5] in none):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i in ids:
        groups.setdefault(root(i), set()).add(i)
    return {(h, i) for h, g in groups.items() if len(g) >= least for i in g}


def scene(seed, n=400, spread=12.0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = r.integers(0, 12)
        centre = np.random.default_rng(int(c)).uniform(-spread, spread, 3)
        p = centre + r.normal(0, 0.5, 3)
        rows.append((i, "a" if c % 3 else "b", *map(float, p), [None, -1, 1, 1, 2][r.integers(0, 5)]))
    # a chain through the faces of many tiles
    rows += [(1000 + i, "a", -20 + 0.45 * i, 32.0, 0.01, 1) for i in range(90)]
    rows += [(2000, "a", 0.0, 0.0, 0.0, 1), (2001, "a", None, 1.0, 1.0, 1), (2002, "a", float("nan"), 1.0, 1.0, 1), (None, "a", 1.0, 1.0, 1.0, 1), (2003, None, 1.0, 1.0, 1.0, 1)]
    rows += [(2004, "a", 1e9, -1e9, 1e9, 1), (2005, "a", float("inf"), 0.0, 0.0, 1)]
    return rows + rows[:40] + rows[400:440]


@pytest.mark.parametrize(("tile", "block_rows"), [(64.0, 10**6), (16.0, 10**6), (64.0, 20)])
def test_clusters_are_the_linked_groups(spark, tile, block_rows):
    rows = scene(1)
    got = [(r["head_idx"], r["idx"]) for r in markov.clusters(frame(spark, rows), tile=tile, block_rows=block_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == linked(rows, 0.5, 10)


def test_flow_does_not_depend_on_tiles(spark):
    r = np.random.default_rng(8)
    rows = [(i, "a", *map(float, [32.0, 32.0, 0.5] + r.normal(0, 0.6, 3)), [None, 1, 2][i % 3]) for i in range(300)]
    flows = [{q["idx"]: q["flow"] for q in markov.clusters(frame(spark, rows), tile=t, block_rows=n).collect()} for t, n in ((1000.0, 10**6), (64.0, 10**6), (16.0, 20))]
    assert len(flows[0]) > 200
    for f in flows[1:]:
        assert f.keys() == flows[0].keys() and all(abs(f[i] - v) < 1e-9 for i, v in flows[0].items())


def test_typical_members(spark):
    rows = scene(2)
    d = markov.described(frame(spark, rows)).collect()
    want = {}
    for h, i in linked(rows, 0.5, 10):
        want.setdefault(h, set()).add(i)
    assert {r["head_idx"]: r["size"] for r in d} == {h: len(g) for h, g in want.items()}
    assert all(len(r["typical"]) == 3 and set(r["typical"]) <= want[r["head_idx"]] for r in d)


def test_nothing_to_cluster(spark):
    assert markov.clusters(frame(spark, [])).count() == 0
    assert markov.clusters(frame(spark, [(1, "a", None, None, None, None)])).count() == 0
    same = [(i, "a", 1.0, 1.0, 1.0, 1) for i in range(12)]
    assert {(r["head_idx"], r["idx"]) for r in markov.clusters(frame(spark, same)).collect()} == {(0, i) for i in range(12)}


def test_markov_steps_stay_within_components():
    r = np.random.default_rng(3)
    n = 200
    a, b = r.integers(0, 100, 150), r.integers(0, 100, 150)
    a, b = np.r_[a, a + 100], np.r_[b, b + 100]
    ok = a != b
    label, _ = markov.multilevel_mcl(n, a[ok], b[ok], np.ones(ok.sum()))
    assert (label[a] == label[b]).all() and not set(label[:100]) & set(label[100:])
    # two cliques joined by one weak link come apart in one level of clustering
    c = [(i, j) for i in range(5) for j in range(i)]
    e = np.array(c + [(i + 5, j + 5) for i, j in c] + [(0, 5)])
    w = np.r_[np.ones(len(e) - 1), 0.05]
    at, _ = markov.sparse_mcl(10, e[:, 0], e[:, 1], w)
    assert len(set(at[:5])) == 1 and len(set(at[5:])) == 1 and at[0] != at[5]


def dense_mcl(n, a, b, w, rounds):
    m = np.zeros((n, n))
    m[a, b] = m[b, a] = w
    m[np.arange(n), np.arange(n)] = np.where(m.max(0) > 0, m.max(0), 1)

    def pruned(m):
        m = m / m.sum(0)
        for j in range(n):
            m[m[:, j] < min(markov.PRUNE, m[:, j].max()), j] = 0
            m[np.argsort(-m[:, j], kind="stable")[markov.STRONGEST :], j] = 0
        return m / m.sum(0)

    m = pruned(m)
    for _ in range(rounds):
        m = pruned((m @ m) ** markov.INFLATION)
    return m


@pytest.mark.parametrize("products", [4_000_000, 50])
def test_sparse_steps_match_a_dense_matrix(products, monkeypatch):
    """Attractors and what flows into them are those of Markov clustering, not of strongest links."""
    monkeypatch.setattr(markov, "PRODUCTS", products)
    r = np.random.default_rng(11)
    n, other = 60, 0
    for _ in range(5):
        p = np.unique(r.integers(0, n, (150, 2)), axis=0)
        p = np.unique(np.sort(p[p[:, 0] != p[:, 1]], axis=1), axis=0)
        w = r.uniform(0.2, 1, len(p))
        mass = r.integers(1, 9, n).astype(float)
        to, flow = markov.sparse_mcl(n, p[:, 0], p[:, 1], w, mass)
        m = dense_mcl(n, p[:, 0], p[:, 1], w, markov.ROUNDS)
        assert np.allclose(flow, m @ mass, atol=0.05) and abs(flow.sum() - mass.sum()) < 1e-6
        top = m.max(0)
        assert (m[to, np.arange(n)] >= top - 1e-3).all()
        other += (markov._roots(markov._strongest(n, p[:, 0], p[:, 1], w)) != markov._roots(to)).sum()
    assert other > 50


def test_a_hub_has_few_entries(spark, monkeypatch):
    """A node linked to very many is squared by its strongest entries, and stays in one group with all of them."""
    star = [(i, 0, 1.0 + i % 7) for i in range(1, 400)]
    got = {q["node"]: q["final"] for q in markov._stitched(spark.createDataFrame(star, "a long, b long, w double")).collect()}
    assert got == dict.fromkeys(range(400), 0)


def test_distributed_step_matches_the_local_one(spark):
    c = [(i, j) for i in range(5) for j in range(i)]
    e = [(*p, 1.0) for p in c] + [(i + 5, j + 5, 1.0) for i, j in c] + [(5, 0, 0.05)]
    root = {r["node"]: r["root"] for r in markov.distributed_mcl(spark.createDataFrame(e, "a long, b long, w double")).collect()}
    assert len({root[i] for i in range(5)}) == 1 and len({root[i] for i in range(5, 10)}) == 1 and root[0] != root[5]


def places(seed, n_places, cloud, start):
    r = np.random.default_rng(seed)
    rows, heads = [], set()
    for k in range(n_places):
        centre = np.array([k % 5, k // 5, 0]) * 3.5 + [0.5, 0.5, 0.5]
        m = 200 if k == 0 else int(r.integers(1, 6))
        ids = list(range(start + len(rows), start + len(rows) + m))
        heads.add(ids[0])
        rows += [(i, cloud, *map(float, centre + r.uniform(-0.3, 0.3, 3)), None) for i in ids]
    return rows, heads


@pytest.mark.parametrize("part_rows", [500_000, 30])
def test_every_place_is_chosen_once(spark, part_rows, monkeypatch):
    monkeypatch.setattr(dispersion, "PART_ROWS", part_rows)
    a, ha = places(1, 17, "a", 0)
    b, hb = places(2, 9, "b", 5000)
    rows = a + b + a[:50] + [(9000, "a", None, 1.0, 1.0, 1), (9001, None, 1.0, 1.0, 1.0, 1), (9002, "c", 1.0, 1.0, 1.0, 1)]
    req = spark.createDataFrame([("a", 17), ("b", 9), ("b", 3), ("none", 4), (None, 2), ("c", 0)], "cloud_id string, n_wanted int")
    got = dispersion.varied_subset(frame(spark, rows), req, tile=5.0).collect()
    assert sorted((r["cloud_id"], r["head_idx"]) for r in got) == sorted([("a", h) for h in ha] + [("b", h) for h in hb])
    size = {r["head_idx"]: r["group_size"] for r in got}
    assert size[0] == 200
    assert dispersion.varied_subset(frame(spark, []), req).count() == 0


@pytest.mark.parametrize("part_rows", [500_000, 60])
def test_as_many_records_as_wanted(spark, part_rows, monkeypatch):
    monkeypatch.setattr(dispersion, "PART_ROWS", part_rows)
    r = np.random.default_rng(6)
    size = [300, 1, 40] + [75] * 17
    centre = [[k % 5 * 3.5 + 0.5, k // 5 * 3.5 + 0.5, 0.5] for k in range(20)]
    at = np.repeat(np.arange(20), size)
    rows = [(i, "a", *map(float, centre[k] + r.uniform(-0.3, 0.3, 3)), None) for i, k in enumerate(at)]
    rows += [(5000 + i, "b", *map(float, centre[i % 3] + r.uniform(-0.3, 0.3, 3)), None) for i in range(30)]
    got = dispersion.varied_subset(frame(spark, rows), spark.createDataFrame([("a", 500), ("b", 99)], "cloud_id string, n_wanted int"), tile=5.0).collect()
    a = [q["idx"] for q in got if q["cloud_id"] == "a"]
    assert len(a) == len(set(a)) == 500 and len({q["idx"] for q in got if q["cloud_id"] == "b"}) == 30
    n = np.bincount(at[a], minlength=20)
    assert n[1] == 1 and n.max() <= 27 and n.min() >= 1


def test_local_search_ends_where_no_swap_helps():
    r = np.random.default_rng(4)
    p = r.normal(size=(40, 3))
    group = np.repeat(np.arange(10), 4)
    at, total = dispersion.local_search(p, group, 6)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    assert len(set(group[at])) == 6 and abs(d[np.ix_(at, at)].sum() / 2 - total) < 1e-9
    inside = set(at.tolist())
    for out in at:
        for q in set(range(40)) - inside:
            s = [k for k in at if k != out] + [q]
            if len(set(group[s])) == 6:
                assert d[np.ix_(s, s)].sum() / 2 <= total + 1e-6
    assert len(dispersion.local_search(p, group, 15)[0]) == 15 and len(dispersion.local_search(p, group, 99)[0]) == 40
