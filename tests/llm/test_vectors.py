"""Most similar vectors: recall against brute force, ties, copies, unusable vectors."""

import numpy as np
import pytest

from pointspark.llm import neighbours as nb


def frame(spark, rows):
    return spark.createDataFrame([(i, "c", v, "clash") for i, v in rows], "vec_id long, cloud_id string, feat array<float>, dist string")


def brute(ids, x, k):
    out = {}
    for i, a in zip(ids, x, strict=True):
        d = np.sqrt(((x - a) ** 2).sum(1))
        o = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in o]
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(nb, "LIST_ROWS", 40)
    r = np.random.default_rng(1)
    centres = r.normal(size=(60, 16))
    x = np.concatenate([c + r.normal(0, 0.15, (n, 16)) for c, n in zip(centres, r.integers(1, 30, 60), strict=True)]).astype(np.float32)
    ids = r.permutation(len(x)).astype(np.int64)
    want = brute(ids, x.astype(float), 5)
    got = {}
    for q in nb.most_similar(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]), 5, dim=16).collect():
        got.setdefault(q["a"], []).append(q["b"])
    hit = sum(len({j for j, _ in w} & set(got[i])) for i, w in want.items())
    assert hit / (5 * len(x)) >= 0.9
    near = {(q["a"], q["b"]): q["dist"] for q in nb.most_similar(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]), 5, 0.5, dim=16).collect()}
    true = {(i, j): d for i, w in want.items() for j, d in w if d <= 0.5}
    assert len(set(near) & set(true)) >= 0.97 * len(true)
    assert all(abs(near[p] - true[p]) < 1e-9 for p in set(near) & set(true))


def test_dense_group_is_exact(spark, monkeypatch):
    """A third of the vectors in one group, all within the limit, over many lists and blocks."""
    monkeypatch.setattr(nb, "LIST_ROWS", 20)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 400)
    monkeypatch.setattr(nb, "AXES", 12)
    r = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = np.concatenate([unit(unit(r.normal(size=(1, 48))) + r.normal(0, 0.025, (700, 48))), unit(np.repeat(unit(r.normal(size=(100, 48))), 14, 0) + r.normal(0, 0.03, (1400, 48))), 50 * unit(r.normal(size=(9, 48)))])
    x = x.astype(np.float32)
    ids = r.permutation(len(x)).astype(np.int64)
    true = {(i, j): d for i, w in brute(ids, x.astype(float), 5).items() for j, d in w if d <= 0.38}
    got = {(q["a"], q["b"]): q["dist"] for q in nb.most_similar(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]), 5, 0.38, dim=48).collect()}
    assert len([1 for i, _ in true if i in set(ids[:700].tolist())]) == 3500
    assert set(got) == set(true)
    assert all(abs(got[p] - true[p]) < 1e-9 for p in got)


def test_copies_and_unusable_vectors(spark):
    one, other = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0]
    rows = [(i, one) for i in range(20)] + [(50, other), (51, None), (52, [0.0] * 3), (53, [1.0, float("nan"), 0.0]), (54, [1.0, 0.0]), (55, [1.0, None, 0.0]), (None, one), (3, one), (56, [float("inf"), 0.0, 0.0])]
    got = {}
    for q in nb.most_similar(frame(spark, rows), 3, dim=3).collect():
        got.setdefault(q["a"], []).append((q["dist"], q["b"]))
    assert set(got) == {*range(20), 50}
    for i in range(20):
        assert sorted(got[i]) == [(0.0, j) for j in range(5) if j != i][:3]
    assert [b for _, b in sorted(got[50])] == [0, 1, 2]
    assert nb.most_similar(frame(spark, []), 3, dim=3).count() == 0
    assert nb.most_similar(frame(spark, [(1, one)]), 3, dim=3).count() == 0


@pytest.mark.parametrize("n", [1, 7, 300])
def test_heads_cover_the_sample(n):
    x = np.random.default_rng(2).normal(size=(n, 8)).astype(np.float32)
    h = nb.Heads(nb.fit_heads(x, max(1, n // 3), 0.0), 0.2)
    i, lists = h.lists(x)
    assert set(i.tolist()) == set(range(n)) and (lists >= 0).all() and (lists < len(h.c)).all()
    assert len({(a, b) for a, b in zip(i.tolist(), lists.tolist(), strict=True)}) == len(i)
    d = np.sqrt(((x[:, None] - h.c[None]) ** 2).sum(2))
    first = d.argmin(1)
    apart = np.sqrt(((h.c[:, None] - h.c[None]) ** 2).sum(2))
    band = {(k, j) for k in range(n) for j in range(len(h.c)) if d[k, j] ** 2 - d[k, first[k]] ** 2 <= 0.4 * apart[first[k], j]}
    assert len(band & set(zip(i.tolist(), lists.tolist(), strict=True))) >= 0.95 * len(band)


def test_long_lists_are_divided(spark, monkeypatch):
    """Lists of several blocks, and blocks divided by lists of their own, find what short lists find."""
    monkeypatch.setattr(nb, "SAMPLE", 150)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 120)
    monkeypatch.setattr(nb, "FINE_ROWS", 60)
    monkeypatch.setattr(nb, "LIST_ROWS", 30)
    r = np.random.default_rng(5)
    x = np.concatenate([c + r.normal(0, 0.02, (12, 24)) for c in r.normal(size=(120, 24)) / 5]).astype(np.float32)
    ids = r.permutation(len(x)).astype(np.int64)
    true = {(i, j) for i, w in brute(ids, x.astype(float), 5).items() for j, d in w if d <= 0.38}
    got = {(q["a"], q["b"]) for q in nb.most_similar(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]), 5, 0.38, dim=24).collect()}
    assert len(got & true) >= 0.97 * len(true)


def test_other_vectors_under_one_id(spark):
    got = {(q["a"], q["b"], round(q["dist"], 6)) for q in nb.most_similar(frame(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])]), 2, dim=2).collect()}
    assert len(got) == 2 and {(a, b) for a, b, _ in got} == {(1, 2), (2, 1)} and len({e for _, _, e in got}) == 1
