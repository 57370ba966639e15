"""Choosing a varied subset: max-sum dispersion by local search on composable core-sets.

Each requested cloud is cut into tiles. A tile's core-set comes from farthest-first traversal, stopped when
every record of the tile is within ``radius`` of a chosen one; each chosen one brings a few delegates, the
records of its surroundings that lie farthest out, or as many as may be chosen of one group where that is more.
Core-sets compose: the union of the tiles' core-sets
represents the cloud, and only it is gathered for the last step. Its size follows the number of places of
the cloud and of the records wanted of a place, not that of its records.

On the union, records within ``radius`` of each other form a group. At most ``ceil(n / groups)`` records of a
group may be chosen (a partition matroid, for which local search keeps its guarantee), so large groups are
not over-represented and, when as many records are wanted as there are groups, every group is. From a
farthest-first start, selected and unselected candidates are swapped until no swap makes the total pairwise
distance grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.points import measured
from pointspark.session import cut

RADIUS = 1.1
TILE = 16.0
#: Delegates of a group at least.
DELEGATES = 2
#: A tile with more records is dealt out to parts of about so many by a hash of idx; core-sets of parts compose like those
#: of tiles. What is chosen of a place may follow it, the places do not.
PART_ROWS = 500_000

_CORE = "cloud_id string, n_wanted int, delegates int, idx long, x double, y double, z double, seed long, low long, n long"


def _farthest_first(p: np.ndarray, radius: float) -> tuple[list[int], np.ndarray]:
    """Seeds in order, and each record's nearest seed, until all are within the radius. Starts at record 0."""
    seeds, near = [0], np.zeros(len(p), np.int64)
    best = ((p - p[0]) ** 2).sum(1)
    while True:
        k = int(best.argmax())
        if best[k] <= radius * radius:
            return seeds, near
        d = ((p - p[k]) ** 2).sum(1)
        closer = d < best
        near[closer] = len(seeds)
        best = np.where(closer, d, best)
        seeds.append(k)


def _core_set(g: pd.DataFrame, radius: float) -> pd.DataFrame:
    g = g.drop_duplicates("idx").sort_values("idx", kind="stable")
    p = g[["x", "y", "z"]].to_numpy()
    seeds, near = _farthest_first(p, radius)
    # groups in order of seed: all members, and those farthest from the seed as delegates
    d = ((p - p[np.array(seeds)[near]]) ** 2).sum(1)
    o = np.lexsort((g["idx"].to_numpy(), -d, near))
    first = np.flatnonzero(np.r_[True, near[o][1:] != near[o][:-1]])
    n = np.diff(np.r_[first, len(o)])
    rank = np.arange(len(o)) - np.repeat(first, n)
    take = o[rank < g["delegates"].to_numpy()[o]]
    take = np.unique(np.r_[take, seeds])
    low = np.minimum.reduceat(g["idx"].to_numpy()[o], first)
    out = g.iloc[take][["cloud_id", "n_wanted", "delegates", "idx", "x", "y", "z"]].copy()
    out["seed"] = g["idx"].to_numpy()[np.array(seeds)[near[take]]]
    out["low"] = low[near[take]]
    out["n"] = n[near[take]]
    return out


def _core_sets(batches: Iterator[pd.DataFrame], radius: float) -> Iterator[pd.DataFrame]:
    """Core-sets of tiles; the rows of a partition come in order of tile."""
    held = None
    for b in batches:
        held = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(held):
            held = None
            continue
        tile = held["tile"].to_numpy()
        if tile[0] == tile[-1]:
            continue
        last = int(np.flatnonzero(tile != tile[-1])[-1]) + 1
        done, held = held.iloc[:last], held.iloc[last:]
        yield pd.concat([_core_set(g, radius) for _, g in done.groupby("tile", sort=False)])
    if held is not None and len(held):
        yield _core_set(held, radius)


def _groups(p: np.ndarray, seed: np.ndarray, radius: float) -> np.ndarray:
    """Group of each candidate: candidates of one seed, and seeds whose candidates lie within the radius."""
    _, label = np.unique(seed, return_inverse=True)
    order = np.argsort(p[:, 0], kind="stable")
    x = p[order, 0]
    a, b = [], []
    hi = np.searchsorted(x, x + radius, "right")
    for k in range(1, int((hi - np.arange(len(x))).max(initial=1))):  # neighbours in order of x
        i = np.flatnonzero(np.arange(len(x)) + k < hi)
        u, v = order[i], order[i + k]
        ok = (((p[u] - p[v]) ** 2).sum(1) <= radius * radius) & (label[u] != label[v])
        a.append(u[ok])
        b.append(v[ok])
    if a:
        u, v = np.concatenate(a), np.concatenate(b)
        while True:
            new = label.copy()
            np.minimum.at(new, label[u], label[v])
            np.minimum.at(new, label[v], label[u])
            low = np.minimum(label[u], label[v])
            root = np.arange(label.max() + 1)
            np.minimum.at(root, label[u], low)
            np.minimum.at(root, label[v], low)
            nxt = root[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
    return np.unique(label, return_inverse=True)[1]


def local_search(p: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Positions chosen out of the candidates, at most ceil(n / groups) of a group, and their total distance."""
    m = len(p)
    n = min(n, m)
    if n <= 0:
        return np.zeros(0, np.int64), 0.0
    most = -(-n // (int(group.max()) + 1))
    used = np.zeros(int(group.max()) + 1, np.int64)
    chosen = np.zeros(m, bool)
    x, y, z = (np.ascontiguousarray(p[:, c]) for c in range(3))
    far2 = lambda a, b, c: (x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2
    far = lambda k: np.sqrt(far2(x[k], y[k], z[k]))
    best = far2(*p.mean(0))
    first = True
    for _ in range(n):  # farthest-first start within the matroid
        open_ = ~chosen & (used[group] < most)
        if not open_.any():
            most += 1
            open_ = ~chosen & (used[group] < most)
        k = int(np.where(open_, best, -1).argmax())
        chosen[k] = True
        used[group[k]] += 1
        d = far2(x[k], y[k], z[k])
        best, first = (d if first else np.minimum(best, d)), False
    order, everyone = np.argsort(group, kind="stable"), np.arange(m)
    first_of = np.searchsorted(group[order], np.arange(group.max() + 2))
    swapped = True
    while swapped:
        swapped = False
        to_all = np.zeros(m)  # distance of each candidate to all chosen ones, anew so that rounding does not add up to a gain
        for k in np.flatnonzero(chosen):
            to_all += far(k)
        least = max(1e-9, 1e-12 * to_all.max())
        for q in np.flatnonzero(~chosen):
            g = group[q]
            # a full group only exchanges its own
            at = order[first_of[g] : first_of[g + 1]] if used[g] >= most else everyone
            at = at[chosen[at]]
            if not len(at):
                continue
            gain = to_all[q] - np.sqrt(((p[at] - p[q]) ** 2).sum(1)) - to_all[at]
            k = int(at[gain.argmax()])
            if gain.max() > least:
                chosen[k], chosen[q] = False, True
                used[group[k]] -= 1
                used[g] += 1
                to_all += far(q) - far(k)
                swapped = True
    return np.flatnonzero(chosen), float(to_all[chosen].sum() / 2)


def _short(c: pd.DataFrame, radius: float) -> pd.DataFrame:
    """The delegates a cloud needs, if groups must give more records than they sent although they have them."""
    n, used = int(c["n_wanted"].iloc[0]), int(c["delegates"].iloc[0])
    c = c.sort_values("idx", kind="stable").reset_index(drop=True)
    group = _groups(c[["x", "y", "z"]].to_numpy(), c["seed"].to_numpy(), radius)
    seeds = c.drop_duplicates("seed")
    size = np.bincount(group[seeds.index], seeds["n"], group.max() + 1).astype(np.int64)
    level = -(-n // len(size))
    while (left := min(n, size.sum()) - np.minimum(size, level).sum()) > 0:  # small groups leave more to the others
        level += -(-left // len(size))
    need = level > used and (seeds["n"] > used).any()
    return pd.DataFrame({"cloud_id": c["cloud_id"].iloc[:1], "delegates": np.int32(min(n, max(level, 2 * used)))})[: int(need)]


def _select(c: pd.DataFrame, radius: float) -> pd.DataFrame:
    c = c.sort_values("idx", kind="stable").reset_index(drop=True)
    p = c[["x", "y", "z"]].to_numpy()
    group = _groups(p, c["seed"].to_numpy(), radius)
    at, total = local_search(p, group, int(c["n_wanted"].iloc[0]))
    low = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group, c["low"].to_numpy())
    seeds = c.drop_duplicates("seed")
    size = np.bincount(group[seeds.index], seeds["n"], group.max() + 1).astype(np.int64)
    out = c.iloc[at][["cloud_id", "idx", "x", "y", "z"]].copy()
    out["head_idx"], out["group_size"], out["total_distance"] = low[group[at]], size[group[at]], total
    return out


def varied_subset(points: DataFrame, requests: DataFrame, radius: float = RADIUS, tile: float = TILE, delegates: int = DELEGATES) -> DataFrame:
    """The chosen records: ``(cloud_id, idx, x, y, z, head_idx, group_size, total_distance)``.

    ``head_idx`` is the smallest idx of the chosen record's group and ``group_size`` the number of its records,
    counted over all of them. Of several requests for a cloud the largest holds; null clouds and null or
    non-positive numbers are left out; a cloud with fewer records than wanted gives all of them. Records without a measured position take no part, repeated records count once.
    """
    wanted = requests.groupBy("cloud_id").agg(F.max("n_wanted").cast("int").alias("n_wanted")).where("n_wanted > 0")
    p = measured(points).join(wanted, "cloud_id")
    t = [F.floor(F.col(c) / tile) for c in "xyz"]
    p = p.select(F.xxhash64("cloud_id", *t).alias("tile"), "cloud_id", "n_wanted", "idx", "x", "y", "z")
    large = cut(p.groupBy("tile").count().where(F.col("count") > PART_ROWS).select("tile", F.ceil(F.col("count") / PART_ROWS).alias("parts")))
    if not large.isEmpty():  # at most one row for PART_ROWS records
        part = F.pmod(F.xxhash64("idx"), F.coalesce("parts", F.lit(1)))
        p = p.join(large, "tile", "left").withColumn("tile", F.xxhash64("tile", part)).drop("parts")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    core_of = lambda p: p.repartition(n, "tile").sortWithinPartitions("tile").mapInPandas(lambda it: _core_sets(it, radius), _CORE)
    short_of = lambda core: cut(core.repartition(n, "cloud_id").groupBy("cloud_id").applyInPandas(lambda g: _short(g, radius), "cloud_id string, delegates int"))
    core = cut(core_of(p.withColumn("delegates", F.lit(delegates))))
    short = short_of(core)
    while not short.isEmpty():  # delegates at least double, up to the number wanted
        core = cut(core.join(short, "cloud_id", "left_anti").union(core_of(p.join(short, "cloud_id"))))
        short = short_of(core)
    out = "cloud_id string, idx long, x double, y double, z double, head_idx long, group_size long, total_distance double"
    return core.repartition(n, "cloud_id").groupBy("cloud_id").applyInPandas(lambda g: _select(g, radius), out)
