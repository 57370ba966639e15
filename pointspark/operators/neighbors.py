"""Exact nearest neighbours on a division of space that follows the density, and radius search on a grid.

A bounded sample of positions is split at medians into blocks of about equal numbers of points, however unevenly they lie.
Each block is searched where it lies, by a tree of its own points. A point whose k-th neighbour is nearer than the rim of
its block is settled; the others look once more, only into those blocks that their distance reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointspark.session import BROADCAST_ROWS, cut

_AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
#: Positions read to the driver to divide space, at most.
SAMPLE = 100_000
#: Points of a block in the mean; no block stands for fewer positions of the sample than LEAST, so that their number is bounded.
BLOCK_ROWS, LEAST = 4096, 8
#: Points of a leaf of a block's own tree.
LEAF = 64
_FOUND = "idx long, nidx long, rank int, dist double, dx double, dy double, dz double"


def _finite() -> Column:
    ok = F.col("idx").isNotNull()
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return ok


def _placed(points: DataFrame) -> DataFrame:
    return points.select("idx", *[F.col(c).cast("double").alias(c) for c in "xyz"]).where(_finite())


def positions(points: DataFrame) -> DataFrame:
    """``(idx, x, y, z)`` of finite positions; a repeated idx counts once (its smallest position)."""
    return _placed(points).groupBy("idx").agg(F.min(F.struct("x", "y", "z")).alias("p")).select("idx", "p.*")


# ---------------------------------------------------------------- trees in numpy


def _xyz(b) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in "xyz"], 1)


def _leaves(p: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows of p by leaves of a tree split at medians of the widest axis; equal positions stay together."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        at = todo.pop()
        low, high = p[at].min(0), p[at].max(0)
        axis = int((high - low).argmax())
        if len(at) <= most or not high[axis] > low[axis]:
            out.append(at)
            continue
        v = p[at, axis]
        middle = np.partition(v, len(at) // 2)[len(at) // 2]
        left = v < middle
        if not left.any():
            left = v <= middle
        todo += [at[left], at[~left]]
    return out


def _gap(low, high, lows, highs) -> np.ndarray:
    """Distance of one box from many."""
    d = np.maximum(0, np.maximum(lows - high, low - highs))
    return np.sqrt((d * d).sum(-1))


def _nearest(q: np.ndarray, q_id: np.ndarray, p: np.ndarray, p_id: np.ndarray, k: int, bound: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of p, distance): the k nearest of p for each q, no farther than its bound, in order of q, distance
    and id. With ``same`` a row of equal id is no neighbour."""
    none = np.zeros(0, np.int64)
    if not len(q) or not len(p):
        return none, none, np.zeros(0)
    leaf = max(LEAF, 2 * k)
    cells = _leaves(p, leaf)
    lows, highs = np.stack([p[c].min(0) for c in cells]), np.stack([p[c].max(0) for c in cells])
    n = np.array([len(c) for c in cells])
    need = k + int(same)
    rows, cols, dist = [], [], []
    for a in _leaves(q, LEAF):
        gap = _gap(q[a].min(0), q[a].max(0), lows, highs)
        reach = float(bound[a].max())
        order = np.argsort(gap, kind="stable")
        first = order[: int(np.searchsorted(np.cumsum(n[order]), need)) + 1]
        at = np.concatenate([cells[c] for c in first])
        if len(at) >= need:  # how far the k-th of these is bounds the search
            d = _distances(q[a], p[at])
            reach = min(reach, float(np.partition(d, need - 1, axis=1)[:, need - 1].max()))
        take = np.flatnonzero(gap <= reach * (1 + 1e-12))
        at = np.concatenate([cells[c] for c in take]) if len(take) else none
        if not len(at):
            continue
        d = _distances(q[a], p[at])
        if same:
            d[q_id[a][:, None] == p_id[at][None]] = np.inf
        most = bound[a]
        if len(at) > k:
            most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((d <= most[:, None]) & np.isfinite(d))
        o = np.lexsort((p_id[at[j]], d[i, j], i))
        i, j = i[o], j[o]
        ok = np.arange(len(i)) - np.searchsorted(i, i) < k
        rows.append(a[i[ok]])
        cols.append(at[j[ok]])
        dist.append(d[i[ok], j[ok]])
    if not rows:
        return none, none, np.zeros(0)
    rows, cols, dist = np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
    o = np.argsort(rows, kind="stable")
    return rows[o], cols[o], dist[o]


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = [p[None, :, c] - q[:, None, c] for c in range(3)]
    return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


class Space:
    """All of space divided into blocks, fitted to a sample of positions."""

    def __init__(self, sample: np.ndarray, total: int, k: int):
        blocks = max(1, min(total // max(BLOCK_ROWS, 8 * (k + 1)), len(sample) // LEAST))
        least = max(1, len(sample) // blocks)
        self.axis, self.at, self.next = [], [], []
        lows, highs, self.hot = [], [], []
        todo = [(np.arange(len(sample)), np.full(3, -np.inf), np.full(3, np.inf), -1, 0)]
        while todo:
            rows, low, high, parent, side = todo.pop()
            node = len(self.axis)
            if parent >= 0:
                self.next[parent][side] = node
            v = sample[rows]
            wide = v.max(0) - v.min(0) if len(v) else np.zeros(3)
            axis = int(wide.argmax())
            self.axis.append(axis)
            self.next.append([-1, -1])
            if len(rows) < 2 * least or not wide[axis] > 0:
                self.at.append(len(lows))
                self.axis[node] = -1
                lows.append(low)
                highs.append(high)
                if blocks > 1 and len(rows) >= 2 * least:
                    self.hot.append(tuple(v[0]))  # one position that several blocks would not hold
                continue
            middle = np.partition(v[:, axis], len(rows) // 2)[len(rows) // 2]
            left = v[:, axis] < middle
            if not left.any():
                middle = v[v[:, axis] > middle, axis].min()
                left = v[:, axis] < middle
            self.at.append(float(middle))
            up, down = high.copy(), low.copy()
            up[axis] = down[axis] = middle
            todo += [(rows[left], low, up, node, 0), (rows[~left], down, high, node, 1)]
        self.lows, self.highs = np.stack(lows), np.stack(highs)
        self.axis, self.next, self.at = np.array(self.axis), np.array(self.next), np.array(self.at, float)

    def block(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        while len(go := np.flatnonzero(self.axis[node] >= 0)):
            n = node[go]
            node[go] = self.next[n, (p[go, self.axis[n]] >= self.at[n]).astype(int)]
        return self.at[node].astype(np.int64)

    def reached(self, p: np.ndarray, own: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block): the blocks other than its own that may hold a point within each row's bound."""
        rows, blocks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.lows) > 1 and len(p):
            for a in _leaves(p, LEAF):
                near = np.flatnonzero(_gap(p[a].min(0), p[a].max(0), self.lows, self.highs) <= bound[a].max() * (1 + 1e-12))
                d = _gap(p[a][:, None], p[a][:, None], self.lows[near][None], self.highs[near][None])
                i, j = np.nonzero((d <= bound[a][:, None] * (1 + 1e-12)) & (near[None] != own[a][:, None]))
                rows.append(a[i])
                blocks.append(near[j])
        return np.concatenate(rows), np.concatenate(blocks)


def _divided(points: DataFrame, k: int) -> Space | None:
    """Space divided for these points ``(x, y, z)``: one pass, of each partition a part of its points, put together by one
    task to SAMPLE at most, as many of each partition as its points are worth; None if there are no points."""
    share = max(64, SAMPLE // int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packed(n: int, p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.ascontiguousarray(p).tobytes()], pa.binary())], names=["n", "p"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros((0, 4))
        for b in batches:
            p = _xyz(b)
            held = np.concatenate([held, np.column_stack([p, np.random.default_rng(n).random(len(p))])])
            if len(held) > 2 * share:
                held = held[np.argpartition(held[:, 3], share)[:share]]
            n += len(p)
        if n:
            yield packed(n, held[np.argsort(held[:, 3])[:share], :3])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted((n, p) for b in batches for n, p in zip(b.column("n").to_pylist(), b.column("p").to_pylist(), strict=True))
        if parts:
            n = sum(m for m, _ in parts)
            rate = min([SAMPLE / n, *(len(p) / 24 / m for m, p in parts)])
            yield packed(n, np.concatenate([np.frombuffer(p).reshape(-1, 3)[: max(1, int(np.ceil(rate * m)))] for m, p in parts]))

    one = points.select("x", "y", "z").mapInArrow(part, "n long, p binary").repartition(1).mapInArrow(total, "n long, p binary").first()
    return None if one is None else Space(np.frombuffer(one["p"]).reshape(-1, 3), one["n"], k)


# ---------------------------------------------------------------- blocks as partitions


def _blocked(p: DataFrame, space: Space) -> DataFrame:
    """``(block, idx, x, y, z)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(space.block(_xyz(b))), *b.columns], names=["block", "idx", "x", "y", "z"])

    return p.select("idx", "x", "y", "z").mapInArrow(run, "block long, idx long, x double, y double, z double")


def _by_block(df: DataFrame) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "block").sortWithinPartitions("block")


def runs(batches: Iterator[pa.RecordBatch], key: str = "block") -> Iterator[pa.Table]:
    """One table for each value of the key; equal ones come one after the other."""
    held: list[pa.Table] = []
    for b in batches:
        keys = b.column(key).to_numpy()
        edge = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for f, g in zip(edge[:-1], edge[1:], strict=True):
            if g > f:
                if held and held[-1].column(key)[0].as_py() != keys[f]:
                    yield pa.concat_tables(held)
                    held = []
                held.append(pa.Table.from_batches([b.slice(f, g - f)]))
    if held:
        yield pa.concat_tables(held)


def _rows(kind: int, q_id, q, p_id, p, i, j, dist, rank) -> pa.RecordBatch:
    d = p[j] - q[i]
    n = len(i)
    cols = [np.full(n, kind, np.int32), q_id[i], p_id[j], rank.astype(np.int32), dist, *(np.ascontiguousarray(d[:, c]) for c in range(3)), np.zeros(n, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "idx", "nidx", "rank", "dist", "dx", "dy", "dz", "block"])


_KINDS = "kind int, idx long, nidx long, rank int, dist double, dx double, dy double, dz double, block long"


def _rank(i: np.ndarray) -> np.ndarray:
    return np.arange(len(i)) - np.searchsorted(i, i) + 1


def _own_blocks(batches: Iterator[pa.RecordBatch], space: Space, k: int) -> Iterator[pa.RecordBatch]:
    """Neighbours within each block: kind 0 of settled points, kind 1 of others; kind 2, where those have to look once more:
    (idx, block), their position in dx, dy, dz and the bound in dist.

    Of points at one position only the k + 1 with the smallest idx can be neighbours of anything; the others' neighbours
    are the first k of them.
    """
    for t in runs(batches):
        ids, p = t.column("idx").to_numpy(), _xyz(t)
        own = np.full(len(p), t.column("block")[0].as_py())
        o = np.lexsort((ids, p[:, 2], p[:, 1], p[:, 0]))
        new = np.r_[True, (p[o][1:] != p[o][:-1]).any(1)]
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank = np.arange(len(o)) - start
        more = np.flatnonzero(rank > k)
        if len(more):
            i, j = np.repeat(o[more], k), o[(start[more][:, None] + np.arange(k)).ravel()]
            yield _rows(0, ids, p, ids, p, i, j, np.zeros(len(i)), np.tile(np.arange(1, k + 1), len(more)))
            first = np.sort(o[rank <= k])
            ids, p, own = ids[first], p[first], own[first]
        i, j, dist = _nearest(p, ids, p, ids, k, np.full(len(p), np.inf), True)
        bound = np.full(len(p), np.inf)
        full = np.bincount(i, minlength=len(p)) == k
        last = np.flatnonzero(np.r_[i[1:] != i[:-1], True]) if len(i) else i
        bound[i[last]] = dist[last]
        bound[~full] = np.inf
        row, block = space.reached(p, own, bound)
        open_ = np.zeros(len(p), bool)
        open_[row] = True
        for kind, at in ((0, np.flatnonzero(~open_[i])), (1, np.flatnonzero(open_[i]))):
            yield _rows(kind, ids, p, ids, p, i[at], j[at], dist[at], _rank(i)[at])
        yield _asked(ids, p, bound, row, block)


def _asked(ids, p, bound, row, block) -> pa.RecordBatch:
    n = len(row)
    cols = [np.full(n, 2, np.int32), ids[row], np.zeros(n, np.int64), np.zeros(n, np.int32), bound[row], *(np.ascontiguousarray(p[row, c]) for c in range(3)), block]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "idx", "nidx", "rank", "dist", "dx", "dy", "dz", "block"])


def _visits(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Neighbours that visitors (bound is not null) find among the points of a block."""
    for t in runs(batches):
        bound = t.column("bound").to_numpy()
        ids, p = t.column("idx").to_numpy(), _xyz(t)
        q, s = np.flatnonzero(~np.isnan(bound)), np.flatnonzero(np.isnan(bound))
        i, j, dist = _nearest(p[q], ids[q], p[s], ids[s], k, bound[q], False)
        yield _rows(1, ids[q], p[q], ids[s], p[s], i, j, dist, _rank(i))


def _visited(asked: DataFrame, blocked: DataFrame, k: int) -> DataFrame:
    """Rows of kind 1 for visitors ``(block, idx, x, y, z, bound)`` of blocks ``(block, idx, x, y, z)``."""
    both = blocked.select("block", "idx", "x", "y", "z", F.lit(float("nan")).alias("bound")).union(asked)
    return _by_block(both).mapInArrow(lambda it: _visits(it, k), _KINDS)


def _merged(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("idx").orderBy("dist", "nidx"))
    return rows.select("idx", "nidx", rank.alias("rank"), "dist", "dx", "dy", "dz").where(F.col("rank") <= k)


def knn(points: DataFrame, k: int) -> DataFrame:
    """``(idx, nidx, rank, dist, dx, dy, dz)``: the k nearest other points, rank from 1, ties by smaller nidx.

    ``dx, dy, dz`` is the neighbour minus the point. Exact. Fewer than k other points give fewer rows, an empty or
    single-point cloud none; points without finite position or idx take no part, a repeated idx counts once. The division
    of space follows the density and has a bounded number of blocks; a block is searched by its own tree, so no two points
    are compared that are far apart for their surroundings. A position that several blocks would not hold is taken out
    first, but for its k + 1 smallest idx.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    space = _divided(_placed(points), k)
    if space is None:
        return points.sparkSession.createDataFrame([], _FOUND)
    names = [c.split()[0] for c in _FOUND.split(", ")]
    if len(space.lows) == 1:  # one task has them all, so nothing is laid out or visited
        one = positions(points).select(F.lit(0).cast("long").alias("block"), "idx", "x", "y", "z").coalesce(1)
        return one.mapInArrow(lambda it: _own_blocks(it, space, k), _KINDS).select(*names)
    blocked = cut(_blocked(positions(points), space))
    extra = None
    if space.hot:
        blocked, extra = _without_hot(blocked, space, k)
    out = cut(_by_block(blocked).mapInArrow(lambda it: _own_blocks(it, space, k), _KINDS))
    asked = out.where("kind = 2").select("block", "idx", F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"), F.col("dist").alias("bound"))
    again = out.where("kind = 1").union(_visited(asked, blocked, k))
    found = out.where("kind = 0").select(*names).union(_merged(again, k))
    return found if extra is None else found.union(extra)


def _without_hot(blocked: DataFrame, space: Space, k: int) -> tuple[DataFrame, DataFrame]:
    """The blocks without the surplus of positions that very many points share, and the neighbours of those.

    Such positions make up a block of the sample each, so their number is bounded, as are the k + 1 idx of each that are read.
    """
    places = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(h, "xyz", strict=True)]) for h in space.hot])
    b = blocked.withColumn("hot", F.array_position(places, F.struct("x", "y", "z")))
    w = Window.partitionBy("hot").orderBy("idx")
    low = b.where("hot > 0").select("hot", "idx").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).collect()
    first: dict[int, list[int]] = {}
    for r in sorted(low, key=lambda r: (r["hot"], r["idx"])):
        first.setdefault(r["hot"], []).append(r["idx"])
    full = {h: ids for h, ids in first.items() if len(ids) > k}
    if not full:
        return blocked, None
    last = F.coalesce(*[F.when(F.col("hot") == h, F.lit(ids[k])) for h, ids in full.items()])
    near = F.coalesce(*[F.when(F.col("hot") == h, F.array(*[F.lit(i) for i in ids[:k]])) for h, ids in full.items()])
    surplus = (F.col("hot") > 0) & last.isNotNull() & (F.col("idx") > last)
    rest = cut(b.where(~F.coalesce(surplus, F.lit(False))).drop("hot"))
    extra = b.where(surplus).select("idx", F.posexplode(near).alias("r", "nidx"))
    zero = [F.lit(0.0).alias(c) for c in ("dist", "dx", "dy", "dz")]
    return rest, extra.select("idx", F.col("nidx").cast("long").alias("nidx"), (F.col("r") + 1).cast("int").alias("rank"), *zero)


# ---------------------------------------------------------------- one cloud in another


class Target:
    """A cloud in which others look for their nearest point again and again.

    With no more than BROADCAST_ROWS points (counted) they travel with the plan, and a search is one pass over the source;
    else they lie in blocks, and a search has the two rounds of ``knn``.
    """

    def __init__(self, target: DataFrame):
        self.points = cut(positions(target))
        self.rows = self.points.count()
        self.held, self.space = None, None
        if self.rows <= BROADCAST_ROWS:
            rows = self.points.collect()
            self.held = np.array([r["idx"] for r in rows], np.int64), np.array([[r["x"], r["y"], r["z"]] for r in rows], float).reshape(-1, 3)
        else:
            self.space = _divided(self.points, 1)
            self.blocked = cut(_blocked(self.points, self.space))

    def nearest(self, source: DataFrame, max_dist: float) -> DataFrame:
        """``(idx, nidx, dist, x, y, z, dx, dy, dz)`` for positions ``(idx, x, y, z)`` of a source: the nearest point
        nearer than ``max_dist``, ties by smaller nidx, and where it lies from the source point."""
        src = source.select("idx", "x", "y", "z")
        below = np.nextafter(max_dist, 0)
        names = ["idx", "nidx", "dist", "x", "y", "z", "dx", "dy", "dz"]
        if self.held is not None:
            p_id, p = self.held

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    q_id, q = b.column("idx").to_numpy(), _xyz(b)
                    i, j, dist = _nearest(q, q_id, p, p_id, 1, np.full(len(q), below), False)
                    d = p[j] - q[i]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (q_id[i], p_id[j], dist, *q[i].T, *d.T)], names=names)

            return src.mapInArrow(run, ", ".join(f"{c} {'long' if c.endswith('idx') else 'double'}" for c in names))
        space = self.space
        first = _blocked(src, space).withColumn("bound", F.lit(float(below)))
        got = cut(_visited(first, self.blocked, 1))
        # what was found bounds the second round; a source point that found nothing has the full distance to look into
        left = src.join(got.select("idx", F.col("dist").alias("bound")), "idx", "left").withColumn("bound", F.coalesce("bound", F.lit(float(below))))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = _xyz(b)
                row, block = space.reached(q, space.block(q), b.column("bound").to_numpy())
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(block), *(b.column(c).take(rows) for c in ("idx", "x", "y", "z", "bound"))], names=["block", "idx", "x", "y", "z", "bound"])

        asked = left.select("idx", "x", "y", "z", "bound").mapInArrow(reach, "block long, idx long, x double, y double, z double, bound double")
        best = got.union(_visited(asked, self.blocked, 1)).groupBy("idx").agg(F.min(F.struct("dist", "nidx", "dx", "dy", "dz")).alias("m"))
        return src.join(best, "idx").select("idx", F.col("m.nidx").alias("nidx"), F.col("m.dist").alias("dist"), "x", "y", "z", *[F.col(f"m.d{c}").alias(f"d{c}") for c in "xyz"])


def nearest_within(source: DataFrame, target: DataFrame, max_dist: float) -> DataFrame:
    """``(src_idx, tgt_idx, dist)``: each source point's nearest target nearer than ``max_dist``, ties by smaller idx."""
    n = Target(target).nearest(positions(source), max_dist)
    return n.select(F.col("idx").alias("src_idx"), F.col("nidx").alias("tgt_idx"), "dist")


# ---------------------------------------------------------------- radius search


def _cells(cell: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(cell)).cast("long").alias(f"c{c}") for c in "xyz"]


def radius_neighbors(points: DataFrame, radius: float) -> DataFrame:
    """``(idx, nidx, dist, dx, dy, dz)``: all other points at most ``radius`` away; cells of that edge make it exact.

    The rows are all pairs by definition. The side that looks around is dealt out by idx where the other side is small
    enough to be sent to all tasks (counted, BROADCAST_ROWS).
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    p = cut(positions(points))
    small = p.count() <= BROADCAST_ROWS
    q = p.select("idx", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"), *_cells(radius))
    if small:
        q = q.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "idx")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in _AROUND])
    q = q.withColumn("o", F.explode(around)).select("idx", "qx", "qy", "qz", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), (F.col("cz") + F.col("o.k")).alias("cz"))
    s = p.select(F.col("idx").alias("nidx"), "x", "y", "z", *_cells(radius))
    d = q.join(F.broadcast(s) if small else s, ["cx", "cy", "cz"]).where("idx <> nidx")
    d = d.select("idx", "nidx", (F.col("x") - F.col("qx")).alias("dx"), (F.col("y") - F.col("qy")).alias("dy"), (F.col("z") - F.col("qz")).alias("dz"))
    d = d.withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return d.where(F.col("dist") <= radius).select("idx", "nidx", "dist", "dx", "dy", "dz")
