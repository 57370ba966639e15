"""The most similar vectors for every vector by balanced posting lists.

* A bounded sample is split by balanced k-means, node by node, until each leaf has its share; the leaves' centres are the
  heads of posting lists. Dense regions get as many lists as their part of the sample. A leaf whose vectors lie within the
  limit of each other is not split: in many dimensions no division of such a group keeps neighbours together.
* Heads are searched by a graph of their nearest heads, held in memory, from a few entry points (beam search, many vectors
  at a time); a vector that may have more lists to look into than the beam holds is compared with all heads.
* A vector goes to its nearest list and, near a boundary, to several: list j with head h_j is pruned by the ratio of the
  distances d_j and d_1 to its head and the nearest one, as (d_j / d_1)^2 > 1 + 2 slack |h_j - h_1| / d_1^2 means that the
  vector is farther than ``slack`` from the boundary of the two lists. The number of lists is not limited. It is stored in
  all of them and looks into all of them, so two vectors miss each other only if their difference goes straight across a
  boundary by more than twice the slack.
* A list that would be too long for one task is dealt into blocks by a hash of the id, each two of which meet once; a long
  block is divided again by lists of its own, fitted where it lies, unless it is one dense group.
* Within a list the first principal axes, which never lengthen a distance, leave only pairs that may be within the limit;
  single precision preselects, double precision decides; results of the lists are merged.

Exact copies are taken out first. Of copies only the k + 1 with the smallest vec_id are indexed: no other can
be among anyone's k nearest, and the nearest of the others are these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointspark.llm.words import mixed
from pointspark.session import BROADCAST_ROWS, cut

DIM = 352
#: Heads and axes are fitted on about so many vectors, chosen by a hash of the id.
SAMPLE = 20_000
#: Vectors of a list in the mean, before replication; vectors of the sample that a list stands for at least.
LIST_ROWS, LEAF = 512, 4
#: Width of the band along the boundary of two lists whose vectors go to both, as a part of the limit.
SLACK = 0.12
DEGREE, BEAM, AT_ONCE = 12, 16, 4
#: Pairs whose distance is worked out at a time.
EXACT = 4096
#: Vectors of a block at most, as far as the sample tells; of a cell that is not divided again.
BLOCK_ROWS, FINE_ROWS = 40_000, 4096
#: Axes that preselect; pairs of one vector in a list up to which all are worked out.
AXES, FEW = 64, 64


def usable(feat: Column, dim: int) -> Column:
    """``dim`` finite numbers that are not all zero. Only functions with generated code: a null entry makes ``array_contains``
    of a value that is not there null, and NaN is the largest number."""
    inf = float("inf")
    whole = F.array_contains(feat, F.lit(-inf).cast("float")) == F.lit(False)
    return (F.size(feat) == dim) & F.coalesce(whole, F.lit(False)) & (F.array_max(feat) < inf) & ((F.array_max(feat) > 0) | (F.array_min(feat) < 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _as_bytes(x: np.ndarray) -> pa.Array:
    """One binary value a row: cheaper to hand between Python and the JVM than lists of numbers."""
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int64) * x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)]).cast(pa.binary())


def _of_bytes(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    c = column.combine_chunks().cast(pa.large_binary())
    first = np.frombuffer(c.buffers()[1], np.int64)[c.offset] // 4
    return np.frombuffer(c.buffers()[2], np.float32)[first : first + len(c) * dim].reshape(-1, dim)


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit_heads(x: np.ndarray, n_lists: int, near: float, seed: int = 5) -> np.ndarray:
    """Centres of the leaves of a balanced k-means tree over the sample; vectors that in the mean are within ``near`` of each
    other are one leaf, and leaves that balancing made of one such group are put together again."""
    rng = np.random.default_rng(seed)
    leaf = max(1, len(x) // max(1, n_lists))
    leaves, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf or 2 * _sq(x[at], x[at].mean(0)[None]).mean() <= near * near:  # of all pairs, in the mean
            leaves.append(at)
            continue
        k = int(min(8, max(2, round(len(at) / leaf)), len(at)))
        c = x[rng.choice(at, k, replace=False)]
        most = int(np.ceil(len(at) / k * 1.5))
        for _ in range(5):
            d = _sq(x[at], c)
            own = d.argmin(1)
            for full in np.argsort(-np.bincount(own, minlength=k)):  # balance: the farthest members move on
                members = np.flatnonzero(own == full)
                if len(members) > most:
                    d[:, full] = np.where(own == full, d[:, full], np.inf)
                    out = members[np.argsort(d[members, full], kind="stable")[most:]]
                    d[out, full] = np.inf
                    own[out] = d[out].argmin(1)
            c = np.stack([x[at[own == j]].mean(0) if (own == j).any() else c[j] for j in range(k)])
        parts = [at[own == j] for j in range(k) if (own == j).any()]
        if len(parts) == 1:  # all alike
            parts = np.array_split(at, k)
        todo += parts
    heads = np.stack([x[at].mean(0) for at in leaves])
    spread = np.array([_sq(x[at], h[None]).mean() for at, h in zip(leaves, heads, strict=True)])
    dense = np.flatnonzero(spread <= near * near)
    root = np.arange(len(dense))
    for k, i in enumerate(dense):  # the mean of squared distances between two leaves
        one = np.flatnonzero(spread[i] + spread[dense[: k + 1]] + _sq(heads[i : i + 1], heads[dense[: k + 1]])[0] <= near * near)
        root[np.isin(root, root[np.r_[one, k]])] = root[np.r_[one, k]].min()
    merged = [x[np.concatenate([leaves[dense[k]] for k in np.flatnonzero(root == r)])].mean(0) for r in np.unique(root)]
    return np.concatenate([np.delete(heads, dense, 0), np.reshape(merged, (-1, x.shape[1]))]).astype(np.float32)


class Heads:
    """The heads of all lists with their graph."""

    def __init__(self, centres: np.ndarray, slack: float, seed: int = 5):
        self.c, self.slack = centres, slack
        n = len(centres)
        self.norm = (centres * centres).sum(1)
        g = min(DEGREE, max(1, n - 1))
        near = np.empty((n, g), np.int32)
        for at in range(0, n, 1024):
            d = _sq(centres[at : at + 1024], centres)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf if n > 1 else 0
            near[at : at + 1024] = np.argpartition(d, g - 1, axis=1)[:, :g]
        # a few far edges keep the graph connected; an edge given twice leads nowhere
        edge = np.concatenate([near, np.random.default_rng(seed).integers(0, n, (n, 4), np.int32)], 1)
        for k in range(1, edge.shape[1]):
            again = (edge[:, :k] == edge[:, k : k + 1]).any(1)
            edge[again, k] = np.flatnonzero(again)
        self.edge = edge
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 48)).astype(np.int64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The BEAM nearest heads of each row found by the graph, and their distances, ascending (-1 and inf: none)."""
        n, m = len(x), len(self.c)
        norm = (x * x).sum(1)
        seen = np.zeros((n, m), bool)
        d = np.maximum(norm[:, None] + self.norm[self.entry] - 2 * x @ self.c[self.entry].T, 0)
        ids = np.broadcast_to(self.entry, d.shape)
        if (short := BEAM - d.shape[1]) > 0:
            ids = np.pad(ids, ((0, 0), (0, short)), constant_values=-1)
            d = np.pad(d, ((0, 0), (0, short)), constant_values=np.inf)
        o = np.argsort(d, axis=1, kind="stable")[:, :BEAM]
        ids, d = np.take_along_axis(ids, o, 1), np.take_along_axis(d, o, 1)
        seen[:, self.entry] = True
        done = ids < 0
        while len(rows := np.flatnonzero(~done.all(1))):
            pick = np.argsort(done[rows], axis=1, kind="stable")[:, :AT_ONCE]  # the nearest that were not followed yet
            idle = np.take_along_axis(done[rows], pick, 1)
            done[rows[:, None], pick] = True
            nb = self.edge[np.take_along_axis(ids[rows], pick, 1)]
            nb[idle] = -1
            nb = np.sort(nb.reshape(len(rows), -1), axis=1)
            new = nb >= 0
            new[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            new &= ~np.take_along_axis(seen[rows], np.maximum(nb, 0), 1)
            i, j = np.nonzero(new)
            k = nb[i, j]
            seen[rows[i], k] = True
            dist = np.full(nb.shape, np.inf, d.dtype)
            dist[i, j] = np.maximum(norm[rows[i]] + self.norm[k] - 2 * np.einsum("ij,ij->i", x[rows[i]], self.c[k]), 0)
            all_d = np.concatenate([d[rows], dist], 1)
            all_i = np.concatenate([ids[rows], np.where(new, nb, -1)], 1)
            all_done = np.concatenate([done[rows], ~new], 1)
            o = np.argsort(all_d, axis=1, kind="stable")[:, :BEAM]
            d[rows] = np.take_along_axis(all_d, o, 1)
            ids[rows] = np.take_along_axis(all_i, o, 1)
            done[rows] = np.take_along_axis(all_done, o, 1)
        return ids, np.sqrt(d)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): each vector's nearest list and those whose boundary with it is at most ``slack`` away.

        No head that is more than twice the slack farther than the nearest one can be among them. Where the beam ends
        before that, the vector is compared with all heads.
        """
        ids, d = self.nearest(x)
        short = (d[:, -1] <= d[:, 0] + 2 * self.slack) & (len(self.c) > BEAM)
        row, lists = self._banded(np.flatnonzero(~short), ids[~short], d[~short])
        if short.any():
            d = np.sqrt(_sq(x[short], self.c))
            o = np.argsort(d, axis=1, kind="stable")
            more = self._banded(np.flatnonzero(short), o, np.take_along_axis(d, o, 1))
            row, lists = np.concatenate([row, more[0]]), np.concatenate([lists, more[1]])
        return row, lists

    def _banded(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero((d <= d[:, :1] + 2 * self.slack) & np.isfinite(d))
        gap = self.c[ids[i, j]] - self.c[ids[i, 0]]
        ok = (j == 0) | (d[i, j] ** 2 - d[i, 0] ** 2 <= 2 * self.slack * np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        return rows[i[ok]], ids[i[ok], j[ok]]


def _lists(heads: Heads, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(x), 512):
        i, lists = heads.lists(x[at : at + 512])
        yield i + at, lists


def _post(batches: Iterator[pa.RecordBatch], heads: Heads, blocks: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, vec_id, feat). A list of one block is one cell (side 0). Of a list of several blocks each two meet
    in a cell, a block being side 1 or 2 of it, or side 0 of its own."""
    base = np.r_[0, np.cumsum(blocks * blocks)[:-1]]
    for b in batches:
        x, ids = _matrix(b.column(1), dim).astype(np.float32), b.column(0).to_numpy()
        for i, lists in _lists(heads, x):
            n = blocks[lists]
            own = (mixed(ids[i].astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(i)), n)
            other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            own, at = own[row], lists[row]
            cell = base[at] + np.minimum(own, other) * blocks[at] + np.maximum(own, other)
            side = np.where(own == other, 0, np.where(own < other, 1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(side, pa.int32()), pa.array(ids[i[row]]), _as_bytes(x[i[row]])], names=["cell", "side", "vec_id", "feat"])


def _exact(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs x[i], y[j] in double precision."""
    e = np.empty(len(i))
    for c in range(0, len(i), EXACT):
        diff = x[i[c : c + EXACT]].astype(np.float64)
        diff -= y[j[c : c + EXACT]]
        e[c : c + EXACT] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return e


def _first(a: np.ndarray, b: np.ndarray, e: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of each a."""
    o = np.lexsort((b, e, a))
    a, b, e = a[o], b[o], e[o]
    ok = np.arange(len(a)) - np.searchsorted(a, a) < k
    return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(e[ok])], names=["a", "b", "dist"])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each run of equal keys."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        keys = t.column(key).to_numpy()
        edge = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for f, g in zip(edge[:-1], edge[1:], strict=True):
            if g > f:
                if held and held[-1].column(key)[0].as_py() != keys[f]:
                    yield pa.concat_tables(held)
                    held = []
                held.append(t.slice(f, g - f))
    if held:
        yield pa.concat_tables(held)


def fit_axes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, the AXES orthonormal directions of largest variance)."""
    x = x.astype(np.float64)
    mean = x.mean(0)
    x -= mean
    return mean, np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES]


def _pairs(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, k: int, limit: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of x, row of y): all pairs that can be one of the k nearest of x in y and within the limit.

    Squared distances in single precision are off by less than a part of ``off`` of both squared lengths.
    """
    off, most = np.float32(4e-5), np.float32(limit * limit * (1 + 1e-5) + 1e-6)
    ny, sy = (py * py).sum(1) * (1 - off) - most, (y * y).sum(1)
    for at in range(0, len(x), 512):
        p = px[at : at + 512]
        low = (-2 * p) @ py.T
        low += ny
        if same:
            low[np.arange(len(p)), np.arange(at, at + len(p))] = np.inf
        i, j = np.nonzero(low <= -((p * p).sum(1) * (1 - off))[:, None])
        n = np.bincount(i, minlength=len(p))
        many = np.flatnonzero(n > max(FEW, k))
        if len(many):
            # a dense group: all its pairs are within the limit, and only the k nearest are worked out
            dense = n[i] > max(FEW, k)
            cols = np.unique(j[dense])
            xq = x[at + many]
            both = (xq * xq).sum(1)[:, None] + sy[cols]
            d = both - 2 * xq @ y[cols].T
            if same:
                d[(at + many)[:, None] == cols] = np.inf
            d -= off * both
            both *= 2 * off
            both += d
            kth = np.partition(both, k - 1, axis=1)[:, k - 1] + np.float32(1e-6)
            a, b = np.nonzero(d <= np.minimum(kth, most)[:, None])
            i, j = np.concatenate([i[~dense], many[a]]), np.concatenate([j[~dense], cols[b]])
        yield i + at, j


def _parts(flat: np.ndarray, near: float, slack: float) -> list[np.ndarray]:
    """The rows of a cell: all of them together, or those of its finer lists where it is long."""
    if len(flat) <= FINE_ROWS:
        return [np.arange(len(flat))]
    heads = Heads(fit_heads(flat, len(flat) // LIST_ROWS, near), slack)
    if len(heads.c) == 1:
        return [np.arange(len(flat))]
    found = list(_lists(heads, flat))
    row, at = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    o = np.argsort(at, kind="stable")
    return np.split(row[o], np.flatnonzero(np.diff(at[o])) + 1)


def _cells(batches: Iterator[pa.RecordBatch], axes: tuple[np.ndarray, np.ndarray], dim: int, k: int, limit: float, near: float, slack: float) -> Iterator[pa.RecordBatch]:
    """The k nearest within the limit of each vector among those of the other block, or of its own in a cell of one block."""
    mean, turn = axes
    for t in _runs(batches, "cell"):
        ids = t.column("vec_id").to_numpy()
        once = np.unique(ids, return_index=True)[1]  # a repeated row counts once
        ids, side, x = ids[once], t.column("side").to_numpy()[once], _of_bytes(t.column("feat"), dim)[once]
        flat = ((x - mean) @ turn).astype(np.float32)
        for rows in _parts(flat, near, slack):
            here = [rows[side[rows] == n] for n in (0, 1, 2)]
            for f, g in ((0, 0), (1, 2), (2, 1)):
                q, s = here[f], here[g]
                if len(q) and len(s):
                    xs, fs = x[s], flat[s]
                    for i, j in _pairs(x[q], flat[q], xs, fs, min(k, len(s)), limit, f == 0):
                        e = _exact(x, q[i], xs, j)
                        ok = e <= limit
                        yield _first(ids[q[i[ok]]], ids[s[j[ok]]], e[ok], k)


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_matrix(b.column(0), dim).astype(np.float32).tobytes()], pa.binary())], names=["m"])


def _usual(x: np.ndarray, k: int) -> float:
    """The distance within which nine of ten vectors of a sample have their k-th nearest."""
    n = min(1000, len(x))
    d = np.partition(_sq(x[:n], x), min(k, len(x) - 1), axis=1)[:, min(k, len(x) - 1)]
    return float(np.sqrt(np.quantile(d, 0.9)))


def most_similar(vectors: DataFrame, k: int = 5, limit: float | None = None, dim: int = DIM, id_col: str = "vec_id", vec_col: str = "feat") -> DataFrame:
    """``(a, b, dist)``: for each vector a its k nearest others by L2 in double precision, ties by smaller id.

    With ``limit`` only neighbours at most so far away come out. Vectors that are null, of wrong length, not finite
    or all zero, and null ids, take no part; a repeated id counts once (of different vectors under one id the one of
    largest hash counts); extra columns are ignored. The search is approximate, as a neighbour is found only in a list that
    both reach; distances are exact. Without ``limit`` the band along the boundaries is as wide as for the distance within
    which nine of ten vectors of the sample have their k-th nearest in it.
    """
    spark = vectors.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("feat"))
    hashed = lambda v: v.where(F.col("vec_id").isNotNull() & usable(F.col("feat"), dim)).withColumn("copy", F.xxhash64("feat"))
    v = hashed(raw)
    # ids and hashes only; the vectors themselves are read again where they are needed
    ids = cut(v.groupBy("vec_id").agg(F.max("copy").alias("copy"), F.min("copy").alias("other")))
    low = ids.select("copy", "vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("copy").orderBy("vec_id"))).where(F.col("rank") <= k + 1)
    low = cut(low)  # the smallest ids of each set of copies; the limit of the window works before its shuffle
    many = low.where(F.col("rank") == k + 1).select("copy", F.col("vec_id").alias("last"))
    rest = ids.select("copy", "vec_id").join(many, "copy").where("vec_id > last")
    copies = rest.join(low.where(F.col("rank") <= k).select("copy", F.col("vec_id").alias("b")), "copy").select(F.col("vec_id").alias("a"), "b", F.lit(0.0).alias("dist"))
    # what is not indexed: copies beyond the first, and other vectors under the same id
    out = rest.select("vec_id", F.lit(None).cast("long").alias("copy")).union(ids.where("other <> copy").select("vec_id", "copy"))
    out = cut(out.select(F.col("vec_id").alias("o_id"), F.col("copy").alias("o_copy")))
    n_out, total = out.count(), low.count()
    if not total:
        return copies
    small = F.broadcast(out) if n_out <= BROADCAST_ROWS else out

    def indexed(v: DataFrame) -> DataFrame:
        if n_out:
            v = v.join(small, (F.col("vec_id") == F.col("o_id")) & (F.col("o_copy").isNull() | (F.col("copy") != F.col("o_copy"))), "left_anti")
        return v.select("vec_id", "feat")

    share = SAMPLE / total
    sample = indexed(v if share >= 1 else hashed(raw.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) < int(share * (1 << 32)))))
    x = np.concatenate([np.frombuffer(r["m"], np.float32).reshape(-1, dim) for r in sample.select("feat").mapInArrow(lambda it: _packed(it, dim), "m binary").collect()] or [np.zeros((1, dim), np.float32)])
    x = x[np.lexsort(x[:, :8].T)]
    axes = fit_axes(x)
    near = limit if limit is not None else _usual(x, k)
    most, slack = np.inf if limit is None else limit, SLACK * near
    heads = Heads(fit_heads(x, max(1, min(total // LIST_ROWS, len(x) // LEAF)), near), slack)
    own = np.concatenate([_sq(x[f : f + 512], heads.c).argmin(1) for f in range(0, len(x), 512)])
    # as a vector goes to about two lists
    blocks = np.maximum(1, np.ceil(2 * np.bincount(own, minlength=len(heads.c)) * (total / len(x)) / BLOCK_ROWS)).astype(np.int64)
    posted = indexed(v).mapInArrow(lambda it: _post(it, heads, blocks, dim), "cell long, side int, vec_id long, feat binary")
    found = posted.repartition(n_parts, "cell").sortWithinPartitions("cell").mapInArrow(lambda it: _cells(it, axes, dim, k, most, near, slack), "a long, b long, dist double")
    best = found.repartition(n_parts, "a").groupBy("a", "b").agg(F.min("dist").alias("dist"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))).where(F.col("r") <= k).drop("r")
    return best.union(copies)
