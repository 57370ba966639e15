"""Markov clustering of records that lie together.

A similarity graph links two records of a cloud that are at most ``radius`` apart and whose labels do not differ. Two steps
follow each other:

* Markov clustering: the link matrix is squared, inflated and pruned in turn, from the first matrix on, until it no longer
  changes. Rows that keep flow are the attractors; each column belongs to its attractor, and what a row receives in the end
  says how typical a member is.
* The closure: clusters that still have a link between them are contracted to one node each and clustered again, until no
  link is left. The groups are then exactly the linked ones, whatever the inflation cut on the way.

The matrix is distributed twice over:

* Space is cut into tiles, so the link matrix is block diagonal but for links across tile faces. A block is squared where it
  lies, in vectorised sparse form (``sparse_mcl``). No task holds more than the blocks of one batch; a large cloud has many
  blocks.
* Links across faces form a matrix of clusters, much smaller than that of records. It stays a DataFrame
  ``(col, row, v)``: squaring is a join on the inner index and a sum, inflation a power with a sum per column, pruning a
  top-k per column (``distributed_mcl``). Its closure is that of connected components.

Nodes of the first matrix are cliques: the records of one label within a cell whose diagonal is no longer than ``radius``. As
all of them are mutually similar, that contraction loses nothing and keeps the matrix small where records are dense, also for
any number of repeated records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.llm.points import measured
from pointspark.operators.components import components
from pointspark.session import cut, drop_cut

RADIUS = 0.5
MIN_SIZE = 10
#: Edge of a tile in metres. A tile is one block of the link matrix.
TILE = 64.0
#: A tile with more records is divided into so many parts along each axis.
BLOCK_ROWS, FINE = 1_000_000, 16
INFLATION = 2.0
#: Entries of a column smaller than PRUNE go, and of the others all but the STRONGEST ones.
PRUNE, STRONGEST = 2e-2, 8
ROUNDS = 12
#: Products of a squaring that are held at a time.
PRODUCTS = 4_000_000
#: Blocks are handed to numpy together until they have so many records.
BATCH_ROWS = 60_000
NO_LABEL = -(2**31)

_BLOCK_SCHEMA = "kind int, head long, idx long, flow double, attracted double, size long"


# ---------------------------------------------------------------- sparse matrices in numpy


def _sum_by(key: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(key)
    k, s = key[o], v[o]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], (np.add.reduceat(s, at) if len(at) else s)


def _roots(parent: np.ndarray) -> np.ndarray:
    """Follow pointers to their end; a cycle ends in its smallest member."""
    low = parent
    for _ in range(2 * max(1, int(len(parent)).bit_length())):
        low = np.minimum(low, low[parent])
        parent = parent[parent]
    return low[parent]


def _contract(parent: np.ndarray) -> tuple[np.ndarray, int]:
    u, inv = np.unique(_roots(parent), return_inverse=True)
    return inv, len(u)


def _columns(key: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Prune the columns of a matrix given by sorted keys column * n + row, and bring them to sum 1."""
    j = key // n
    start = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
    many = np.diff(np.r_[start, len(j)])
    v = v / np.repeat(np.add.reduceat(v, start), many)
    keep = v >= np.repeat(np.minimum(PRUNE, np.maximum.reduceat(v, start)), many)
    key, v, j = key[keep], v[keep], j[keep]
    start = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
    many = np.diff(np.r_[start, len(j)])
    if many.max() > STRONGEST:
        long = np.flatnonzero(np.repeat(many > STRONGEST, many))
        o = long[np.lexsort((-v[long], j[long]))]
        n_long = many[many > STRONGEST]
        keep = np.ones(len(v), bool)
        keep[o[np.arange(len(o)) - np.repeat(np.cumsum(n_long) - n_long, n_long) >= STRONGEST]] = False
        key, v, j = key[keep], v[keep], j[keep]
        start = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
        many = np.diff(np.r_[start, len(j)])
    return key, v / np.repeat(np.add.reduceat(v, start), many)


def sparse_mcl(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, mass: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Markov clustering of a link matrix (links each given once): the attractor of each node, and what flows into each node
    in the end if each sends out its mass.

    Squaring, inflation and pruning alternate until nothing changes. A column that has one entry left, in a row whose own
    column has only that entry, stays as it is and is not squared again.
    """
    mass = np.ones(n) if mass is None else mass
    if not len(a):
        return np.arange(n), mass.astype(float)
    loop = np.zeros(n)
    np.maximum.at(loop, a, w)
    np.maximum.at(loop, b, w)
    loop[loop == 0] = 1
    i, j, v = np.r_[a, b, np.arange(n)], np.r_[b, a, np.arange(n)], np.r_[w, w, loop]
    key, v = _columns(*_sum_by(j * n + i, v), n)
    for _ in range(ROUNDS):
        j, i = key // n, key % n
        start = np.searchsorted(j, np.arange(n + 1))
        only = np.where(np.diff(start) == 1, i[start[:-1]], -1)
        end = (only >= 0) & (only[only] == only)
        open_ = ~end[j]
        if not open_.any():
            break
        k, m, u = j[open_], i[open_], v[open_]
        many = start[m + 1] - start[m]  # entry (m, k) meets each entry of column m
        ahead = np.cumsum(many)
        cuts = [0]
        while cuts[-1] < len(k):  # whole columns at a time
            at = int(np.searchsorted(ahead, (ahead[cuts[-1] - 1] if cuts[-1] else 0) + PRODUCTS, "right"))
            at = len(k) if at >= len(k) else int(np.searchsorted(k, k[at]))
            cuts.append(at if at > cuts[-1] else int(np.searchsorted(k, k[cuts[-1]], "right")))
        keys, values = [key[~open_]], [v[~open_]]
        for f, g in zip(cuts[:-1], cuts[1:], strict=True):
            c = many[f:g]
            src = np.repeat(start[m[f:g]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            key2, v2 = _sum_by(np.repeat(k[f:g], c) * n + i[src], np.repeat(u[f:g], c) * v[src])
            key2, v2 = _columns(key2, v2**INFLATION, n)
            keys.append(key2)
            values.append(v2)
        new, v2 = np.concatenate(keys), np.concatenate(values)
        o = np.argsort(new)
        new, v2 = new[o], v2[o]
        if len(new) == len(key) and np.array_equal(new, key) and np.allclose(v2, v, atol=1e-4):
            key, v = new, v2
            break
        key, v = new, v2
    j, i = key // n, key % n
    o = np.lexsort((i, -v, j))
    first = np.flatnonzero(np.r_[True, j[o][1:] != j[o][:-1]])
    out = np.arange(n)
    out[j[o][first]] = i[o][first]
    return out, np.bincount(i, v * mass[j], n)


def _strongest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Each node's neighbour by the strongest link, ties by the smaller number; itself where it has none."""
    i, j, v = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    o = np.lexsort((j, -v, i))
    first = np.flatnonzero(np.r_[True, i[o][1:] != i[o][:-1]]) if len(o) else o
    out = np.arange(n)
    out[i[o][first]] = j[o][first]
    return out


def multilevel_mcl(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, mass: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(group, what flows into each node): Markov clustering of the matrix as it is, then the closure.

    The closure contracts clusters that still have a link and clusters them again until no link is left between groups. A
    level of it that joins nothing is followed by joining each cluster to its strongest neighbour, so that it ends.
    """
    to, flow = sparse_mcl(n, a, b, w, mass)
    label, m = _contract(to)
    a, b = label[a], label[b]
    while True:
        between = a != b
        a, b, w = a[between], b[between], w[between]
        if not len(a):
            return label, flow
        key, w = _sum_by(np.minimum(a, b) * m + np.maximum(a, b), w)
        a, b = key // m, key % m
        step, left = _contract(sparse_mcl(m, a, b, w)[0])
        if left == m:
            step, left = _contract(_strongest(m, a, b, w))
        label, m = step[label], left
        a, b = step[a], step[b]


# ---------------------------------------------------------------- the similarity graph of blocks


def _offsets(cell: float, radius: float) -> list[tuple[int, int, int]]:
    """Cells that may hold a record within the radius; one of each two opposite ones."""
    k = int(np.ceil(radius / cell))
    r, out = range(-k, k + 1), []
    for d in ((x, y, z) for x in r for y in r for z in r):
        gap = sum((max(0, abs(c) - 1) * cell) ** 2 for c in d)
        if d >= (0, 0, 0) and gap <= radius * radius:
            out.append(d)
    return sorted(out, key=lambda d: sum(c * c for c in d))


def _clique_links(block, xyz, label, radius):
    """Cliques of records, and which of them hold two similar records. Returns (clique of record, a, b, weight)."""
    cell = radius / np.sqrt(3) * (1 - 1e-9)
    v = np.floor(xyz / cell).astype(np.int64)
    _, blk = np.unique(block, return_inverse=True)
    # cells are numbered in sorted order of (block, x, y, z), two empty ones kept free at each end of an axis
    low, high = v.min(0) - 3, v.max(0) + 4
    span = high - low
    if float(blk.max() + 1) * float(span[0]) * float(span[1]) * float(span[2]) < 2**62:
        cid = ((blk * span[0] + v[:, 0] - low[0]) * span[1] + v[:, 1] - low[1]) * span[2] + v[:, 2] - low[2]
        step = lambda d: (d[0] * span[1] + d[1]) * span[2] + d[2]
        cells, cell_of = np.unique(cid, return_inverse=True)
        find = lambda d: _find(cells, cells + step(d))
    else:  # far outliers: number each axis by rank with gaps kept up to three cells
        ranks = []
        for k in range(3):
            u, inv = np.unique(v[:, k], return_inverse=True)
            ranks.append(np.cumsum(np.r_[3, np.minimum(np.diff(u), 4)])[inv])
        v = np.stack(ranks, 1)
        order = np.lexsort((v[:, 2], v[:, 1], v[:, 0], blk))
        rows = np.stack([blk, v[:, 0], v[:, 1], v[:, 2]], 1)
        uniq, cell_of = np.unique(rows, axis=0, return_inverse=True)
        cell_of = cell_of.ravel()
        del order
        as_key = lambda r: np.ascontiguousarray(r).view([("", np.int64)] * 4).ravel()
        cells = as_key(uniq)
        find = lambda d: _find(cells, as_key(uniq + np.array([0, *d])))
    # cliques: sorted by cell, then label
    order = np.lexsort((label, cell_of))
    co, lo = cell_of[order], label[order]
    new = np.r_[True, (co[1:] != co[:-1]) | (lo[1:] != lo[:-1])]
    clique = np.empty(len(order), np.int64)
    clique[order] = np.cumsum(new) - 1
    c_start = np.flatnonzero(new)
    c_n = np.diff(np.r_[c_start, len(order)])
    c_cell, c_label = co[c_start], lo[c_start]
    p = xyz[order]
    lo_box, hi_box = np.minimum.reduceat(p, c_start), np.maximum.reduceat(p, c_start)
    cell_first = np.searchsorted(c_cell, np.arange(len(cells) + 1))
    cell_n = np.diff(cell_first)
    r2 = radius * radius
    out_a, out_b, out_w = [], [], []
    for d in _offsets(cell, radius):
        here, there = find(d) if d != (0, 0, 0) else (np.arange(len(cells)), np.arange(len(cells)))
        n = cell_n[here] * cell_n[there]
        rep = np.repeat(np.arange(len(here)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = cell_first[here][rep] + pos // cell_n[there][rep]
        b = cell_first[there][rep] + pos % cell_n[there][rep]
        la, lb = c_label[a], c_label[b]
        ok = (la == lb) | (la == NO_LABEL) | (lb == NO_LABEL)
        if d == (0, 0, 0):
            ok &= a < b
        a, b = a[ok], b[ok]
        if d == (0, 0, 0):
            near = np.ones(len(a), bool)
        else:  # bounding boxes decide most pairs of cliques, pairs of records the rest
            gap = np.maximum(0, np.maximum(lo_box[a] - hi_box[b], lo_box[b] - hi_box[a]))
            far = np.maximum(hi_box[a] - lo_box[b], hi_box[b] - lo_box[a])
            may = (gap * gap).sum(1) <= r2
            a, b, far = a[may], b[may], far[may]
            near = (far * far).sum(1) <= r2 * (1 - 1e-12)
            open_ = np.flatnonzero(~near)
            for at in np.array_split(open_, max(1, int((c_n[a[open_]] * c_n[b[open_]]).sum() // 2_000_000) + 1)):
                near[at] = _near(p, c_start, c_n, a[at], b[at], r2)
        a, b = a[near], b[near]
        centre = np.abs((lo_box[a] + hi_box[a] - lo_box[b] - hi_box[b]) / 2)
        out_a.append(a)
        out_b.append(b)
        out_w.append(np.sqrt(c_n[a] * c_n[b]) * np.exp(-2 * (centre * centre).sum(1) / r2))
    return clique, c_n, np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_w)


def _find(cells, want):
    at = np.searchsorted(cells, want)
    at[at == len(cells)] = 0
    hit = cells[at] == want
    return np.flatnonzero(hit), at[hit]


def _near(p, start, n, a, b, r2):
    """For pairs of cliques: whether any record of a is within the radius of any of b."""
    many = n[a] * n[b]
    rep = np.repeat(np.arange(len(a)), many)
    pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    nb = n[b][rep]
    d = p[start[a][rep] + pos // nb] - p[start[b][rep] + pos % nb]
    hit = np.zeros(len(a), bool)
    hit[rep[(d * d).sum(1) <= r2]] = True
    return hit


def _blocks(batches: Iterator[pa.RecordBatch], radius: float, min_size: int) -> Iterator[pa.RecordBatch]:
    """Cluster whole blocks, as many at a time as make a batch.

    Rows out: kind 0, a member of a final cluster of ``min_size`` or more; kind 1, a record of a cluster
    that reaches into another block; kind 2, the same for a record that another block owns.
    """
    held: list[pa.Table] = []
    rows = 0

    def run(t: pa.Table):
        col = {c: t.column(c).to_numpy() for c in ("block", "idx", "x", "y", "z", "label", "owned", "shared")}
        o = np.lexsort((col["idx"], col["block"]))
        b, i = col["block"][o], col["idx"][o]
        o = o[np.r_[True, (b[1:] != b[:-1]) | (i[1:] != i[:-1])]]  # a repeated record counts once
        col = {c: x[o] for c, x in col.items()}
        xyz = np.stack([col["x"], col["y"], col["z"]], 1)
        clique, c_n, a, b, w = _clique_links(col["block"], xyz, col["label"].astype(np.int64), radius)
        flow = (c_n + np.bincount(np.r_[a, b], np.r_[w, w], len(c_n))).astype(float)  # what a node's row receives at first
        cluster, attracted = multilevel_mcl(len(c_n), a, b, w, c_n)
        cluster = cluster[clique]
        n = cluster.max() + 1
        head = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(head, cluster, col["idx"])
        size = np.bincount(cluster, col["owned"], n).astype(np.int64)
        reach = np.bincount(cluster, col["shared"], n) > 0
        own = col["owned"].astype(bool)
        kind = np.where(reach[cluster], np.where(own, 1, 2), 0)
        keep = (kind > 0) | (own & (size[cluster] >= min_size))
        c = cluster[keep]
        return pa.RecordBatch.from_arrays(
            [pa.array(kind[keep].astype(np.int32)), pa.array(head[c]), pa.array(col["idx"][keep]), pa.array(flow[clique][keep]), pa.array(attracted[clique][keep]), pa.array(size[c])],
            names=["kind", "head", "idx", "flow", "attracted", "size"],
        )

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held.append(t)
        rows += len(t)
        if rows >= BATCH_ROWS:
            t = pa.concat_tables(held)
            block = t.column("block").to_numpy()
            last = int(np.searchsorted(block, block[-1]))  # blocks come in order; the last may go on
            if last >= BATCH_ROWS // 2:
                yield run(t.slice(0, last))
                t = t.slice(last)
            held, rows = [t], len(t)
    if rows:
        yield run(pa.concat_tables(held))


def _sides(tile: float, radius: float, origin: float) -> list[tuple]:
    """For each axis the tile of a record, and those of the places ``radius`` below and above it."""
    out = []
    for c in "xyz":
        s = (F.col(c) + origin) / tile
        out.append((F.floor(s), F.floor(s - radius / tile), F.floor(s + radius / tile)))
    return out


def _tiled(points: DataFrame, tile: float, radius: float, block_rows: int) -> DataFrame:
    """Records by block; those near a face go to the neighbouring block too.

    Near is the radius and twice the edge of a clique's cell: a clique that a face divides and the cliques linked to it are
    then whole in each block that owns a part of it, and flows do not depend on the tiles.

    Tiles with more than ``block_rows`` records are divided into ``FINE`` parts along each axis, so that no block holds
    more than a dense spot of a hot cloud. They are found by counting, partial counts first.
    """
    p = measured(points, "label").withColumn(
        "label", F.when(F.col("label").isNull() | (F.col("label") == -1), NO_LABEL).otherwise(F.col("label")).cast("int")
    )
    own = [a[0] for a in _sides(tile, radius, tile / 2)]
    hot = cut(p.groupBy(F.xxhash64("cloud_id", *own).alias("block")).count().where(F.col("count") > block_rows).select("block", F.lit(True).alias("hot")))
    divided = not hot.isEmpty()
    axes = _sides(tile / FINE if divided else tile, radius * (1 + 2 / 3**0.5), tile / 2)
    inner = F.lit(True)
    for at, low, high in axes:
        inner = inner & (low == at) & (high == at)
    one = F.array(F.struct(*(at.alias(c) for c, (at, _, _) in zip("abc", axes, strict=True))))
    sides = [F.sequence(low, high) for _, low, high in axes]
    many = F.flatten(
        F.transform(sides[0], lambda a: F.flatten(F.transform(sides[1], lambda b: F.transform(sides[2], lambda c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))))))
    )
    p = p.withColumn("shared", (~inner).cast("int")).withColumn("t", F.explode(F.when(inner, one).otherwise(many)))
    same = F.lit(True)
    for c, (at, _, _) in zip("abc", axes, strict=True):
        same = same & (F.col(f"t.{c}") == at)
    if not divided:
        return p.select(F.xxhash64("cloud_id", "t.a", "t.b", "t.c").alias("block"), "idx", "x", "y", "z", "label", same.cast("int").alias("owned"), "shared")
    coarse = [F.floor(F.col(f"t.{c}") / FINE) for c in "abc"]
    inside = F.lit(True)
    for k, at in zip(coarse, own, strict=True):
        inside = inside & (k == at)
    p = p.withColumn("block", F.xxhash64("cloud_id", *coarse)).join(hot, "block", "left")
    fine = F.xxhash64("block", "t.a", "t.b", "t.c")
    return p.select(F.when(F.col("hot"), fine).otherwise(F.col("block")).alias("block"), "idx", "x", "y", "z", "label", F.when(F.col("hot"), same).otherwise(inside).cast("int").alias("owned"), "shared")


# ---------------------------------------------------------------- the matrix of links across blocks


def distributed_mcl(links: DataFrame, rounds: int = 3) -> DataFrame:
    """One level of Markov clustering of a link matrix that is a DataFrame ``(a, b, w)``, each link once.

    Of a column the STRONGEST entries stay, found by a window whose limit works before its shuffle.
    Returns ``(node, root)``: the attractor of each node, its own number where no row is stronger.
    """
    sides = links.select("a", "b", "w").union(links.select("b", "a", "w"))
    m = sides.union(sides.groupBy("a").agg(F.max("w").alias("w")).select("a", F.col("a").alias("b"), "w"))
    m = m.toDF("col", "row", "v")
    # a hub links to many, but has few entries in its column: as many products as entries times STRONGEST at most
    rank = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("v"), "row"))
    m = m.withColumn("r", rank).where(F.col("r") <= STRONGEST).select("col", "row", "v")
    for k in range(rounds):
        old = m
        total = m.groupBy("col").agg(F.sum("v").alias("total"))
        m = m.join(total, "col").select("col", "row", (F.col("v") / F.col("total")).alias("v"))
        left = m.select("col", F.col("row").alias("k"), F.col("v").alias("v1"))
        right = m.select(F.col("col").alias("k"), "row", F.col("v").alias("v2"))
        squared = left.join(right, "k").groupBy("col", "row").agg(F.sum(F.col("v1") * F.col("v2")).alias("v"))
        inflated = squared.withColumn("v", F.pow("v", F.lit(INFLATION)))
        rank = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("v"), "row"))
        m = cut(inflated.withColumn("r", rank).where(F.col("r") <= STRONGEST).select("col", "row", "v"))
        if k:
            drop_cut(old)
    return m.groupBy(F.col("col").alias("node")).agg(F.max_by("row", F.struct("v", -F.col("row"))).alias("root"))


def _stitched(links: DataFrame) -> DataFrame:
    """Final group of each node of the cross-block matrix, ``(node, final)``: one level of Markov clustering, then the
    closure of what is linked still. The final number is the smallest node's."""
    root = cut(distributed_mcl(links))
    a, b = root.toDF("a", "ra"), root.toDF("b", "rb")
    left = links.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    return components(left.union(root.select(F.col("node").alias("a"), F.col("root").alias("b")))).toDF("node", "final")


def clusters(points: DataFrame, radius: float = RADIUS, min_size: int = MIN_SIZE, tile: float = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Members of all groups of at least ``min_size`` records: ``(head_idx, idx, flow, attracted)``.

    ``head_idx`` is the smallest idx of the group. ``attracted`` is what the record's row of the converged matrix receives
    if every record sends out 1: large for attractors, 0 for records that keep no flow. ``flow`` is the same of the first
    matrix (the weighted degree). A matrix ends at the rim of its block, so near the faces of tiles ``attracted`` follows
    the tiles; groups and ``flow`` do not. Records without idx, cloud or measured position take no part;
    a missing label or -1 differs from none; repeated records count once; an empty table gives no rows;
    further columns are ignored.
    """
    if tile < 2 * FINE * radius:
        raise ValueError(f"a tile must be at least {2 * FINE} radii wide")
    tiled = _tiled(points, tile, radius, block_rows)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = tiled.repartition(n, "block").sortWithinPartitions("block")
    out = cut(part.mapInArrow(lambda it: _blocks(it, radius, min_size), _BLOCK_SCHEMA))
    inner = out.where("kind = 0").select("head", "idx", "flow", "attracted")
    edge = out.where("kind > 0")
    # the same record in several blocks links its clusters there
    links = (
        edge.groupBy("idx").agg(F.collect_set("head").alias("heads")).where(F.size("heads") > 1)
        .select(F.array_min("heads").alias("a"), F.explode("heads").alias("b")).where("a <> b")
        .groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    )
    links = cut(links)
    members = edge.where("kind = 1").select("head", "idx", "flow", "attracted")
    if not links.isEmpty():
        final = _stitched(links)
        members = members.join(final.withColumnRenamed("node", "head"), "head", "left").select(F.coalesce("final", "head").alias("head"), "idx", "flow", "attracted")
    sizes = members.groupBy("head").agg(F.count("*").alias("n"), F.min("idx").alias("low")).where(F.col("n") >= min_size)
    crossing = members.join(sizes, "head").select(F.col("low").alias("head"), "idx", "flow", "attracted")
    return inner.union(crossing).select(F.col("head").alias("head_idx"), "idx", "flow", "attracted")


def described(points: DataFrame, typical: int = 3, **options) -> DataFrame:
    """One row a group: ``(head_idx, size, typical)``, the most typical members being those of strongest flow:
    of the converged matrix, then of the first, ties by the smaller idx. The members are gathered by a bounded top-k before they are shuffled."""
    m = clusters(points, **options)
    size = m.groupBy("head_idx").agg(F.count("*").alias("size"))
    best = m.select("head_idx", F.struct((-F.round("attracted", 6)).alias("a"), (-F.round("flow", 9)).alias("f"), "idx").alias("s"))
    top = None
    for k in range(typical):  # k-th strongest by repeated arg-min: no group is ever gathered
        left = best if top is None else best.join(top.select("head_idx", "at"), "head_idx").where("s > at").drop("at")
        this = cut(left.groupBy("head_idx").agg(F.min("s").alias("at")).withColumn("k", F.lit(k)))
        top, kept = this, this if k == 0 else kept.union(this)  # noqa: F821
    names = kept.groupBy("head_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "at.idx"))), lambda s: s["idx"]).alias("typical"))
    return size.join(names, "head_idx").select("head_idx", "size", "typical")
