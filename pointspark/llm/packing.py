"""Filling containers of fixed capacity with whole texts.

Packing depends on sizes only, and sizes are whole numbers up to the capacity. The plan is therefore made on
the histogram of sizes, which has at most ``capacity`` rows whatever the number of documents, and says how
often each content (multiset of sizes) is used. Documents are then numbered within their size and look up
their place, so all of them are assigned by joins, none by the driver.

The plan follows Martello and Toth's reduction: sets that dominate all other sets with the same largest item
are fixed for good, the instance shrinks, and the rest is packed by best fit in order of decreasing size.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.session import cut

MAX_SPECS = 1000
#: Folder of public vocabulary files, and the file of byte-pair ranks used to measure texts.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Split pattern of that public vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _measure(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    import tiktoken

    with Path(SparkFiles.get(name)).open("rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for b in batches:
        n = [len(e.encode_ordinary(t.as_py() or "")) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """``(doc_id, n_tokens)`` of whole texts; null texts have 0 tokens, rows without doc_id are left out.

    The vocabulary file is read where the driver runs and sent to the executors."""
    documents.sparkSession.sparkContext.addFile(str(Path(folder, name).resolve()))
    d = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return d.mapInArrow(lambda it: _measure(it, name), "doc_id long, n_tokens long")


# ---------------------------------------------------------------- the plan


def dominance_reduction(capacity: int, count: dict[int, int]) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix sets of at most three sizes that dominate all other sets with their first size.

    ``count`` maps size to number of items. Returns the fixed contents with how often each is used, and the items
    that are left. A set dominates another if the other's items can be laid into places of its items. For an item
    s with room r = capacity - s, and p the largest other item that fits into r:
      * nothing fits beside s: s alone;
      * p fills r exactly, or no two items fit into r: {s, p};
      * no three items fit into r, and p is as large as the largest pair that fits: {s, p};
      * no three items fit into r, and one pair {a, b} holds p and every other pair item by item: {s, a, b}.
    Each condition stays true when items leave, so equal items are fixed together while all of the set last. Sizes
    are taken in decreasing order, again and again while that fixes anything.
    """
    have = {s: n for s, n in count.items() if n > 0 and 0 < s <= capacity}
    sizes = sorted(have)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def largest(limit: int, taken: tuple[int, ...]) -> int | None:
        """The largest size up to the limit of which an item is left besides those taken."""
        k = bisect.bisect_right(sizes, limit) - 1
        while k >= 0 and have[sizes[k]] <= taken.count(sizes[k]):
            k -= 1
        return sizes[k] if k >= 0 else None

    def smallest(n: int, taken: int) -> int | None:
        """Sum of the n smallest items besides one of size ``taken``; None if there are fewer."""
        total = 0
        for x in sizes:
            m = min(n, have[x] - (x == taken))
            total, n = total + m * x, n - m
            if not n:
                return total
        return None

    def dominant(s: int) -> tuple[int, ...] | None:
        r = capacity - s
        p = largest(r, (s,))
        if p is None:
            return (s,)
        two, three = smallest(2, s), smallest(3, s)
        if p == r or two is None or two > r:
            return (s, p)
        if three is not None and three <= r:
            return None
        pairs = []
        for x in sizes[: bisect.bisect_right(sizes, r)]:
            if have[x] > (x == s) and (y := largest(min(x, r - x), (s, x))) is not None:
                pairs.append((x, y))
        a, b = max(pairs, key=lambda q: (q[0] + q[1], q[0]))
        if p >= a + b:
            return (s, p)
        if p <= a and all(x <= a and y <= b for x, y in pairs):
            return (s, a, b)
        return None

    before = -1
    while before != len(fixed):
        before = len(fixed)
        for s in sorted(have, reverse=True):
            while s in have and (found := dominant(s)) is not None:
                times = min(have[x] // found.count(x) for x in found)
                fixed.append((found, times))
                for x in set(found):
                    have[x] -= found.count(x) * times
                    if not have[x]:
                        del have[x]
                        sizes.remove(x)
    return fixed, have


def best_fit(capacity: int, count: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in order of decreasing size, equal containers and equal items handled together.

    An item goes to the container with the least room that still holds it; as that container stays the best for
    the next equal item, it takes as many as fit. At most two groups of containers arise for each step.
    """
    room: list[int] = []  # rooms with containers, ascending
    groups: dict[int, list[tuple]] = {}

    def put(r: int, content: tuple, n: int) -> None:
        if n:
            if r not in groups:
                groups[r] = []
                bisect.insort(room, r)
            groups[r].append((content, n))

    for s in sorted(count, reverse=True):
        n = count[s]
        while n:
            at = bisect.bisect_left(room, s)
            if at == len(room):
                k = capacity // s
                full, rest = divmod(n, k)
                put(capacity - k * s, ((s, k),), full)
                if rest:
                    put(capacity - rest * s, ((s, rest),), 1)
                break
            r = room[at]
            content, m = groups[r].pop()
            if not groups[r]:
                del groups[r]
                room.pop(at)
            k = r // s
            full, rest = divmod(n, k)
            if full >= m:
                put(r - k * s, (*content, (s, k)), m)
                n -= m * k
            else:
                put(r - k * s, (*content, (s, k)), full)
                put(r - rest * s, (*content, (s, rest)) if rest else content, 1)
                put(r, content, m - full - 1)
                n = 0
    out = []
    for gs in groups.values():
        for content, n in gs:
            out.append((tuple(x for x, k in content for _ in range(k)), n))
    return out


def plan(capacity: int, count: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """Contents of containers and how often each is used, for sizes from 1 to the capacity."""
    fixed, rest = dominance_reduction(capacity, count)
    return fixed + best_fit(capacity, rest)


def _slots(capacity: int, hist: pd.DataFrame) -> pd.DataFrame:
    """For each size the runs of its items' numbers: item ``first + j * per + i`` goes to container ``base + j``."""
    contents = plan(capacity, dict(zip(hist["size"].tolist(), hist["n"].tolist(), strict=True)))
    rows, used, base = [], {}, 0
    for content, times in contents:
        per: dict[int, int] = {}
        for s in content:
            per[s] = per.get(s, 0) + 1
        for s, k in per.items():
            first = used.get(s, 0)
            rows.append((s, first, first + k * times, k, base))
            used[s] = first + k * times
        base += times
    return pd.DataFrame(rows, columns=["size", "first", "until", "per", "base"])


def _specs(specs: DataFrame) -> list[tuple[int, int]]:
    """(spec_id, capacity) of usable specs; they are part of the plan, so their number is bounded."""
    w = specs.where(F.col("spec_id").isNotNull() & (F.col("capacity_tokens") > 0)).groupBy("spec_id").agg(F.max("capacity_tokens").alias("c"))
    rows = w.limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    return sorted((int(r["spec_id"]), int(r["c"])) for r in rows)


def _for_each_spec(df: DataFrame, specs: list[tuple[int, int]]) -> DataFrame:
    each = [F.struct(F.lit(i).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for i, c in specs]
    each = F.array(*each) if each else F.array().cast("array<struct<spec_id:int,capacity:bigint>>")
    return df.withColumn("_s", F.explode(each)).select("_s.*", *df.columns)


def pack(documents: DataFrame, specs: DataFrame, folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """``(spec_id, doc_id, piece, start, n_tokens, container_id)`` for every document and capacity.

    Texts are measured in tokens of a public tokenizer. Only a text longer than the capacity is split: into full
    containers of its own and one last piece that is packed like a text. ``start`` is the piece's first token.
    A text without tokens needs no room and goes to container 0. Specs without a positive capacity are left out, of
    a repeated spec_id the largest capacity holds; documents without doc_id are left out; copies are packed each.
    """
    spark = documents.sparkSession
    counted = cut(token_counts(documents, folder, name))
    sizes = counted.groupBy("n_tokens").agg(F.count("*").alias("n"))
    wanted = _specs(specs)
    # a piece of one size for each document and spec: the remainder of long texts, whole short ones
    size = F.when(F.col("n_tokens") <= F.col("capacity"), F.col("n_tokens")).otherwise(F.col("n_tokens") % F.col("capacity"))
    hist = _for_each_spec(sizes, wanted).select("spec_id", "capacity", size.alias("size"), "n").where("size > 0").groupBy("spec_id", "capacity", "size").agg(F.sum("n").alias("n"))
    slots = cut(
        hist.groupBy("spec_id").applyInPandas(
            lambda g: _slots(int(g["capacity"].iloc[0]), g).assign(spec_id=g["spec_id"].iloc[0])[["spec_id", "size", "first", "until", "per", "base"]],
            "spec_id int, size long, first long, until long, per long, base long",
        )
    )
    # number the documents of each size, hot sizes too: ranks within parts, then the parts' offsets
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    d = _for_each_spec(counted, wanted).select("spec_id", "capacity", "doc_id", "n_tokens", size.alias("size"))
    d = d.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    per_part = d.groupBy("spec_id", "size", "part").count()
    before = Window.partitionBy("spec_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_part.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("spec_id", "size", "part").orderBy("doc_id")) - 1
    d = d.withColumn("rank", rank).join(offset, ["spec_id", "size", "part"]).withColumn("no", F.col("rank") + F.col("before"))
    placed = d.where("size > 0").join(slots, ["spec_id", "size"]).where("no >= first AND no < until")
    long_ = F.floor(F.col("n_tokens") / F.col("capacity"))
    last = F.when(F.col("n_tokens") <= F.col("capacity"), F.lit(0)).otherwise(long_)
    packed = placed.select(
        "spec_id", "doc_id", last.cast("int").alias("piece"), (F.col("n_tokens") - F.col("size")).alias("start"), F.col("size").alias("n_tokens"),
        (F.col("base") + F.floor((F.col("no") - F.col("first")) / F.col("per"))).alias("container_id"),
    )
    empty = d.where("size = 0 AND n_tokens = 0").select("spec_id", "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "n_tokens", F.lit(0).cast("long").alias("container_id"))
    # full pieces of long texts, each a container of its own with a negative number made of its document's number among the long ones
    over = d.where(F.col("n_tokens") > F.col("capacity")).select("spec_id", "capacity", "doc_id", "part", long_.cast("long").alias("full"))
    in_part = Window.partitionBy("spec_id", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = over.groupBy("spec_id", "part").agg(F.sum("full").alias("full"))
    ahead = ahead.select("spec_id", "part", F.coalesce(F.sum("full").over(Window.partitionBy("spec_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    over = over.withColumn("mine", F.coalesce(F.sum("full").over(in_part), F.lit(0))).join(ahead, ["spec_id", "part"])
    full = over.select("spec_id", "capacity", "doc_id", (F.col("mine") + F.col("ahead")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    full = full.select(
        "spec_id", "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("n_tokens"),
        (-1 - F.col("first") - F.col("piece")).alias("container_id"),
    )
    return packed.unionByName(empty).unionByName(full)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """One row a spec: ``(spec_id, capacity, containers, pieces, tokens, least, unused_share)``; ``least`` is the
    smallest number of containers that any packing needs for so many tokens."""
    wanted = specs.where(F.col("spec_id").isNotNull() & (F.col("capacity_tokens") > 0)).groupBy("spec_id").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    used = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"))
    r = used.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens")).join(wanted, "spec_id")
    return r.select("spec_id", "capacity", "containers", "pieces", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))
