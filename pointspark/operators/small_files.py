"""Far too many small files: pack them into indexed archive containers.

The bytes of each file are laid into a large block; an index keeps for each file its path, container, offset,
length and checksum, so a file is found and read again byte by byte, and blocks are read in parallel. The index
also says which files have the same points. Of files that lead to the same path, one whose
points are those of another, or the beginning of them, is not stored again but points to the other. Equal points do
not mean equal bytes (further columns, spelling of numbers, line ends), so where its bytes are not the beginning of the
other's, a patch against the other's bytes is stored too: every file of the input comes back byte by byte.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions.linalg import let
from pointspark.operators.neighbors import runs
from pointspark.session import BROADCAST_ROWS, cut, drop_cut, shared_dir

#: Bytes a container should have. The number of containers follows from the total.
BLOCK_BYTES = 32 << 20
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def canonical_path(path: Column) -> Column:
    """The file a path leads to: scheme, escapes, backslashes, repeated slashes, ``.`` and ``..`` resolved."""
    p = F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"^[fF][iI][lL][eE]:(?://(?:localhost(?=/))?)?", "")
    p = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    p = F.replace(p, F.lit("\\"), F.lit("/"))
    parts = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)),
    )
    return F.concat(F.when(F.startswith(p, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def points_of(text: Column) -> Column:
    """The points of a file: the first three numbers of each line to six decimals; lines without numbers skipped."""
    numbers = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"),
        lambda s: F.slice(F.regexp_extract_all(s, F.lit(f"({_NUMBER})"), F.lit(1)), 1, 3),
    )
    as_text = lambda a: F.array_join(F.transform(a, lambda x: (F.round(x.cast("double"), 6) + 0.0).cast("string")), ",")
    return F.transform(F.filter(numbers, lambda a: F.size(a) > 0), as_text)


def _digest(points: Column) -> Column:
    return F.xxhash64(F.size(points), F.array_join(points, "\n"))


def _texts(files: DataFrame) -> DataFrame:
    f = files.where("file_id IS NOT NULL AND save_path IS NOT NULL")
    return f.select(F.col("file_id").cast("long").alias("file_id"), F.col("save_path"), F.coalesce("file_text", F.lit("")).alias("file_text"))


def _facts(files: DataFrame) -> DataFrame:
    """One row a file without its text: lengths, checksum, a hash of the bytes and a digest of the points."""
    data = F.encode("file_text", "UTF-8")
    points = let(points_of(F.col("file_text")), lambda p: F.struct(F.size(p).alias("n_points"), _digest(p).alias("digest")))
    f = _texts(files).select("file_id", "save_path", F.octet_length(data).cast("long").alias("length"), F.xxhash64("file_text").alias("key"), F.crc32(data).alias("checksum"), points.alias("p"))
    f = f.groupBy("file_id").agg(F.max(F.struct("length", "key", "checksum", "save_path", "p")).alias("f"))  # a repeated row counts once
    return f.select("file_id", "f.length", "f.key", "f.checksum", "f.save_path", canonical_path(F.col("f.save_path")).alias("path"), "f.p.n_points", "f.p.digest")


def _if_small(df: DataFrame) -> DataFrame:
    """Sent to all tasks if it has few rows, which are counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _index_of(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with their class of equal content and its keeper, and which classes begin which.

    Classes are (path, points); a class that begins another class of its path is kept in the longest such. Both are
    equi-joins on hashes of (path, number of points, points up to there), so no two files are ever paired to be compared.
    Points are worked out again only for one file of each class of a path that has classes of several lengths.
    """
    with_points = facts.where("n_points > 0")
    classes = cut(with_points.groupBy("path", "n_points", "digest").agg(F.min("file_id").alias("class_id")))
    several = classes.groupBy("path").agg(F.collect_set("n_points").alias("lengths")).where(F.size("lengths") > 1)
    longer = cut(facts.select("file_id", "key").join(classes, F.col("file_id") == F.col("class_id")).join(several, "path").select("file_id", "key", "path", "n_points", "lengths"))
    again = _texts(files).withColumn("key", F.xxhash64("file_text")).join(_if_small(longer), ["file_id", "key"]).dropDuplicates(["file_id"])
    again = again.select(F.col("file_id").alias("long_id"), "path", F.col("n_points").alias("long_n"), points_of(F.col("file_text")).alias("points"), F.explode(F.filter("lengths", lambda n: n < F.col("n_points"))).alias("n_points"))
    starts = again.select("long_id", "long_n", "path", "n_points", _digest(F.expr("slice(points, 1, n_points)")).alias("digest"))
    begins = cut(classes.join(starts, ["path", "n_points", "digest"]).select("class_id", "long_id", "long_n"))
    keeper = begins.groupBy("class_id").agg(F.max_by("long_id", F.struct("long_n", -F.col("long_id"))).alias("keeper"))
    out = facts.join(classes, ["path", "n_points", "digest"], "left").join(keeper, "class_id", "left")
    keep = F.coalesce("keeper", "class_id", "file_id")
    names = ["file_id", "save_path", "path", "length", "checksum", "key", "n_points"]
    return out.select(*names, F.coalesce("class_id", "file_id").alias("class_id"), keep.alias("stored_as")), begins


_ARCHIVE = pa.schema([
    ("container_id", pa.int64()), ("block", pa.binary()), ("file_id", pa.int64()), ("save_path", pa.string()), ("path", pa.string()), ("n_points", pa.int32()), ("class_id", pa.int64()), ("stored_as", pa.int64()),
    ("offset", pa.int64()), ("length", pa.int64()), ("checksum", pa.int64()), ("own_length", pa.int64()), ("own_checksum", pa.int64()), ("patch_offset", pa.int64()), ("patch_length", pa.int64()),
])
_TYPES = "container_id long, block binary, file_id long, save_path string, path string, n_points int, class_id long, stored_as long, offset long, length long, checksum long, own_length long, own_checksum long, patch_offset long, patch_length long"
_FACTS = ("file_id", "save_path", "path", "n_points", "class_id", "stored_as", "length", "checksum", "key")


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each container, its block, and one for each of its files.

    Rows in are facts (data is null) and texts. Files that are stored whole come first, in order of path; after them, for
    each file whose bytes do not begin its keeper's, those deflated with the keeper's bytes as dictionary.
    """
    for t in runs(batches, "container_id"):
        c = {n: t.column(n).to_pylist() for n in ("file_id", "key", "data")}
        texts = {(i, k): d for i, k, d in zip(c["file_id"], c["key"], c["data"], strict=True) if d is not None}
        facts = t.filter(pc.is_null(t.column("data"))).select(_FACTS).to_pylist()
        facts.sort(key=lambda f: (f["path"], f["file_id"]))
        pieces, at, place = [], 0, {}
        for f in facts:
            if f["stored_as"] == f["file_id"]:
                data = texts[f["file_id"], f["key"]]
                place[f["file_id"]] = (at, len(data), zlib.crc32(data), data)
                pieces.append(data)
                at += len(data)
        out = []
        for f in facts:
            offset, length, checksum, kept = place[f["stored_as"]]
            own = kept if f["stored_as"] == f["file_id"] else texts[f["file_id"], f["key"]]
            patch = (None, None)
            if not kept.startswith(own):
                z = zlib.compressobj(9, wbits=-15, zdict=kept)
                pieces.append(z.compress(own) + z.flush())
                patch = (at, len(pieces[-1]))
                at += patch[1]
            row = {n: f[n] for n in ("file_id", "save_path", "path", "n_points", "class_id", "stored_as")}
            out.append(row | {"offset": offset, "length": length, "checksum": checksum, "own_length": f["length"], "own_checksum": f["checksum"], "patch_offset": patch[0], "patch_length": patch[1]})
        if out:
            no = t.column("container_id")[0].as_py()
            yield pa.RecordBatch.from_pylist([{"container_id": no, "block": b"".join(pieces)}], _ARCHIVE)
            yield pa.RecordBatch.from_pylist([r | {"container_id": no} for r in out], _ARCHIVE)


def write_archive(files: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Pack files ``(file_id, save_path, file_text)`` into an archive in a folder of any file system that Spark writes to.

    ``<folder>/files`` has a row for each container with its block, about ``block_bytes`` long, and a row for each file;
    ``<folder>/begins`` says which classes of files begin which. Files are spread over containers by a hash of their path;
    the files of a path that has more bytes than a block by path and keeper. Each text is shuffled once.
    """
    facts = cut(_facts(files))
    index, begins = _index_of(facts, files)
    index = cut(index)
    whole = index.where("stored_as = file_id")
    total = whole.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    hot = cut(whole.groupBy("path").agg(F.sum("length").alias("bytes")).where(F.col("bytes") > block_bytes).select("path", F.lit(True).alias("hot")))
    any_hot = not hot.isEmpty()
    by_path, by_keeper = F.pmod(F.xxhash64("path"), F.lit(n)), F.pmod(F.xxhash64("path", "stored_as"), F.lit(n))
    texts = _texts(files).select("file_id", canonical_path(F.col("save_path")).alias("path"), F.xxhash64("file_text").alias("key"), F.encode("file_text", "UTF-8").alias("data"))
    if any_hot:
        few = _if_small(hot)
        index_at = index.join(few, "path", "left").withColumn("container_id", F.when(F.col("hot"), by_keeper).otherwise(by_path)).drop("hot")
        divided = texts.join(few.drop("hot"), "path", "left_semi").join(index.select("file_id", "stored_as"), "file_id")
        texts = texts.join(few.drop("hot"), "path", "left_anti").select(by_path.alias("container_id"), "file_id", "key", "data").union(divided.select(by_keeper.alias("container_id"), "file_id", "key", "data"))
    else:
        index_at = index.withColumn("container_id", by_path)
        texts = texts.select(by_path.alias("container_id"), "file_id", "key", "data")
    rows = index_at.withColumn("data", F.lit(None).cast("binary")).unionByName(texts, allowMissingColumns=True)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "container_id").sortWithinPartitions("container_id").mapInArrow(_containers, _TYPES).write.parquet(f"{folder}/files")
    begins.write.parquet(f"{folder}/begins")
    for df in (facts, index, begins, hot):
        drop_cut(df)


def read_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(index, blocks, begins)`` of an archive.

    index: ``(file_id, save_path, path, n_points, class_id, stored_as, container_id, offset, length, checksum, own_length,
    own_checksum, patch_offset, patch_length)`` with one row for every file of the input. ``stored_as`` is the file
    whose bytes are stored; offset, length and checksum are that file's. A file whose own bytes are not the beginning of
    those has a patch in the same container, else patch_offset and patch_length are null. ``class_id`` is the smallest
    file_id with the same path and points. Reading the index does not read blocks.
    blocks: ``(container_id, block)``. begins: ``(class_id, long_id, long_n)``, classes that begin other classes.
    """
    files = spark.read.schema(_TYPES).parquet(f"{folder}/files")
    names = ["file_id", "save_path", "path", "n_points", "class_id", "stored_as", "container_id", "offset", "length", "checksum", "own_length", "own_checksum", "patch_offset", "patch_length"]
    begins = spark.read.schema("class_id long, long_id long, long_n int").parquet(f"{folder}/begins")
    return files.where("file_id IS NOT NULL").select(*names), files.where("file_id IS NULL").select("container_id", "block"), begins


def pack(files: DataFrame, block_bytes: int = BLOCK_BYTES, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write an archive, in the shared folder if none is named, and read it: ``(index, blocks, begins)``.

    Files without points are stored as they are. Null file_id or save_path: left out; null text: empty; of several rows of
    one file_id the longest counts.
    """
    spark = files.sparkSession
    folder = folder or f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(files, folder, block_bytes)
    return read_archive(spark, folder)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each file out of its container's block; null where they cannot be had."""
    for t in runs(batches, "container_id"):
        has = t.column("block").is_valid()
        block = next((b.as_buffer() for b in t.column("block").filter(has)), None)
        f = t.filter(pc.invert(has))
        c = {n: f.column(n).to_pylist() for n in ("offset", "length", "patch_offset", "patch_length", "own_length", "own_checksum")}
        data = []
        for k in range(len(f)):
            d = None
            if block is not None:
                kept = block[c["offset"][k] : c["offset"][k] + c["length"][k]].to_pybytes()
                d = kept[: c["own_length"][k]]
                if c["patch_offset"][k] is not None:
                    try:
                        d = zlib.decompressobj(wbits=-15, zdict=kept).decompress(block[c["patch_offset"][k] : c["patch_offset"][k] + c["patch_length"][k]].to_pybytes())
                    except zlib.error:
                        d = None
            data.append(d)
        intact = [d is not None and len(d) == n and zlib.crc32(d) == s for d, n, s in zip(data, c["own_length"], c["own_checksum"], strict=True)]
        names = ["file_id", "save_path", "path", "container_id"]
        cols = [f.column(n).combine_chunks() for n in names]
        for at in range(0, len(f), 1000):  # batches of many files stay small
            yield pa.RecordBatch.from_arrays([*(x.slice(at, 1000) for x in cols), pa.array(data[at : at + 1000], pa.binary()), pa.array(intact[at : at + 1000], pa.bool_())], names=[*names, "data", "intact"])


def restore(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(file_id, save_path, path, container_id, data, intact)`` of every file of the index: its own bytes, checked against its own
    length and checksum. Each block is read once, by the task that has the files of its container."""
    rows = index.withColumn("block", F.lit(None).cast("binary")).unionByName(blocks, allowMissingColumns=True)
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["container_id", "block", "file_id", "save_path", "path", "offset", "length", "own_length", "own_checksum", "patch_offset", "patch_length"]
    rows = rows.select(*names).repartition(n, "container_id").sortWithinPartitions("container_id")
    return rows.mapInArrow(_restored, "file_id long, save_path string, path string, container_id long, data binary, intact boolean")


def unpack(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(file_id, path, data, intact)`` of the files stored whole."""
    return restore(index.where("stored_as = file_id"), blocks).select("file_id", "path", "data", "intact")


def lookup(index: DataFrame, blocks: DataFrame, paths: list[str]) -> DataFrame:
    """The files that a few paths lead to, however they are spelt, as ``restore`` gives them. Only containers that hold
    one of them are read."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(p,) for p in paths], "p string").select(canonical_path(F.col("p")).alias("path")).distinct()
    hit = index.join(F.broadcast(wanted), "path", "left_semi")
    ids = [r[0] for r in hit.select("container_id").distinct().collect()]  # no more than the containers of the paths
    return restore(hit, blocks.where(F.col("container_id").isin(ids)))


def same_files(index: DataFrame, begins: DataFrame) -> DataFrame:
    """``(file_a, file_b)``, file_a < file_b: files of one path whose points are equal or one's the other's beginning.

    Read off the index: members of a class with each other, and with the members of the classes that theirs begins.
    """
    m = index.where("n_points > 0").select("class_id", "file_id")
    a, b = m.toDF("class_id", "file_a"), m.toDF("class_id", "file_b")
    within = a.join(b, "class_id").where("file_a < file_b").select("file_a", "file_b")
    across = a.join(begins, "class_id").join(b.withColumnRenamed("class_id", "long_id"), "long_id")
    return within.union(across.select(F.least("file_a", "file_b"), F.greatest("file_a", "file_b")))
