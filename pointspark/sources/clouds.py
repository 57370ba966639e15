"""Reading and writing point clouds: text, PCD, raw binary frames, OFF meshes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointspark.session import cut

_CODES = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8"}


# ---------------------------------------------------------------- text


def parse_xyz(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines with ``x, y, z, ok``: the first three numbers of a line, commas as blanks. Works on a stream too."""
    t = F.split(F.trim(F.regexp_replace(F.col(value), r"[,\s]+", " ")), " ")
    c = {a: F.get(t, k).try_cast("double") for k, a in enumerate("xyz")}
    return lines.withColumns(c).withColumn("ok", F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def read_txt_xyz(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """``(path, idx, x, y, z, intensity, label[, corrupt])`` of text files with one point a line.

    Lines without characters are skipped; idx counts the others from 0 in the order of each file; intensity is 1, label
    -1, further columns of a line are ignored. A line without three numbers keeps null coordinates and its text in
    ``corrupt`` (PERMISSIVE), is dropped but counted in idx (DROPMALFORMED), or stops the query (FAILFAST). A missing
    path raises. Files of any size are split; parts of a file are numbered by their offsets.
    """
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode {mode}")
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value"), F.monotonically_increasing_id().alias("m"))
    raw = cut(raw.where(F.length("value") > 0))
    parts = raw.groupBy("path", "block").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("path", "block", ahead.alias("ahead"))
    no = F.row_number().over(Window.partitionBy("path", "block").orderBy("m")) - 1
    p = parse_xyz(raw.withColumn("no", no).join(parts, ["path", "block"]).withColumn("idx", (F.col("no") + F.col("ahead")).cast("long")))
    out = ["path", "idx", "x", "y", "z", F.lit(1.0).alias("intensity"), F.lit(-1).alias("label")]
    if mode == "DROPMALFORMED":
        return p.where("ok").select(*out)
    if mode == "FAILFAST":
        bad = F.raise_error(F.concat(F.lit("not a point: "), "value"))
        return p.select(*out[:2], F.when(F.col("ok"), F.col("x")).otherwise(bad.cast("double")).alias("x"), *out[3:])
    return p.select(*out, F.when(~F.col("ok"), F.col("value")).alias("corrupt"))


def write_txt(points: DataFrame, path: str, mode: str = "error", *partition: str) -> None:
    """One point a line, ``x,y,z`` with six decimals, optionally in folders by columns."""
    line = F.format_string("%.6f,%.6f,%.6f", "x", "y", "z").alias("value")
    points.select(line, *partition).write.mode(mode).partitionBy(*partition).text(path)


# ---------------------------------------------------------------- PCD


@dataclass
class PcdHeader:
    version: str = ""
    fields: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    width: int = 0
    height: int = 0
    points: int = 0
    data_type: str = ""
    has_rgb: bool = False
    offset: int = 0

    @property
    def valid(self) -> bool:
        return self.points > 0

    def dtype(self) -> np.dtype:
        counts = self.counts or [1] * len(self.fields)
        return np.dtype([(f"{i}", _CODES[(t, s)], (c,)) for i, (t, s, c) in enumerate(zip(self.types, self.sizes, counts, strict=True))])


def parse_pcd_header(data: bytes) -> PcdHeader:
    """Header of a PCD file. Blank lines and comments are skipped, unknown keys ignored; it ends with DATA. A value that is no
    number counts as 0. Without POINTS, width times height holds; the header is ``valid`` if there is a point."""
    h, at, ended = PcdHeader(), 0, False
    while at < len(data) and not ended:
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        key, _, rest = data[at:stop].decode("latin-1").strip().partition(" ")
        at, ended = stop + 1, key.upper() == "DATA"
        if key.upper() in _KEYS:
            name, read = _KEYS[key.upper()]
            setattr(h, name, read(rest.split()))
    h.offset = at if ended else 0
    h.has_rgb = bool({f.lower() for f in h.fields} & {"rgb", "rgba"})
    h.points = h.points or h.width * h.height
    return h


def _whole(v: str) -> int:
    return int(v) if v.lstrip("+-").isdigit() else 0


#: What is read from a line of the header, by its key.
_KEYS = {
    "VERSION": ("version", " ".join),
    "FIELDS": ("fields", list),
    "SIZE": ("sizes", lambda v: [_whole(x) for x in v]),
    "TYPE": ("types", lambda v: [x.upper() for x in v]),
    "COUNT": ("counts", lambda v: [_whole(x) for x in v]),
    "WIDTH": ("width", lambda v: _whole(v[0]) if v else 0),
    "HEIGHT": ("height", lambda v: _whole(v[0]) if v else 0),
    "POINTS": ("points", lambda v: _whole(v[0]) if v else 0),
    "DATA": ("data_type", lambda v: v[0].lower() if v else ""),
}


def pcd_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: ``(path, version, fields, sizes, types, counts, width, height, points, data_type, has_rgb, valid)``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                h = parse_pcd_header(bytes(c))
                out.append((p, h.version, h.fields, h.sizes, h.types, h.counts, h.width, h.height, h.points, h.data_type, h.has_rgb, h.valid))
            yield pd.DataFrame(out, columns=["path", "version", "fields", "sizes", "types", "counts", "width", "height", "points", "data_type", "has_rgb", "valid"])

    schema = "path string, version string, fields array<string>, sizes array<int>, types array<string>, counts array<int>, width int, height int, points int, data_type string, has_rgb boolean, valid boolean"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(rows, schema)


def decode_pcd(data: bytes) -> pd.DataFrame:
    """Points ``idx, x, y, z, intensity, label`` of one file, ascii or binary; missing fields are null."""
    h = parse_pcd_header(data)
    names = {"x": "x", "y": "y", "z": "z", "intensity": "intensity", "i": "intensity", "label": "label", "l": "label"}
    if not h.valid:
        return pd.DataFrame({c: [] for c in ("idx", "x", "y", "z", "intensity", "label")}, dtype=float)
    counts = h.counts or [1] * len(h.fields)
    first = np.cumsum([0, *counts[:-1]])
    if h.data_type == "ascii":
        rows = [r.split() for r in data[h.offset :].decode("latin-1").splitlines() if r.strip()][: h.points]
        table = np.array([[float(v) for v in r] for r in rows if len(r) >= sum(counts)], float).reshape(-1, sum(counts)) if rows else np.zeros((0, sum(counts)))
        get = lambda k: table[:, first[k]]
        n = len(table)
    elif h.data_type == "binary":
        dt = h.dtype()
        n = min(h.points, (len(data) - h.offset) // dt.itemsize)
        table = np.frombuffer(data, dt, n, h.offset)
        get = lambda k: table[f"{k}"][:, 0].astype(float)
    else:
        raise ValueError(f"unsupported PCD data type {h.data_type!r}")
    out = {c: np.full(n, np.nan) for c in ("x", "y", "z", "intensity", "label")}
    for k, f in enumerate(h.fields):
        if f.lower() in names:
            out[names[f.lower()]] = get(k)
    return pd.DataFrame({"idx": np.arange(n), **out})


def decode_files(files: DataFrame, decode=decode_pcd) -> DataFrame:
    """Points of whole files ``(path, content)``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                d = decode(bytes(c))
                d.insert(0, "path", p)
                yield d

    p = files.select("path", "content").mapInPandas(rows, "path string, idx long, x double, y double, z double, intensity double, label double")
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    return p.select("path", "idx", "x", "y", "z", F.coalesce(nan("intensity"), F.lit(1.0)).alias("intensity"), F.coalesce(nan("label").cast("int"), F.lit(-1)).alias("label"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """``(path, idx, x, y, z, intensity, label)`` of PCD files, ascii or binary; one task reads a file. Files whose header
    has no point give no rows. Without intensity it is 1, without label -1."""
    return decode_files(_files(spark, path))


def read_bin(spark: SparkSession, path: str, columns: int = 4) -> DataFrame:
    """Frames of packed little-endian float32 rows ``x y z [intensity ...]``; an incomplete last row is dropped."""

    def decode(data: bytes) -> pd.DataFrame:
        a = np.frombuffer(data, "<f4", len(data) // (4 * columns) * columns).reshape(-1, columns).astype(float)
        nothing = np.full(len(a), np.nan)
        return pd.DataFrame({"idx": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2], "intensity": a[:, 3] if columns > 3 else nothing, "label": nothing})

    return decode_files(_files(spark, path), decode)


# ---------------------------------------------------------------- OFF meshes


def list_files(spark: SparkSession, root: str, pattern: str = "*.off") -> DataFrame:
    """``(path, class, split, name)`` of the files below ``<root>/<class>/<split>/<name>``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    get = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.[^./]+$", k)
    return f.select("path", get(1).alias("class"), get(2).alias("split"), get(3).alias("name"))


def parse_off(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles. The counts may follow OFF on its line; polygons are cut into fans of triangles."""
    lines = [s for s in (re.sub(r"#.*", "", x).strip() for x in text.splitlines()) if s]
    if not lines or not lines[0].upper().startswith("OFF"):
        raise ValueError("not an OFF file")
    rest = lines[0][3:].split()
    at = 1
    if not rest:
        rest, at = lines[1].split(), 2
    nv, nf = int(rest[0]), int(rest[1])
    v = np.array([[float(x) for x in s.split()[:3]] for s in lines[at : at + nv]]).reshape(-1, 3)
    faces = []
    for s in lines[at + nv : at + nv + nf]:
        k, *p = [int(x) for x in s.split()]
        faces += [(p[0], p[i], p[i + 1]) for i in range(1, k - 1)]
    return v, np.array(faces, np.int64).reshape(-1, 3)


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vertices(mesh, vid, x, y, z)`` and ``faces(mesh, fid, v0, v1, v2)`` of OFF files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.off").load(path).select("path", "content")

    def rows(which: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for p, c in zip(b["path"], b["content"], strict=True):
                    a = parse_off(bytes(c).decode("latin-1"))[which]
                    names = ["x", "y", "z"] if which == 0 else ["v0", "v1", "v2"]
                    d = pd.DataFrame(a, columns=names)
                    d.insert(0, "vid" if which == 0 else "fid", np.arange(len(a)))
                    d.insert(0, "mesh", p)
                    yield d

        return run

    v = raw.mapInPandas(rows(0), "mesh string, vid long, x double, y double, z double")
    f = raw.mapInPandas(rows(1), "mesh string, fid long, v0 long, v1 long, v2 long")
    return v, f


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``(mesh, vid, nx, ny, nz)``: unit mean of the normals of a vertex's faces, each weighted by its area; null where they
    cancel out, no row for a vertex without faces."""
    f = faces
    for k in range(3):
        f = f.join(vertices.select("mesh", F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), ["mesh", f"v{k}"])
    a, b = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    g = f.select("mesh", F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[v.alias(f"n{c}") for v, c in zip(n, "xyz", strict=True)])
    g = g.groupBy("mesh", "vid").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return g.withColumn("size", size).select("mesh", "vid", *[F.when(F.col("size") > 0, F.col(f"n{c}") / F.col("size")).alias(f"n{c}") for c in "xyz"])


def sample_surface(vertices: DataFrame, faces: DataFrame, num_points: int = 4096, seed: int = 1) -> DataFrame:
    """``(mesh, idx, x, y, z)``: points spread evenly over the area of each mesh, min(num_points, max(256, faces // 10)).

    The share of each face is settled by cumulative area, so the k-th point of a mesh lies on the face whose interval
    holds (k + u) / n with u drawn by a seeded hash (stratified); its place on the face is uniform. Faces without area
    get no points; a mesh without area none at all.
    """
    f = faces
    for k in range(3):
        f = f.join(vertices.select("mesh", F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), ["mesh", f"v{k}"])
    a, b = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    cr = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    f = f.withColumn("area", F.sqrt(cr[0] * cr[0] + cr[1] * cr[1] + cr[2] * cr[2]) / 2)
    w = Window.partitionBy("mesh")
    f = f.withColumn("total", F.sum("area").over(w)).withColumn("n", F.least(F.lit(num_points), F.greatest(F.lit(256), F.floor(F.count("*").over(w) / 10))))
    f = f.where("total > 0").withColumn("high", F.sum("area").over(w.orderBy("fid").rowsBetween(Window.unboundedPreceding, 0)) / F.col("total"))
    f = f.withColumn("high", F.when(F.col("high") > 1 - 1e-12, 1.0).otherwise(F.col("high")))
    f = f.withColumn("low", F.coalesce(F.lag("high").over(w.orderBy("fid")), F.lit(0.0))).where("area > 0")
    u = lambda salt: F.pmod(F.xxhash64("mesh", "idx", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    # candidates k whose stratum [k, k + 1) / n meets the face's interval; the drawn place decides between faces
    first, last = F.floor(F.col("low") * F.col("n")), F.least(F.floor(F.col("high") * F.col("n")), F.col("n") - 1)
    p = f.withColumn("idx", F.explode(F.sequence(first, F.greatest(first, last)))).where("idx < n")
    at = (F.col("idx") + u(0)) / F.col("n")
    p = p.where((at >= F.col("low")) & (at < F.col("high"))).withColumn("s", F.sqrt(u(1))).withColumn("t", u(2))
    xyz = [((1 - F.col("s")) * F.col(f"{c}0") + F.col("s") * (1 - F.col("t")) * F.col(f"{c}1") + F.col("s") * F.col("t") * F.col(f"{c}2")).alias(c) for c in "xyz"]
    return p.select("mesh", F.col("idx").cast("long").alias("idx"), *xyz)


def off_to_points(spark: SparkSession, source: str, target: str, num_points: int = 4096, seed: int = 1) -> DataFrame:
    """Convert all meshes below ``<source>/<class>/<split>`` in one job to text under ``<target>/class=../split=..``."""
    v, f = read_off(spark, source)
    p = sample_surface(v, f, num_points, seed)
    get = lambda k: F.regexp_extract("mesh", r"([^/]+)/([^/]+)/[^/]+$", k)
    p = p.withColumn("class", get(1)).withColumn("split", get(2))
    write_txt(p, target, "overwrite", "class", "split")
    return p
