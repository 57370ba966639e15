"""Schemas that drift between files: versions, recorded changes, migration steps, one table for all records.

A header's layout is normalised and fingerprinted. Each sensor's files, in order of capture, give its versions;
the steps from one fingerprint to the next (renamed, added, removed, retyped, storage) are worked out once for
each distinct pair of fingerprints and recorded for each file that first shows them. The fields of a version are then
routed through the renames of all later versions of the same sensor, cast to the type that holds all of a column's
values, and set to null where the version has no such field; every rule is recorded (``migrations``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointspark.session import cut

#: Files of one sensor are compared within spans of so many seconds, and the spans' ends with each other.
SPAN_SECONDS = 7 * 86_400
#: The table has one set of columns: more distinct names than this are refused.
MAX_NAMES = 10_000
_OWN = ("file_id", "rec_no", "sensor_id", "corrupt")
_LISTS = ("fields", "sizes", "types", "counts")
#: numpy codes of the PCD types (fixed values).
_CODES = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8"}


def _clean(c: Column, change) -> Column:
    # outer white space of any kind is no part of a name
    return change(F.regexp_replace(c, r"^\s+|\s+$", ""))


def layouts(headers: DataFrame) -> DataFrame:
    """One row a usable file: ``(file_id, sensor_id, captured_at, layout, storage, fingerprint)``.

    ``layout`` is the list of (name, size, type, count) with names in lower case. A file registered more than once
    counts once, as first registered. Headers in which one of the four lists is missing or their lengths differ are
    left out, as are those without file_id, sensor_id or captured_at.
    """
    h = headers.select("file_id", "sensor_id", "captured_at", "registered_at", *_LISTS, "data_type")
    ok = F.lit(True)
    for c in _LISTS:
        ok = ok & F.col(c).isNotNull() & (F.size(c) == F.size("fields"))
    h = h.where(ok & F.col("file_id").isNotNull() & F.col("sensor_id").isNotNull() & F.col("captured_at").isNotNull())
    names = F.transform("fields", lambda s: F.coalesce(_clean(s, F.lower), F.lit("")))
    types = F.transform("types", lambda s: F.coalesce(_clean(s, F.upper), F.lit("")))
    layout = F.transform(
        F.arrays_zip(names.alias("n"), F.col("sizes").alias("s"), types.alias("t"), F.col("counts").alias("c")),
        lambda x: F.struct(x["n"].alias("name"), x["s"].alias("size"), x["t"].alias("type"), x["c"].alias("count")),
    )
    h = h.select("file_id", "sensor_id", "captured_at", "registered_at", layout.alias("layout"), F.coalesce(_clean(F.col("data_type"), F.lower), F.lit("")).alias("storage"))
    first = F.min_by(F.struct("sensor_id", "captured_at", "layout", "storage"), F.struct(F.coalesce("registered_at", F.lit("9999-01-01").cast("timestamp")), "captured_at"))
    h = h.groupBy("file_id").agg(first.alias("f")).select("file_id", "f.*")
    return h.withColumn("fingerprint", F.sha2(F.to_json(F.struct("layout", "storage")), 256))


def previous(files: DataFrame, *columns: str) -> DataFrame:
    """Each file with ``p_...`` columns of the sensor's previous one by (captured_at, file_id), null for the first.

    A sensor may hold most of the files, so it isn't sorted as one group: files are ordered within spans of time,
    and the first of a span gets the last of the sensor's span before, out of one row a span.
    """
    span = F.floor(F.col("captured_at").cast("double") / SPAN_SECONDS)
    item = F.struct(*columns)
    w = Window.partitionBy("sensor_id", "span").orderBy("captured_at", "file_id")
    f = files.withColumn("span", span).withColumn("before", F.lag(item).over(w)).withColumn("no", F.row_number().over(w))
    ends = f.groupBy("sensor_id", "span").agg(F.max_by(item, F.struct("captured_at", "file_id")).alias("end"))
    ends = ends.withColumn("end", F.lag("end").over(Window.partitionBy("sensor_id").orderBy("span"))).withColumn("no", F.lit(1))
    f = f.join(ends, ["sensor_id", "span", "no"], "left")
    p = F.when(F.col("no") == 1, F.col("end")).otherwise(F.col("before"))
    return f.withColumn("p", p).select(*files.columns, *[F.col(f"p.{c}").alias(f"p_{c}") for c in columns])


def _steps() -> Column:
    """The steps from ``p_layout, p_storage`` to ``layout, storage`` as a list of (kind, name, old name, detail)."""
    old, new = F.col("p_layout"), F.col("layout")
    names = lambda a: F.transform(a, lambda x: x["name"])
    same_form = lambda a, b: (a["size"] == b["size"]) & (a["type"] == b["type"]) & (a["count"] == b["count"])
    text = lambda x: F.concat_ws(" ", x["type"], x["size"].cast("string"), x["count"].cast("string"))
    step = lambda kind, name, was, detail: F.struct(F.lit(kind).alias("change_kind"), name.alias("field_name"), was.alias("old_name"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    at = F.transform(new, lambda x, i: F.struct(x.alias("n"), F.get(old, i).alias("o")))
    renamed = F.filter(
        at,
        lambda p: p["o"].isNotNull() & ~F.array_contains(names(old), p["n"]["name"]) & ~F.array_contains(names(new), p["o"]["name"]) & same_form(p["n"], p["o"]),
    )
    to, gone = F.transform(renamed, lambda p: p["n"]["name"]), F.transform(renamed, lambda p: p["o"]["name"])
    added = F.array_except(F.array_except(names(new), names(old)), to)
    removed = F.array_except(F.array_except(names(old), names(new)), gone)
    both = F.flatten(F.transform(new, lambda n: F.transform(F.slice(F.filter(old, lambda o: o["name"] == n["name"]), 1, 1), lambda o: F.struct(n.alias("n"), o.alias("o")))))
    retyped = F.filter(both, lambda p: ~same_form(p["n"], p["o"]))
    storage = F.when(F.col("p_storage") != F.col("storage"), F.array(step("storage", F.lit("data"), none, F.concat_ws(" -> ", "p_storage", "storage"))))
    return F.concat(
        F.transform(added, lambda n: step("added", n, none, none)),
        F.transform(removed, lambda n: step("removed", n, none, none)),
        F.transform(renamed, lambda p: step("renamed", p["n"]["name"], p["o"]["name"], none)),
        F.transform(retyped, lambda p: step("retyped", p["n"]["name"], none, F.concat_ws(" -> ", text(p["o"]), text(p["n"])))),
        F.coalesce(storage, F.array().cast("array<struct<change_kind:string,field_name:string,old_name:string,detail:string>>")),
    )


def changes(headers: DataFrame) -> DataFrame:
    """Every change: ``(file_id, sensor_id, captured_at, change_kind, field_name, old_name, detail)``.

    ``file_id`` is the file that first shows it against the sensor's previous one. Letter case, surrounding blanks
    and mere order are no change. An empty table gives no rows. Steps are worked out for distinct pairs of
    fingerprints only, so the work follows the number of versions and not that of files.
    """
    f = cut(previous(layouts(headers), "layout", "storage", "fingerprint").where("p_fingerprint <> fingerprint"))
    pairs = f.groupBy("p_fingerprint", "fingerprint").agg(*[F.any_value(c).alias(c) for c in ("p_layout", "p_storage", "layout", "storage")])
    steps = pairs.select("p_fingerprint", "fingerprint", F.array_distinct(_steps()).alias("steps"))
    out = f.select("file_id", "sensor_id", "captured_at", "p_fingerprint", "fingerprint").join(steps, ["p_fingerprint", "fingerprint"])
    return out.select("file_id", "sensor_id", "captured_at", F.explode("steps").alias("s")).select("file_id", "sensor_id", "captured_at", "s.*")


def history(headers: DataFrame) -> DataFrame:
    """``layouts`` with each file's ``version``, its place in its sensor's history: versions count changes of fingerprint
    from 0. Running counts are formed per span of time and added up over spans."""
    f = previous(layouts(headers), "fingerprint")
    new = F.when(F.col("p_fingerprint") != F.col("fingerprint"), 1).otherwise(0)
    f = f.withColumn("new", new).withColumn("span", F.floor(F.col("captured_at").cast("double") / SPAN_SECONDS))
    w = Window.partitionBy("sensor_id", "span").orderBy("captured_at", "file_id").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("in_span", F.sum("new").over(w))
    spans = f.groupBy("sensor_id", "span").agg(F.sum("new").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("sensor_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = f.join(spans.select("sensor_id", "span", ahead.alias("ahead")), ["sensor_id", "span"])
    return f.select("file_id", "sensor_id", "captured_at", "layout", "storage", (F.col("in_span") + F.col("ahead")).alias("version"), "fingerprint")


def versions(headers: DataFrame) -> DataFrame:
    """``(file_id, sensor_id, version, fingerprint)`` of ``history``."""
    return history(headers).select("file_id", "sensor_id", "version", "fingerprint")


# ---------------------------------------------------------------- migration


def _renames(old: list, new: list) -> dict[str, str]:
    """Old name to new name where a gone and a new name stand at the same place with equal form."""
    was, now = {x["name"] for x in old}, {x["name"] for x in new}
    form = lambda x: (x["size"], x["type"], x["count"])
    return {o["name"]: n["name"] for o, n in zip(old, new, strict=False) if o["name"] not in now and n["name"] not in was and form(o) == form(n)}


def _chained(g: pd.DataFrame) -> pd.DataFrame:
    """The routes of one sensor: rename steps folded from its last version to its first.

    A field's line follows its renames; its column is the name that its line ends with. Where two lines of one version end
    with the same name, the one that ended earlier gets the number of its last version added.
    """
    g = g.sort_values("version")
    layout, number = g["layout"].tolist(), g["version"].tolist()
    lines: list[dict[str, tuple]] = [{} for _ in layout]
    second = set()  # lines that meet a later one of the same name
    for k in range(len(layout) - 1, -1, -1):
        last = k + 1 == len(layout)
        ends = {} if last else lines[k + 1]
        renamed = {} if last else _renames(layout[k], layout[k + 1])
        for x in layout[k]:
            name = x["name"]
            if name in renamed:
                end, until, steps = ends[renamed[name]]
                lines[k][name] = (end, until, ((number[k + 1], name, renamed[name]), *steps))
            else:
                lines[k][name] = ends.get(name, (name, number[k], ()))
        longest: dict[str, int] = {}
        for end, until, _ in lines[k].values():
            longest[end] = max(longest.get(end, -1), until)
        second |= {(end, until) for end, until, _ in lines[k].values() if until < longest[end]}
    out = []
    for k, at in enumerate(lines):
        for x in layout[k]:
            end, until, steps = at[x["name"]]
            column = _column(f"{end}_v{until}" if (end, until) in second else end)
            out.append((g["sensor_id"].iloc[0], number[k], g["files"].iloc[k], x["name"], column, x["type"], x["size"], x["count"], [f"{a} -> {b} in version {v}" for v, a, b in steps]))
    return pd.DataFrame(out, columns=["sensor_id", "version", "files", "field_name", "column_name", "type", "size", "count", "renames"])


def _routes(h: DataFrame) -> DataFrame:
    """``(sensor_id, version, files, field_name, column_name, type, size, count, renames)`` for a ``history``. The versions of
    a sensor, not its files, are folded by one task."""
    v = h.groupBy("sensor_id", "version").agg(F.any_value("layout").alias("layout"), F.count("*").alias("files"))
    schema = "sensor_id long, version long, files long, field_name string, column_name string, type string, size int, count int, renames array<string>"
    return v.groupBy("sensor_id").applyInPandas(_chained, schema)


def _one(c: str) -> Column:
    return F.coalesce(F.greatest(F.col(c), F.lit(1)), F.lit(1))


def _columns(routes: DataFrame) -> dict[str, str]:
    """The type of each column of the table: DOUBLE if a version has it as F (or in a form of no known code), else BIGINT,
    or DECIMAL(20, 0) if one has it as U of 8 bytes. MAX_NAMES columns at most."""
    r = routes.withColumn("k", F.explode(F.sequence(F.lit(0), _one("count") - 1)))
    name = F.when(_one("count") > 1, F.concat_ws("_", "column_name", F.col("k").cast("string"))).otherwise(F.col("column_name"))
    whole = F.col("type").isin("I", "U") & F.col("size").isin(1, 2, 4, 8)
    t = r.groupBy(name.alias("c")).agg(F.max(~F.coalesce(whole, F.lit(False))).alias("real"), F.max((F.col("type") == "U") & (F.col("size") == 8)).alias("wide")).limit(MAX_NAMES + 1).collect()
    if len(t) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} columns")
    return {r["c"]: "double" if r["real"] else "decimal(20,0)" if r["wide"] else "bigint" for r in sorted(t, key=lambda r: r["c"])}


def column_names(headers: DataFrame) -> dict[str, str]:
    """The column each field name goes to in most files (ties: first in the alphabet). Sensors may differ, as each has its
    own history of renames."""
    r = _routes(history(headers)).groupBy("field_name", "column_name").agg(F.sum("files").alias("n"))
    best = r.groupBy("field_name").agg(F.min(F.struct((-F.col("n")).alias("n"), "column_name")).alias("b")).limit(MAX_NAMES + 1).collect()
    if len(best) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} field names")
    return {r["field_name"]: r["b"]["column_name"] for r in sorted(best, key=lambda r: r["field_name"])}


def _same_type(t: str) -> Column:
    """Whether a field of this form is of the column's type already."""
    form = F.concat_ws(" ", "type", F.col("size").cast("string"))
    return form == {"double": "F 8", "bigint": "I 8", "decimal(20,0)": "U 8"}[t]


def migrations(headers: DataFrame) -> DataFrame:
    """Every rule of every version: ``(sensor_id, version, column_name, field_name, rule, detail)``.

    Rules: ``keep``; ``rename``, one for each step of the chain in order of versions (``step`` counts them); ``cast`` with
    the form of the field and the type of the column; ``default`` for each column of the table that the version has no field
    for (null). Columns of fields with a count above 1 are named without their number.
    """
    routes = cut(_routes(history(headers)))
    types = _columns(routes)
    names = sorted({r["column_name"] for r in routes.select("column_name").distinct().collect()})
    of = {n: types[n] if n in types else types[f"{n}_0"] for n in names}
    to = F.create_map(*[F.lit(v) for kv in of.items() for v in kv]) if of else F.create_map().cast("map<string,string>")
    r = routes.withColumn("to", F.try_element_at(to, F.col("column_name")))
    same = F.lit(False)
    for t in sorted(set(of.values())):
        same = same | ((F.col("to") == t) & _same_type(t))
    rule = lambda name, step, detail: F.struct(F.lit(name).alias("rule"), F.lit(step).cast("int").alias("step") if isinstance(step, int) else step.cast("int").alias("step"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    cast = F.when(~same, F.array(rule("cast", 0, F.concat(F.concat_ws(" ", "type", F.col("size").cast("string")), F.lit(" -> "), "to"))))
    rules = F.concat(F.transform("renames", lambda d, i: rule("rename", i, d)), F.coalesce(cast, F.array().cast("array<struct<rule:string,step:int,detail:string>>")))
    rules = F.when(F.size(rules) == 0, F.array(rule("keep", 0, none))).otherwise(rules)
    out = r.select("sensor_id", "version", "column_name", "field_name", F.explode(rules).alias("r")).select("sensor_id", "version", "column_name", "field_name", "r.*")
    own = routes.groupBy("sensor_id", "version").agg(F.collect_set("column_name").alias("own"))
    lacks = F.array_except(F.array(*[F.lit(n) for n in names]), F.col("own")) if names else F.array().cast("array<string>")
    missing = own.select("sensor_id", "version", F.explode(lacks).alias("column_name"))
    return out.union(missing.select("sensor_id", "version", "column_name", none, F.lit("default"), F.lit(0), F.lit("null")))


def _column(name: str) -> str:
    """A field's name as a column: own columns of the table and the empty name get a trailing underscore."""
    return f"{name}_" if name in _OWN or not name else name.replace("`", "'")


def _number(t: bytes, real: bool):
    if real:
        return float(t)
    try:
        return int(t)
    except ValueError:
        v = float(t)
        if v != int(v):
            raise ValueError("not a whole number") from None
        return int(v)


def _decoded(batches: Iterator[pa.RecordBatch], columns: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Records of several versions in the columns of the table, each version decoded at once."""
    numpy_of = {"double": np.float64, "bigint": np.int64, "decimal(20,0)": np.uint64}
    arrow_of = {"double": pa.float64(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}
    place = {c: k for k, c in enumerate(columns)}
    kinds_of = list(columns.values())
    for b in batches:
        n = len(b)
        values = [np.zeros(n, numpy_of[t]) for t in kinds_of]
        there = [np.zeros(n, bool) for _ in kinds_of]
        bad = np.zeros(n, bool)
        pay = b.column("payload").to_pylist()
        keys = list(zip(b.column("sensor_id").to_pylist(), b.column("version").to_pylist(), b.column("storage").to_pylist(), strict=True))
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            groups.setdefault(k, []).append(i)
        for (_, _, storage), rows in groups.items():
            target, kinds = [], []
            for x in b.column("route")[rows[0]].as_py():
                many = max(1, x["count"] or 1)
                for k in range(many):
                    target.append(place[f"{x['column_name']}_{k}" if many > 1 else x["column_name"]])
                    kinds.append((x["type"], x["size"]))
            at = np.array(rows)
            if storage == "ascii":
                whole = [t in ("I", "U") for t, _ in kinds]
                for i in rows:
                    try:
                        v = [_number(t, not w) for t, w in zip((pay[i] or b"").split(), whole, strict=True)]
                        for t, x in zip(target, v, strict=True):
                            values[t][i] = x
                            there[t][i] = True
                    except (ValueError, OverflowError):
                        bad[i] = True
                        for t in target:
                            there[t][i] = False
            elif storage == "binary" and all(k in _CODES for k in kinds):
                dt = np.dtype({"names": [str(k) for k in range(len(kinds))], "formats": [_CODES[k] for k in kinds]})
                good = np.array([i for i in rows if pay[i] is not None and len(pay[i]) >= dt.itemsize], np.int64)
                bad[at] = True
                bad[good] = False
                v = np.frombuffer(b"".join(pay[i][: dt.itemsize] for i in good), dt)
                for k, t in enumerate(target):
                    values[t][good] = v[str(k)]
                    there[t][good] = True
            else:
                bad[at] = True
        cols = []
        for t, v, ok in zip(kinds_of, values, there, strict=True):
            if t == "decimal(20,0)":
                cols.append(pa.array([int(x) if o else None for x, o in zip(v, ok, strict=True)], arrow_of[t]))
            else:
                cols.append(pa.array(v, arrow_of[t], mask=~ok))
        yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("rec_no"), b.column("sensor_id"), pa.array(bad), *cols], names=["file_id", "rec_no", "sensor_id", "corrupt", *columns])


def one_table(headers: DataFrame, body: DataFrame) -> DataFrame:
    """All records in one set of columns: ``(file_id, rec_no, sensor_id, corrupt, <columns>)``.

    Every field goes through the rules of ``migrations`` for its file's version (``name_0, name_1, ...`` where its count is
    above 1). Whole numbers stay whole numbers unless some version has the field as F. A measured NaN stays NaN; null is a
    field that the file does not have. A repeated record (file_id, rec_no) counts once; stray line ends and bytes after the
    record are dropped; a record that doesn't fit its layout is kept with ``corrupt`` true and null values; records of
    unusable headers are left out.
    """
    h = cut(history(headers))
    routes = cut(_routes(h))
    columns = _columns(routes)
    route = routes.groupBy("sensor_id", "version").agg(F.collect_list(F.struct("field_name", "column_name")).alias("routes"))
    f = h.join(route, ["sensor_id", "version"])
    to = lambda x: F.element_at(F.filter("routes", lambda r: r["field_name"] == x["name"]), 1)["column_name"]
    place = F.transform("layout", lambda x: F.struct(to(x).alias("column_name"), x["type"].alias("type"), x["size"].alias("size"), x["count"].alias("count")))
    f = f.select("file_id", "sensor_id", "version", "storage", place.alias("route"))
    b = body.where("file_id IS NOT NULL AND rec_no IS NOT NULL").groupBy("file_id", "rec_no").agg(F.min("payload").alias("payload"))
    quoted = lambda c: f"`{c}`"
    schema = ", ".join(["file_id long", "rec_no int", "sensor_id long", "corrupt boolean", *(f"{quoted(c)} {t}" for c, t in columns.items())])
    rows = b.join(f, "file_id").select(F.col("file_id").cast("long"), F.col("rec_no").cast("int"), F.col("sensor_id").cast("long"), "version", "storage", "route", "payload")
    return rows.mapInArrow(lambda it: _decoded(it, columns), schema)
