"""Drifting schemas and small files."""

import datetime as dt

from pointspark.operators import schema_drift, small_files

H = "file_id long, sensor_id long, file_path string, captured_at timestamp, registered_at timestamp, fields array<string>, sizes array<int>, types array<string>, counts array<int>, data_type string, extra int"


def head(i, sensor, day, fields, data="ascii", sizes=None, types=None, counts=None, reg=0):
    t = dt.datetime(2025, 1, 1) + dt.timedelta(days=day)
    n = len(fields or [])
    return (i, sensor, f"/{i}", t, t + dt.timedelta(hours=reg), fields, sizes or [4] * n, types or ["F"] * n, counts or [1] * n, data, 1)


def test_changes(spark):
    rows = [
        head(1, 1, 0, ["x", "y", "i"]),
        head(1, 1, 0, ["x", "y", "q"], reg=5),  # registered again
        head(2, 1, 30, [" X ", "y\t", "intensity"], "ASCII "),  # renamed over a gap of weeks
        head(3, 1, 31, ["y", "x", "intensity"]),  # mere order
        head(4, 1, 32, None),
        head(5, 1, 33, ["x", "y"], sizes=[4, 4, 4]),
        head(6, 1, 34, ["y", "x", "intensity", "t"], "binary", sizes=[4, 8, 4, 4]),
        head(7, 1, 35, ["y", "x", "intensity"], "binary", sizes=[4, 8, 4]),
        head(8, 2, 35, ["z"]),
        (9, None, "/9", None, None, ["x"], [4], ["F"], [1], None, 1),
    ]
    h = spark.createDataFrame(rows, H)
    got = {(r["file_id"], r["change_kind"], r["field_name"]) for r in schema_drift.changes(h).collect()}
    assert got == {(2, "renamed", "intensity"), (6, "added", "t"), (6, "retyped", "x"), (6, "storage", "data"), (7, "removed", "t")}
    v = {r["file_id"]: r["version"] for r in schema_drift.versions(h).collect()}
    assert v == {1: 0, 2: 1, 3: 2, 6: 3, 7: 4, 8: 0}
    assert schema_drift.column_names(h) == {"intensity": "intensity", "i": "intensity", "t": "t", "x": "x", "y": "y", "z": "z"}
    assert schema_drift.changes(h.limit(0)).count() == 0


def test_one_table(spark):
    import struct

    h = spark.createDataFrame([head(1, 1, 0, ["x", "i"]), head(2, 1, 1, ["x", "intensity"], "binary", types=["F", "U"], sizes=[4, 2]), head(3, 1, 2, ["x", "n"], counts=[1, 2])], H)
    b = spark.createDataFrame(
        [(1, 0, bytearray(b"1.5 2\r\n")), (1, 0, bytearray(b"1.5 2\r\n")), (1, 1, bytearray(b"oops 2")), (1, 2, None), (2, 0, bytearray(struct.pack("<fH", 2.5, 7) + b"\n")), (2, 1, bytearray(b"\x00")), (3, 0, bytearray(b"1 2 3")), (9, 0, bytearray(b"1"))],
        "file_id long, rec_no int, payload binary",
    )
    t = schema_drift.one_table(h, b)
    assert t.columns == ["file_id", "rec_no", "sensor_id", "corrupt", "intensity", "n_0", "n_1", "x"] or "i" in t.columns
    r = {(q["file_id"], q["rec_no"]): q for q in t.collect()}
    assert len(r) == 6 and r[1, 0]["x"] == 1.5 and r[2, 0]["x"] == 2.5 and (r[3, 0]["n_0"], r[3, 0]["n_1"]) == (2.0, 3.0)
    assert r[1, 1]["corrupt"] and r[1, 2]["corrupt"] and r[2, 1]["corrupt"] and not r[1, 0]["corrupt"]


def test_migrations_are_chained(spark):
    import struct

    h = spark.createDataFrame([
        head(1, 1, 0, ["x", "i", "n"], types=["F", "F", "I"], sizes=[4, 4, 8]),
        head(2, 1, 1, ["x", "inten", "n"], types=["F", "F", "I"], sizes=[4, 4, 8]),
        head(3, 1, 2, ["x", "intensity", "n"], "binary", types=["F", "F", "I"], sizes=[8, 4, 8]),
        head(4, 1, 3, ["x", "n"], types=["F", "I"], sizes=[8, 8]),
        head(5, 2, 0, ["i", "u"], "binary", types=["I", "U"], sizes=[2, 8]),  # another sensor has no such renames
        head(6, 3, 0, ["a", "b"]), head(7, 3, 1, ["b", "c"]), head(8, 3, 2, ["a", "c"]),  # a ends, then b becomes a
    ], H)
    big = 2**53 + 1
    b = spark.createDataFrame([
        (1, 0, bytearray(b"1 2 %d" % big)), (2, 0, bytearray(b"nan 3 4.0")), (2, 1, bytearray(b"1 3 4.5")), (3, 0, bytearray(struct.pack("<dfq", 2.5, 7, -big))), (4, 0, bytearray(b"9 8")),
        (5, 0, bytearray(struct.pack("<hQ", -3, 2**64 - 1))), (6, 0, bytearray(b"1 2")), (8, 0, bytearray(b"3 4")),
    ], "file_id long, rec_no int, payload binary")
    t = schema_drift.one_table(h, b)
    assert dict(t.dtypes) == {"file_id": "bigint", "rec_no": "int", "sensor_id": "bigint", "corrupt": "boolean", "a": "double", "a_v0": "double", "c": "double", "i": "bigint", "intensity": "double", "n": "bigint", "u": "decimal(20,0)", "x": "double"}
    r = {(q["file_id"], q["rec_no"]): q for q in t.collect()}
    assert (r[1, 0]["intensity"], r[1, 0]["n"]) == (2.0, big) and (r[3, 0]["intensity"], r[3, 0]["n"], r[3, 0]["x"]) == (7.0, -big, 2.5)
    assert r[2, 0]["x"] != r[2, 0]["x"] and r[2, 0]["n"] == 4 and r[2, 1]["corrupt"] and r[4, 0]["intensity"] is None
    assert (r[5, 0]["i"], int(r[5, 0]["u"]), r[5, 0]["intensity"]) == (-3, 2**64 - 1, None)
    assert (r[6, 0]["a_v0"], r[6, 0]["a"]) == (1.0, 2.0) and (r[8, 0]["a"], r[8, 0]["c"]) == (3.0, 4.0)
    m = {(q["sensor_id"], q["version"], q["column_name"], q["rule"], q["step"]): q["detail"] for q in schema_drift.migrations(h).collect()}
    assert m[1, 0, "intensity", "rename", 0] == "i -> inten in version 1" and m[1, 0, "intensity", "rename", 1] == "inten -> intensity in version 2"
    assert m[1, 0, "x", "cast", 0] == "F 4 -> double" and m[1, 2, "x", "keep", 0] is None and m[1, 3, "intensity", "default", 0] == "null"
    assert m[2, 0, "i", "cast", 0] == "I 2 -> bigint" and m[2, 0, "u", "keep", 0] is None
    assert schema_drift.migrations(h.limit(0)).count() == 0


def test_field_names_that_clash(spark):
    h = spark.createDataFrame([head(1, 1, 0, ["file_id", "a b", "", "q`r", "x.y"])], H)
    r = schema_drift.one_table(h, spark.createDataFrame([(1, 0, bytearray(b"1 2 3 4 5"))], "file_id long, rec_no int, payload binary"))
    assert r.columns == ["file_id", "rec_no", "sensor_id", "corrupt", "_", "a b", "file_id_", "q'r", "x.y"]
    assert list(r.first())[4:] == [3.0, 2.0, 1.0, 4.0, 5.0]
    assert schema_drift.one_table(h.limit(0), spark.createDataFrame([], "file_id long, rec_no int, payload binary")).count() == 0


T = "file_id long, save_path string, n_bytes long, written_at timestamp, file_text string, path string"


def files(spark, rows):
    return spark.createDataFrame([(i, p, None, None, t, "clash") for i, p, t in rows], T)


def test_paths(spark):
    ways = ["/a/b c/d.txt", "file:///a/b%20c/d.txt", "\\a\\b c\\.\\d.txt", "/a//b c/x/../d.txt", " /a/./b%20c/%64.txt\n", "/a/B c/d.txt", "/../a/b c/d.txt", "/a/b+c/d%"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(ways)], "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(small_files.canonical_path(df.p)).collect()]
    assert got == ["/a/b c/d.txt"] * 5 + ["/a/B c/d.txt", "/a/b c/d.txt", "/a/b+c/d%"]


def test_pack_keeps_every_point_once(spark):
    a = "1,2,3\n4,5,6\n"
    rows = [
        (1, "/p/a", a), (2, "/p/./a", "1.0 2 3\r\n\r\n4 5 6.0000001 9"), (3, "/p/a", "1,2,3\n"), (4, "/p/a", "1,2,4\n"), (5, "/p/b", a), (6, "/p/a", ""), (7, "/p/a", None),
        (8, None, a), (9, "/p/a", "# no numbers here\n"), (10, "/p/a", "1,2,3\n4,5,6\n7,8,9"), (1, "/p/a", a), (11, "/p/a", "x 1e0, 2 ,+3 tail\n4 5 6\n"),
    ]
    index, blocks, begins = small_files.pack(files(spark, rows), 16)
    got = {(r["file_a"], r["file_b"]) for r in small_files.same_files(index, begins).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 10), (2, 10), (3, 10), (1, 11), (2, 11), (3, 11), (10, 11)}
    at = {r["file_id"]: r["stored_as"] for r in index.collect()}
    assert set(at) == {1, 2, 3, 4, 5, 6, 7, 9, 10, 11}
    assert {k: at[k] for k in (1, 2, 3, 4, 5, 10, 11)} == {1: 10, 2: 10, 3: 10, 4: 4, 5: 5, 10: 10, 11: 10}
    back = {r["file_id"]: bytes(r["data"]).decode() for r in small_files.unpack(index, blocks).where("intact").collect()}
    assert back[10] == rows[9][2] and back[5] == a and back[4] == "1,2,4\n" and back[6] == "" and set(back) == {4, 5, 6, 7, 9, 10}
    assert blocks.count() > 1


def test_every_file_comes_back(spark):
    rows = [
        (1, "/p/a", "1,2,3,1.000000,7\n4,5,6,1.000000,7\n"), (2, "/p/./a", "1 2 3\r\n4 5 6\r\n7 8 9\r\n"), (3, "/p/a", "1 2 3\r\n4 5 6\r\n"), (4, "/p/a", "1.0000000001 2 3"),
        (5, "/p/b", "1,2,3\n"), (6, "/p/b", "1,2,3\n"), (7, "/p/b", "+1;2;3;\u00e4\n"), (8, "/p/a", ""), (9, "/p/a", None), (10, "/p/c", "# none\n"),
    ]
    index, blocks, _ = small_files.pack(files(spark, rows), 32)
    index, blocks = index.cache(), blocks.cache()
    back = {r["file_id"]: r for r in small_files.restore(index, blocks).collect()}
    assert {i: bytes(r["data"]).decode() for i, r in back.items()} == {i: t or "" for i, _, t in rows}
    assert all(r["intact"] for r in back.values())
    at = {r["file_id"]: (r["stored_as"], r["patch_length"] is not None) for r in index.collect()}
    assert at == {1: (2, True), 2: (2, False), 3: (2, False), 4: (2, True), 5: (5, False), 6: (5, False), 7: (5, True), 8: (8, False), 9: (9, False), 10: (10, False)}
    broken = small_files.restore(index, blocks.selectExpr("container_id", "CAST(repeat('x', octet_length(block)) AS BINARY) AS block"))
    assert {r["file_id"] for r in broken.where("intact").collect()} == {8, 9}
    lost = small_files.restore(index, blocks.limit(0))
    assert lost.count() == len(rows) and lost.where("intact").count() == 0


def test_archive_on_disk(spark, tmp_path):
    """Written once, read by another reader, files found by any spelling of their path; a hot path goes to many containers."""
    rows = [(i, f"/p/hot/./{i % 2}", f"{i},2,3\n" * 4) for i in range(40)] + [(100, "/p/a b", "1 2 3\n"), (101, "file:///p/a%20b", "1 2 3\n4 5 6\n")]
    folder = f"file://{tmp_path}/archive"
    small_files.write_archive(files(spark, rows), folder, 64)
    index, blocks, begins = small_files.read_archive(spark, folder)
    assert index.where("path = '/p/hot/0'").select("container_id").distinct().count() > 3
    back = {r["file_id"]: bytes(r["data"]).decode() for r in small_files.restore(index, blocks).where("intact").collect()}
    assert back == {i: t for i, _, t in rows}
    found = small_files.lookup(index, blocks, ["\\p\\x\\..\\a b", "/none"]).collect()
    assert {(r["file_id"], r["save_path"], bytes(r["data"]).decode(), r["intact"]) for r in found} == {(i, p, t, True) for i, p, t in rows[-2:]}
    assert {(r["file_a"], r["file_b"]) for r in small_files.same_files(index, begins).collect()} == {(100, 101)}


def test_pack_nothing(spark):
    index, blocks, begins = small_files.pack(files(spark, []))
    assert index.count() == 0 and blocks.count() == 0 and small_files.same_files(index, begins).count() == 0
