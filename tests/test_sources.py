import struct

import numpy as np
import pytest

from pointspark.sources import clouds
from pointspark.streaming import stateless


def test_txt(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_bytes(b"1,2,3\n\n4 5 6 7 8\r\n 7\t8  9\nbad,line\n1e-3,-2.5E1,+3\n")
    r = clouds.read_txt_xyz(spark, str(f)).orderBy("idx").collect()
    assert [(x["idx"], x["x"], x["y"], x["z"]) for x in r] == [(0, 1, 2, 3), (1, 4, 5, 6), (2, 7, 8, 9), (3, None, None, None), (4, 0.001, -25.0, 3.0)]
    assert r[3]["corrupt"] == "bad,line" and r[0]["label"] == -1 and r[0]["intensity"] == 1.0
    assert clouds.read_txt_xyz(spark, str(f), "DROPMALFORMED").count() == 4
    with pytest.raises(Exception, match="not a point"):
        clouds.read_txt_xyz(spark, str(f), "FAILFAST").collect()
    with pytest.raises(Exception):
        clouds.read_txt_xyz(spark, str(tmp_path / "missing.txt")).collect()
    (tmp_path / "e").mkdir()
    (tmp_path / "e/empty.txt").write_text("")
    assert clouds.read_txt_xyz(spark, str(tmp_path / "e")).count() == 0


def test_txt_in_many_splits_keeps_file_order(spark, tmp_path):
    f = tmp_path / "big.txt"
    f.write_text("".join(f"{i},0,0\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        p = clouds.read_txt_xyz(spark, str(f))
        assert p.count() == 20000 and p.where("idx <> x").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_txt_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1.25, -2.0, 3.1234567)], "x double, y double, z double")
    clouds.write_txt(p, str(tmp_path / "o"))
    r = clouds.read_txt_xyz(spark, str(tmp_path / "o")).first()
    assert (r["x"], r["y"], r["z"]) == (1.25, -2.0, 3.123457)


def test_pcd(spark, tmp_path):
    head = "# c\nVERSION .7\nFIELDS x y z intensity label\nSIZE 4 4 4 4 1\nTYPE F F F F U\nCOUNT 1 1 1 1 1\nWIDTH 2\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\n"
    (tmp_path / "a.pcd").write_text(head + "POINTS 2\nDATA ascii\n1 2 3 0.5 7\n4 5 6 0.25 8\n")
    (tmp_path / "b.pcd").write_bytes((head + "DATA binary\n").encode() + struct.pack("<ffffB", 1, 2, 3, 0.5, 7) + struct.pack("<ffffB", 4, 5, 6, 0.25, 8))
    (tmp_path / "c.pcd").write_text("FIELDS x rgb\nDATA ascii\n")
    p = clouds.read_pcd(spark, str(tmp_path)).orderBy("path", "idx").collect()
    assert [(r["x"], r["intensity"], r["label"]) for r in p] == [(1, 0.5, 7), (4, 0.25, 8)] * 2
    h = {r["path"][-5]: r for r in clouds.pcd_headers(spark, str(tmp_path)).collect()}
    assert h["b"]["points"] == 2 and h["a"]["valid"] and not h["c"]["valid"] and h["c"]["has_rgb"]


def test_bin(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(np.arange(8, dtype="<f4").tobytes() + b"xx")
    assert [(r["x"], r["intensity"]) for r in clouds.read_bin(spark, str(tmp_path / "f.bin")).collect()] == [(0, 3), (4, 7)]


def test_off(spark, tmp_path):
    d = tmp_path / "in/cube/train"
    d.mkdir(parents=True)
    (d / "a.off").write_text("OFF4 2 0\n0 0 0\n2 0 0\n2 1 0\n0 1 0\n3 0 1 2\n3 0 2 3\n")
    (d / "b.off").write_text("OFF\n4 2 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n3 1 1 1\n")
    v, f = clouds.read_off(spark, str(tmp_path / "in"))
    assert v.count() == 8 and f.count() == 5 - 0
    p = clouds.off_to_points(spark, str(tmp_path / "in"), str(tmp_path / "out")).toPandas()
    assert p.groupby("mesh").size().tolist() == [256, 256]
    a = p[p.mesh.str.endswith("a.off")]
    assert a.x.between(0, 2).all() and a.y.between(0, 1).all() and (a.z == 0).all() and abs(a.x.mean() - 1) < 0.1
    assert spark.read.text(str(tmp_path / "out")).count() == 512
    assert clouds.list_files(spark, str(tmp_path / "in")).select("class", "split", "name").distinct().count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.txt").write_text("0.1,0.2,0.3\nbad\n")
    s = stateless.moved_voxels(stateless.txt_stream(spark, str(tmp_path / "s")).where("ok"), np.eye(4), (0, 1, 0, 1, 0, 1), 0.5)
    q = s.writeStream.format("memory").queryName("vox").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("vox").first()["voxel_id"] == 0
