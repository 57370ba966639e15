"""Session helpers: a local session for tests and lineage cuts through the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast by hand only below this many rows, counted first.
BROADCAST_ROWS = 20_000


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pointspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("POINTSPARK_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (tests on one machine) a temporary folder is set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        d = spark.conf.get("pointspark.shared.dir", None)
        if not d:
            d = tempfile.mkdtemp(prefix="pointspark-")
            atexit.register(shutil.rmtree, d, ignore_errors=True)
            d = f"file://{d}"
            spark.conf.set("pointspark.shared.dir", d)
    return d.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it again.

    This ends the lineage, keeps later stages from recomputing it, and survives the loss of
    executors, as the files lie outside them. Empty frames keep their schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
