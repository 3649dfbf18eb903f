"""Session defaults and cutting of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("caseloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session: Python workers then need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_caseloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="caseloom-"), "caseloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)  # the driver serves it from here, until it ends
    atexit.register(shutil.rmtree, os.path.dirname(archive), ignore_errors=True)
    sc._caseloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; set one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "caseloom-checkpoints")
    sc.setCheckpointDir(folder)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, to be deleted by `release_tables` or when the session ends."""
    ensure_checkpoint_dir(spark)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    path = f"{sc.getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc.hadoopConfiguration()).deleteOnExit(where)
    if not hasattr(spark.sparkContext, "_caseloom_tables"):
        spark.sparkContext._caseloom_tables = []
    spark.sparkContext._caseloom_tables.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df once, as a table in the shared checkpoint folder, and go on from there: it isn't computed twice and survives
    lost executors. A compressed columnar table takes a fraction of what checkpoint() writes. It is there until
    `release_tables`, or until the session ends."""
    path = shared_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> int:
    """Delete what was written to shared paths so far; how many there were. To be called between queries whose results are
    stored: a frame that still reads such a table fails afterwards."""
    sc = spark.sparkContext
    paths, sc._caseloom_tables = getattr(sc, "_caseloom_tables", []), []
    for path in paths:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.sc().hadoopConfiguration()).delete(where, True)
    return len(paths)
