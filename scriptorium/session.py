"""Helpers about the session: tables, shipped code and the shared folder."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from contextlib import suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="scriptorium-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="scriptorium-ckpt-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new place in the shared folder, under one folder for the application, which is removed when it ends."""
    own = f"{checkpoint_dir(spark)}/scriptorium-{spark.sparkContext.applicationId}"
    _removed_at_exit(spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _removed_at_exit(spark: SparkSession, path: str) -> None:
    """Results are lazy, so what they read from stays until the driver's Python ends; one that is killed leaves it."""
    if path in _scratch:
        return
    _scratch.add(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()

    def gone() -> None:
        with suppress(Exception):  # the JVM may have ended before
            at.getFileSystem(conf).delete(at, True)

    atexit.register(gone)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, with its lineage cut."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    _removed_at_exit(spark, spark.sparkContext.getCheckpointDir())  # a folder of this application's own
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Spark removes the shuffle files of what was cut once the JVM collects what refers to them; this asks it to, between steps."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: smaller than a checkpoint, and lineage is cut."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
