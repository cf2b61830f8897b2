"""Files and folders by Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    system, at = _at(spark, path)
    return system.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    system, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(at)) if system.exists(at) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    system, at = _at(spark, path)
    return system.getContentSummary(at).getLength() if system.exists(at) else 0
