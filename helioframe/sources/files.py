"""Existence checks and schemes through the Hadoop file system, so that any storage works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(target))


def scheme(spark: SparkSession, path: str) -> str:
    """``file`` for a path on local storage, else the scheme of its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme()


def join_path(folder: str, *parts: str) -> str:
    return "/".join([str(folder).rstrip("/"), *parts])
