"""The built dataset as parquet, kept per configuration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.schema import TALL, Axis, PreprocessConfig
from helioframe.sources.files import join_path, path_exists


def fingerprint(config: PreprocessConfig, **extra: Any) -> str:
    """Short digest of everything that decides the content of a dataset."""
    text = json.dumps({**asdict(config), **extra}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def dataset_path(folder: str, config: PreprocessConfig, **extra: Any) -> str:
    """Each configuration has a folder of its own, so a changed one never meets a stale file."""
    return join_path(folder, f"dataset-{fingerprint(config, **extra)}.parquet")


def _complete(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, join_path(path, "_SUCCESS"))


def write_dataset(
    df: DataFrame, path: str, axis: Axis = TALL, rows_per_file: int = 20_000_000
) -> None:
    """Snappy parquet in one folder per year, each file sorted by series and time.

    The number of files follows the volume: Spark merges small partitions and splits a large
    year, or one long series, by the size it has measured
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), and no file has more than
    ``rows_per_file`` rows. Sorting gives row groups narrow series bounds to skip by. (A folder
    per series would be one tiny file for each of possibly millions of series.)
    """
    (
        df.withColumn("year", F.year(axis.ts))
        .hint("rebalance", "year")
        .sortWithinPartitions("year", *axis.columns)
        .write.mode("overwrite")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("year")
        .parquet(path)
    )


def build_and_cache(
    spark: SparkSession,
    folder: str,
    build: Callable[[PreprocessConfig], DataFrame],
    config: PreprocessConfig | None = None,
    force: bool = False,
    axis: Axis = TALL,
    **extra: Any,
) -> str:
    """Path of the dataset for ``config``; built only if absent, unfinished or forced.

    ``extra`` names further inputs the content depends on, e.g. the raw folder.
    """
    config = config or PreprocessConfig()
    path = dataset_path(folder, config, **extra)
    if force or not _complete(spark, path):
        write_dataset(build(config), path, axis)
    return path


def load_dataset(
    spark: SparkSession, folder: str, config: PreprocessConfig | None = None, **extra: Any
) -> DataFrame:
    """The dataset stored for ``config``; ``FileNotFoundError`` if it was not built."""
    path = dataset_path(folder, config or PreprocessConfig(), **extra)
    if not _complete(spark, path):
        raise FileNotFoundError(f"no finished dataset at {path}; run build_and_cache first")
    return spark.read.parquet(path).drop("year")
