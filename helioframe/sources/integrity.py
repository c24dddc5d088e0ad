"""Digest check of raw files against a published manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.sources.files import scheme

# Hex length of each digest.
MD5_LENGTH, SHA1_LENGTH, SHA256_LENGTH = 32, 40, 64
# A row of content costs a task about three times its bytes; local files above this size are read in pieces.
LOCAL_WHOLE = 16 << 20

_DIGESTS = pa.schema([(name, pa.string()) for name in ("path", "algo", "actual")])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, expected)`` from a data package description (``resources[].path/hash``)."""
    package = spark.read.option("multiLine", True).json(path)
    return package.select(F.inline("resources")).select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.coalesce(F.col("hash"), F.lit("")).alias("expected"),
    )


def _streamed_digests(piece: int):
    """Digests of files read piece by piece, for a task that is given their paths and algorithms."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = row["path"]
                if path.startswith("file:"):
                    system, name = pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
                else:
                    system, name = pafs.FileSystem.from_uri(path)
                digest = hashlib.new(row["algo"])
                with system.open_input_stream(name) as stream:
                    while part := stream.read(piece):
                        digest.update(part)
                yield pa.RecordBatch.from_pylist([{**row, "actual": digest.hexdigest()}], _DIGESTS)

    return digests


def _name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, length, file)`` of each file found under ``paths``; no content is read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", _name().alias("file"))


def file_digests(
    spark: SparkSession,
    paths: str | list[str],
    wanted: DataFrame,
    whole_limit: int = 256 << 20,
    piece: int = 8 << 20,
) -> DataFrame:
    """``(path, algo, actual)`` for each distinct path and algorithm of ``wanted``, which names files found under ``paths``.

    Files of up to ``whole_limit`` bytes (local ones of up to ``LOCAL_WHOLE``) are read by Spark, a row each. A larger
    one is read in its task by pieces of ``piece`` bytes, so its size is not limited; its storage must be one that
    pyarrow opens by URI (local files, HDFS, S3, GCS). Files are hashed in parallel.
    """
    if all(scheme(spark, path) == "file" for path in ([paths] if isinstance(paths, str) else paths)):
        whole_limit = min(whole_limit, LOCAL_WHOLE)
    wanted = wanted.where("algo IS NOT NULL").select("path", "algo").distinct()
    found = spark.read.format("binaryFile").load(paths)
    # The length is compared in the scan, so no content of a large file is read. What leaves the scan are digests: content
    # is neither joined nor shuffled.
    whole = (
        found.where(F.col("length") <= whole_limit)
        .select("path", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))
        .join(wanted, "path")
        .select("path", "algo", F.coalesce(*(F.when(F.col("algo") == a, F.col(a)) for a in ("md5", "sha1", "sha256"))).alias("actual"))
        .dropDuplicates(["path", "algo"])
    )
    large = found.where(F.col("length") > whole_limit).select("path").distinct().join(wanted, "path")
    # A given number of partitions, or a few paths would be put into one task for their small size.
    dealt = large.repartition(spark.sparkContext.defaultParallelism, "path")
    return whole.unionByName(dealt.mapInArrow(_streamed_digests(piece), "path string, algo string, actual string"))


def verify_files(
    spark: SparkSession,
    paths: str | list[str],
    manifest: DataFrame,
    whole_limit: int = 256 << 20,
    piece: int = 8 << 20,
) -> DataFrame:
    """``(path, algo, expected, actual, status)`` for each file found under ``paths``.

    ``manifest`` has ``expected`` by ``file``, the last part of a path, or by ``path`` if it has that column (files of
    several folders may share a name). The algorithm follows from the length of the published digest. Status is
    ``verified``, ``mismatch``, or ``skipped`` for a file without a usable digest. For the limits see ``file_digests``.
    """
    key = "path" if "path" in manifest.columns else "file"
    length = F.length("expected")
    algo = (
        F.when(length == MD5_LENGTH, "md5")
        .when(length == SHA1_LENGTH, "sha1")
        .when(length == SHA256_LENGTH, "sha256")
    )
    named = list_files(spark, paths).join(manifest.select(key, "expected"), key, "left").select("path", algo.alias("algo"), "expected")
    digests = file_digests(spark, paths, named, whole_limit, piece)
    status = (
        F.when(F.col("actual").isNull(), "skipped")
        .when(F.lower("actual") == F.lower("expected"), "verified")
        .otherwise("mismatch")
    )
    checked = named.join(digests, ["path", "algo"], "left").select("path", "algo", "expected", "actual")
    return checked.withColumn("status", status)
