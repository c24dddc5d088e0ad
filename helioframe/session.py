"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "helioframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ANSI mode stays on (its Spark 4 default); the time zone is pinned because the engine
    stores UTC wall-clock time as TIMESTAMP_NTZ.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Call sites in error messages cost a stack walk per column expression.
        "spark.sql.dataFrameQueryContext.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that cuts long lineages, as named by ``spark.checkpoint.dir``; the same rule on every master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read again by whatever follows: written to the checkpoint folder where the session names
    one, so that a lost executor costs nothing, else kept in memory and on disk."""
    if df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables that are written and read again. Only a session on one machine
    may do without a folder in ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="helioframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
