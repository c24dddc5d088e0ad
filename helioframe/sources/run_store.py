"""Results of model runs as parquet tables, with a folder per run and model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.models.base import Forecaster
from helioframe.sources.files import join_path

RUN_METRICS = "run_metrics"
FEATURE_IMPORTANCE = "feature_importance"

_MODEL_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("features", T.ArrayType(T.StringType())),
    ]
)
_IMPORTANCE_SCHEMA = "model string, feature string, importance double"

# The stored tables. Given on reading, so that a run_id like 2024-06-01 stays a text.
_METRICS_TABLE = (
    "run_id string, position int, model string, split string, rmse double, mae double, n bigint, "
    "skill double, params map<string,string>, features array<string>, n_features int, "
    "others map<string,double>"
)
_IMPORTANCE_TABLE = f"{_IMPORTANCE_SCHEMA}, run_id string"


def describe_models(spark: SparkSession, models: Sequence[Forecaster]) -> DataFrame:
    """Position, parameters (as text) and features of each model."""
    rows = [
        (
            i,
            m.name,
            {k: str(v) for k, v in m.params().items()},
            list(m.feature_cols) if m.feature_cols else None,
        )
        for i, m in enumerate(models)
    ]
    return spark.createDataFrame(rows, _MODEL_SCHEMA)


def importance_rows(spark: SparkSession, models: Sequence[Forecaster]) -> DataFrame:
    """``(model, feature, importance)`` of the models that have importances."""
    rows = [
        (m.name, feature, value)
        for m in models
        for feature, value in (getattr(m, "feature_importance", None) or {}).items()
    ]
    return spark.createDataFrame(rows, _IMPORTANCE_SCHEMA)


def run_metrics(scores: DataFrame, described: DataFrame, run_id: str) -> DataFrame:
    """One row per model and split of a run."""
    return scores.join(F.broadcast(described), "model", "left").select(
        F.lit(run_id).alias("run_id"),
        "position",
        "model",
        "split",
        "rmse",
        "mae",
        "n",
        "skill",
        "params",
        "features",
        F.size("features").alias("n_features"),
        F.lit(None).cast("map<string,double>").alias("others"),
    )


def append_run(
    folder: str, metrics: DataFrame, importance: DataFrame | None = None, run_id: str | None = None
) -> None:
    """Add a run to the tables under ``folder``; a model's earlier results of the same run are replaced."""
    _put(metrics, join_path(folder, RUN_METRICS))
    if importance is not None:
        _put(importance.withColumn("run_id", F.lit(run_id)), join_path(folder, FEATURE_IMPORTANCE))


def _put(rows: DataFrame, path: str) -> None:
    """Write the few rows of a run to a folder per run and model, in place of what these folders held."""
    (
        rows.coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "model")
        .parquet(path)
    )


def log_model_run(
    spark: SparkSession,
    folder: str,
    run_id: str,
    model_name: str,
    params: Mapping[str, Any],
    metrics: Mapping[str, float],
    feature_cols: Sequence[str] | None = None,
    feature_importance: Mapping[str, float] | None = None,
) -> None:
    """Add one model's results given as plain values, e.g. of an outside forecaster.

    Metrics keyed ``{split}_{rmse|mae}``, ``n_{split}`` and ``skill_vs_persistence`` fill a row per split that has an
    rmse. All others are kept by name in ``others``, in a row without a split.
    """
    splits = sorted({k.removesuffix("_rmse") for k in metrics if k.endswith("_rmse")})
    named = {key for s in splits for key in (f"{s}_rmse", f"{s}_mae", f"n_{s}")}
    if "val" in splits:
        named.add("skill_vs_persistence")
    others = {k: float(v) for k, v in metrics.items() if k not in named}
    about = (
        {k: str(v) for k, v in params.items()},
        list(feature_cols) if feature_cols else None,
        len(feature_cols) if feature_cols else None,
    )
    rows = [
        (
            run_id,
            None,
            model_name,
            s,
            float(metrics[f"{s}_rmse"]),
            float(metrics[f"{s}_mae"]) if f"{s}_mae" in metrics else None,
            int(metrics[f"n_{s}"]) if f"n_{s}" in metrics else None,
            metrics.get("skill_vs_persistence") if s == "val" else None,
            *about,
            None,
        )
        for s in splits
    ]
    if others or not rows:
        rows.append((run_id, None, model_name, None, None, None, None, None, *about, others))
    importance = None
    if feature_importance is not None:
        importance = spark.createDataFrame(
            [(model_name, k, float(v)) for k, v in feature_importance.items()], _IMPORTANCE_SCHEMA
        )
    append_run(folder, spark.createDataFrame(rows, _METRICS_TABLE), importance, run_id)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_METRICS_TABLE).parquet(join_path(folder, RUN_METRICS))


def read_importance(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    """Feature importances, largest first within each run and model."""
    table = spark.read.schema(_IMPORTANCE_TABLE).parquet(join_path(folder, FEATURE_IMPORTANCE))
    if run_id is not None:
        table = table.where(F.col("run_id") == run_id)
    return table.orderBy("run_id", "model", F.desc("importance"))


def results_summary(runs: DataFrame, run_id: str | None = None, split: str = "val") -> DataFrame:
    """Errors, skill and n of each model on the validation split, in model order."""
    table = runs.where(F.col("split") == split)
    if run_id is not None:
        table = table.where(F.col("run_id") == run_id)
    return table.orderBy("run_id", "position").select(
        "model",
        F.col("rmse").alias("val_rmse"),
        F.col("mae").alias("val_mae"),
        "skill",
        "n",
    )
