"""Fit, apply and score a ladder of forecasters on one feature table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.models.base import Forecaster
from helioframe.models.linear import LinearPhysics, LinearWeather
from helioframe.models.simple import (
    DailySeasonalNaive,
    HourOfYearClimatology,
    Persistence,
    PurePhysics,
)
from helioframe.models.trees import FEATURE_SETS, BoostedTrees
from helioframe.operators.lags import lag_name
from helioframe.operators.scoring import (
    Metrics,
    add_skill,
    evaluate,
    long_predictions,
    score_predictions,
)
from helioframe.schema import (
    CALENDAR_COLUMNS,
    DEFAULT_LAGS,
    PHYSICS_FEATURES,
    TALL,
    WEATHER_FEATURES,
    Axis,
    Split,
)
from helioframe.session import stored
from helioframe.sources.run_store import append_run, describe_models, importance_rows, run_metrics

SCORED_SPLITS = ("train", "val")


def feature_names(features: Sequence[str], target: str = "cf", prefix: str = "") -> list[str]:
    """Tall feature names in a layout whose columns carry ``prefix`` (``DE_``): lags are named
    after the target, calendar columns belong to no series."""
    lags = {lag_name("cf", k): lag_name(target, k) for k in DEFAULT_LAGS}
    return [f if f in CALENDAR_COLUMNS else lags.get(f, f"{prefix}{f}") for f in features]


def baseline_models(
    split: Split | None = None, target: str = "cf", axis: Axis = TALL, prefix: str = ""
) -> list[Forecaster]:
    """The six forecasters without trees, in report order; ``prefix`` is that of a wide frame."""
    s = split or Split()
    return [
        Persistence(target, axis, s),
        DailySeasonalNaive(target, axis, s),
        HourOfYearClimatology(target, axis),
        LinearWeather(target, feature_names(WEATHER_FEATURES, target, prefix), axis),
        PurePhysics(f"{prefix}cf_theory", target, axis),
        LinearPhysics(target, feature_names(PHYSICS_FEATURES, target, prefix), axis),
    ]


def default_models(
    split: Split | None = None,
    target: str = "cf",
    axis: Axis = TALL,
    prefix: str = "",
    **trees: Any,
) -> list[Forecaster]:
    """All nine forecasters; ``trees`` overrides the parameters of the boosted ones."""
    boosted = [
        BoostedTrees(target, feature_names(features, target, prefix), axis=axis, name=name, **trees)
        for name, features in FEATURE_SETS.items()
    ]
    return [*baseline_models(split, target, axis, prefix), *boosted]


@dataclass
class Comparison:
    """Outcome of a run. The frames are lazy; ``release`` frees what they read from cache."""

    models: list[Forecaster]
    predictions: DataFrame
    scores: DataFrame
    cached: DataFrame

    def metrics(self, run_id: str) -> DataFrame:
        described = describe_models(self.scores.sparkSession, self.models)
        return run_metrics(self.scores, described, run_id)

    def importance(self) -> DataFrame:
        return importance_rows(self.scores.sparkSession, self.models)

    def save(self, folder: str, run_id: str) -> None:
        append_run(folder, self.metrics(run_id), self.importance(), run_id)

    def release(self) -> None:
        self.cached.unpersist()
        for model in self.models:
            model.release()


def predict_all(
    features: DataFrame, models: Sequence[Forecaster], target: str = "cf", axis: Axis = TALL
) -> DataFrame:
    """Predictions of fitted models as one long table, from a single pass over the features."""
    frame, columns = features, {}
    for i, model in enumerate(models):
        columns[model.name] = f"__pred_{i}"
        frame = model.transform(frame, columns[model.name])
    return long_predictions(frame, columns, target, axis)


def compare_models(
    features: DataFrame,
    models: Sequence[Forecaster],
    target: str = "cf",
    axis: Axis = TALL,
    baseline: str = "persistence",
) -> Comparison:
    """Fit on ``train``, score on ``train`` and ``val``; ``test`` rows are never read.

    ``features`` carries a ``split`` label and the lag columns. It is computed once and stored, because each
    fitted model reads it.
    """
    names = [m.name for m in models]
    if len(set(names)) != len(names):
        raise ValueError(f"model names must be unique, got {names}")
    opened = features.where(F.col("split").isin(*SCORED_SPLITS))
    cached = stored(opened)
    train = cached.where(F.col("split") == "train")
    for model in models:
        model.fit(train)
    predictions = predict_all(cached, models, target, axis)
    scores = add_skill(score_predictions(predictions), baseline)
    return Comparison(list(models), predictions, scores, cached)


def run_one(
    model: Forecaster, train: DataFrame, val: DataFrame, target: str = "cf"
) -> tuple[Metrics, Metrics]:
    """Fit one forecaster on ``train`` and score it on both frames."""
    model.fit(train)
    return (
        evaluate(model.transform(train), truth=target),
        evaluate(model.transform(val), truth=target),
    )
