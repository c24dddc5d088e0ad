"""Least-squares forecasters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.models.base import Forecaster, linear_combination, unit_interval
from helioframe.schema import PHYSICS_FEATURES, TALL, WEATHER_FEATURES, Axis

# Directions with less than this share of the standardised variance count as collinear.
_RANK_TOLERANCE = 1e-11


class LinearWeather(Forecaster):
    """Ordinary least squares with intercept on complete rows, predictions in [0, 1].

    Fitting is one aggregate over the training rows: means and covariances of the features
    and the target, merged from partial aggregates. Only that small matrix reaches the
    driver, which solves it with the least-norm solution where features are collinear.
    Predicting is arithmetic on columns, so a missing feature gives NULL.
    """

    name = "linear_weather"

    def __init__(
        self,
        target: str = "cf",
        feature_cols: Sequence[str] = WEATHER_FEATURES,
        axis: Axis = TALL,
    ):
        super().__init__(target, axis)
        self.feature_cols = tuple(feature_cols)
        self.coefficients: list[float] | None = None
        self.intercept: float | None = None

    def fit(self, df: DataFrame) -> LinearWeather:
        names = [*self.feature_cols, self.target]
        size = len(names)
        # Incomplete rows are blanked out, not filtered: a filter on derived features would
        # be pushed below them and compute every feature twice.
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
        rows = df.select(*names, complete.alias("__complete")).select(
            *[F.when(F.col("__complete"), F.col(c).cast("double")).alias(c) for c in names]
        )
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        moments = rows.agg(
            F.count(self.target).alias("n"),
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
            *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
        ).first()
        if not moments["n"]:
            raise ValueError(f"{self.name}: no training row has the target and all features")
        mean = np.array([moments[f"m{i}"] for i in range(size)])
        cov = np.zeros((size, size))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = moments[f"c{i}_{j}"]
        spread = np.sqrt(np.diag(cov))
        spread[spread == 0] = 1.0
        scaled = cov / np.outer(spread, spread)
        slopes = np.linalg.pinv(scaled[:-1, :-1], rcond=_RANK_TOLERANCE, hermitian=True)
        weights = slopes @ scaled[:-1, -1] * spread[-1] / spread[:-1]
        self.coefficients = [float(w) for w in weights]
        self.intercept = float(mean[-1] - weights @ mean[:-1])
        return self

    def transform(self, df: DataFrame, output: str = "pred") -> DataFrame:
        weights = self._require(self.coefficients)
        total = linear_combination(list(self.feature_cols), weights, self.intercept)
        return df.withColumn("__linear", total).withColumn(
            output, unit_interval(F.col("__linear"))
        ).drop("__linear")


class LinearPhysics(LinearWeather):
    """The same regression on weather and physics columns together.

    Cell temperature is a linear function of two other features, so coefficients are not
    unique; predictions are.
    """

    name = "linear_physics"

    def __init__(
        self,
        target: str = "cf",
        feature_cols: Sequence[str] = PHYSICS_FEATURES,
        axis: Axis = TALL,
    ):
        super().__init__(target, feature_cols, axis)
