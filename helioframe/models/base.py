"""The forecaster contract."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions.exprs import clip
from helioframe.schema import TALL, Axis


class Forecaster(ABC):
    """``fit`` learns from a training frame, ``transform`` adds a prediction for every row.

    Subclass and implement both to add a forecaster. The target column may be NULL in the
    frame given to ``transform``.
    """

    name: str = "abstract"
    feature_cols: tuple[str, ...] | None = None

    def __init__(self, target: str = "cf", axis: Axis = TALL):
        self.target = target
        self.axis = axis

    @abstractmethod
    def fit(self, df: DataFrame) -> Forecaster:
        """Learn from training rows; returns self."""

    @abstractmethod
    def transform(self, df: DataFrame, output: str = "pred") -> DataFrame:
        """All rows of ``df`` with ``output`` added."""

    def predict(self, df: DataFrame) -> DataFrame:
        """``(keys, ts, pred)`` for every row of ``df``."""
        return self.transform(df).select(*self.axis.columns, "pred")

    def release(self) -> None:
        """Free what ``fit`` keeps cached."""

    def params(self) -> dict[str, Any]:
        return {"model_class": type(self).__name__}

    def _require(self, state: Any) -> Any:
        if state is None:
            raise RuntimeError(f"{self.name}: fit() must run before transform()")
        return state


def unit_interval(x: Column) -> Column:
    """A prediction bounded to the physical range of a capacity factor."""
    return clip(x, 0.0, 1.0)


def linear_combination(features: list[str], weights: list[float], intercept: float) -> Column:
    """Weighted sum; NULL as soon as one feature is."""
    total = F.lit(float(intercept))
    for feature, weight in zip(features, weights, strict=True):
        total = total + F.lit(float(weight)) * F.col(feature)
    return total
