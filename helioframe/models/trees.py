"""Gradient-boosted trees on MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.models.base import Forecaster, unit_interval
from helioframe.operators.splits import mark_holdout
from helioframe.schema import (
    CALENDAR_COLUMNS,
    LAG_FEATURES,
    PHYSICS_FEATURES,
    TALL,
    WEATHER_FEATURES,
    Axis,
)
from helioframe.session import ensure_checkpoint_dir

# Below the range of every feature, so a split can set missing values apart.
_MISSING = -1.0e6

# Training rows that make a partition of their own.
ROWS_A_PART = 20_000

FEATURE_SETS = {
    "boosted_weather": WEATHER_FEATURES,
    "boosted_physics": PHYSICS_FEATURES,
    "boosted_lag": LAG_FEATURES,
}


def best_prefix(errors: Sequence[float], patience: int) -> int:
    """Number of rounds up to the lowest error seen before ``patience`` rounds without gain."""
    best, at = float("inf"), 0
    for i, error in enumerate(errors):
        if error < best:
            best, at = error, i
        elif i - at >= patience:
            break
    return at + 1


def exhausted(errors: Sequence[float], patience: int) -> bool:
    """Whether the error has not fallen below its lowest value for ``patience`` rounds."""
    return bool(errors) and len(errors) - best_prefix(errors, patience) >= patience


@dataclass(frozen=True)
class Ensemble:
    """Trees in the order in which they were grown; each adds ``rate`` times its prediction to ``start``."""

    start: float
    rate: float
    trees: tuple[RandomForestRegressionModel, ...]

    @property
    def getNumTrees(self) -> int:  # noqa: N802, the name that the library's ensembles have
        return len(self.trees)

    @property
    def treeWeights(self) -> list[float]:  # noqa: N802
        return [self.rate] * len(self.trees)

    def first(self, rounds: int) -> Ensemble:
        return Ensemble(self.start, self.rate, self.trees[:rounds])

    def predicted(self, df: DataFrame, output: str, features: str = "__x", at_once: int = 25) -> DataFrame:
        """``df`` with the sum of the trees; its plan holds the columns of a few trees at a time."""
        df = df.withColumn(output, F.lit(self.start))
        for first in range(0, len(self.trees), at_once):
            some = self.trees[first : first + at_once]
            names = [f"__t{i}" for i in range(len(some))]
            for tree, name in zip(some, names, strict=True):
                df = tree.copy({tree.featuresCol: features, tree.predictionCol: name}).transform(df)
            total = reduce(lambda a, b: a + b, map(F.col, names))
            df = df.withColumn(output, F.col(output) + self.rate * total).drop(*names)
        return df


class BoostedTrees(Forecaster):
    """Boosted regression trees with early stopping on the chronological tail.

    Trees are grown one after the other on what the ones before leave over, in blocks of ``block_rounds``. After a block
    the predictions so far are written to the checkpoint folder, which keeps the plan short and a lost executor cheap,
    and one aggregate gives the hold-out error after each of its rounds. Growing ends as soon as the error has not
    fallen for ``early_stopping_rounds``, and the trees up to the lowest error are kept.

    Rows without a target are left out of training; missing features are kept, marked by a
    value below the feature's range and by a flag of their own, so every row is predicted.
    Each tree is grown level by level from distributed histograms on a sample of the rows.
    """

    name = "boosted_trees"

    def __init__(
        self,
        target: str = "cf",
        feature_cols: Sequence[str] | None = None,
        n_estimators: int = 1000,
        learning_rate: float = 0.05,
        max_depth: int = 6,
        subsample: float = 0.8,
        feature_fraction: float = 0.8,
        early_stopping_rounds: int = 50,
        seed: int = 42,
        holdout_fraction: float = 0.1,
        max_bins: int = 256,
        block_rounds: int = 10,
        axis: Axis = TALL,
        name: str | None = None,
    ):
        super().__init__(target, axis)
        self.feature_cols = tuple(feature_cols) if feature_cols is not None else None
        self.n_estimators = n_estimators
        self.learning_rate = learning_rate
        self.max_depth = max_depth
        self.subsample = subsample
        self.feature_fraction = feature_fraction
        self.early_stopping_rounds = early_stopping_rounds
        self.seed = seed
        self.holdout_fraction = holdout_fraction
        self.max_bins = max_bins
        self.block_rounds = block_rounds
        self.name = name or self.name
        self.model: Ensemble | None = None
        self.rounds: int | None = None
        #: Mean squared error on the held-out tail after each round that was grown.
        self.errors: list[float] = []

    def params(self) -> dict[str, Any]:
        return {
            **super().params(),
            "n_estimators": self.n_estimators,
            "learning_rate": self.learning_rate,
            "max_depth": self.max_depth,
        }

    def _flagged(self) -> list[str]:
        return [c for c in self.feature_cols if c not in CALENDAR_COLUMNS]

    def _assemble(self, df: DataFrame) -> DataFrame:
        inputs: dict[str, Column] = {}
        for c in self.feature_cols:
            inputs[f"__f_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(_MISSING))
        for c in self._flagged():
            inputs[f"__m_{c}"] = F.col(c).isNull().cast("double")
        assembler = VectorAssembler(inputCols=list(inputs), outputCol="__x")
        return assembler.transform(df.withColumns(inputs)).drop(*inputs)

    def fit(self, df: DataFrame) -> BoostedTrees:
        if self.feature_cols is None:
            raise ValueError(f"{self.name} needs feature_cols")
        ensure_checkpoint_dir(df.sparkSession)
        columns = [*self.axis.columns, self.target, *self.feature_cols]
        # Read once; the cut-off and every round work on these rows. A round has a job per level, so that rows in more
        # partitions than their number asks for would cost most of its time.
        given = df.where(F.col(self.target).isNotNull()).select(*dict.fromkeys(columns)).checkpoint()
        some = -(-given.count() // ROWS_A_PART) or 1
        if some < given.rdd.getNumPartitions():
            given = given.repartition(some).checkpoint()
        marked = mark_holdout(given, self.target, self.holdout_fraction, self.axis, "__holdout")
        rows = self._assemble(marked).select("__x", F.col(self.target).cast("double").alias("__y"), "__holdout")
        start = rows.where("NOT __holdout").agg(F.avg("__y")).first()[0]
        if start is None:
            raise ValueError(f"{self.name} needs rows with a target before the held-out tail")
        rows, trees, self.errors = rows.withColumn("__sum", F.lit(start)), [], []
        while len(trees) < self.n_estimators and not exhausted(self.errors, self.early_stopping_rounds):
            rows, grown = self._grow(rows, len(trees), min(self.block_rounds, self.n_estimators - len(trees)))
            trees += grown
            rounds = [f"__sum{i}" for i in range(len(grown))]
            wrong = [F.avg((F.col("__y") - F.col(c)) ** 2) for c in rounds]
            self.errors += list(rows.where("__holdout").agg(*wrong).first())
            rows = rows.drop(*rounds)
        self.rounds = best_prefix(self.errors, self.early_stopping_rounds)
        self.model = Ensemble(start, self.learning_rate, tuple(trees)).first(self.rounds)
        return self

    def _grow(self, rows: DataFrame, grown: int, rounds: int) -> tuple[DataFrame, list[RandomForestRegressionModel]]:
        """``rounds`` more trees, and the written rows with the sum after each of them."""
        share = "all" if self.feature_fraction >= 1 else str(self.feature_fraction)
        trees = []
        for i in range(rounds):
            left = rows.where("NOT __holdout").select("__x", (F.col("__y") - F.col("__sum")).alias("__left"))
            # A forest of one tree: the library's way to sample rows and columns for a single tree.
            tree = RandomForestRegressor(
                featuresCol="__x",
                labelCol="__left",
                predictionCol="__tree",
                numTrees=1,
                bootstrap=False,
                maxDepth=self.max_depth,
                subsamplingRate=self.subsample,
                featureSubsetStrategy=share,
                maxBins=self.max_bins,
                seed=self.seed + grown + i,
            ).fit(left)
            trees.append(tree)
            reached = F.col("__sum") + self.learning_rate * F.col("__tree")
            rows = tree.transform(rows).withColumn(f"__sum{i}", reached).withColumn("__sum", F.col(f"__sum{i}")).drop("__tree")
        return rows.checkpoint(), trees

    def transform(self, df: DataFrame, output: str = "pred") -> DataFrame:
        predicted = self._require(self.model).predicted(self._assemble(df), "__y")
        return predicted.withColumn(output, unit_interval(F.col("__y"))).drop("__x", "__y")

    @property
    def feature_importance(self) -> dict[str, float] | None:
        """Share of impurity reduction per feature, its missing flag included; largest first."""
        if self.model is None:
            return None
        flagged = self._flagged()
        values = [0.0] * (len(self.feature_cols) + len(flagged))
        for tree in self.model.trees:
            for i, v in zip(tree.featureImportances.indices, tree.featureImportances.values, strict=True):
                values[int(i)] += float(v)
        total = sum(values) or 1.0
        gain = dict(zip(self.feature_cols, values, strict=False))
        for c, v in zip(flagged, values[len(self.feature_cols) :], strict=True):
            gain[c] += v
        return dict(sorted(((k, v / total) for k, v in gain.items()), key=lambda kv: -kv[1]))
