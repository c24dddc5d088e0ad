"""Forecasters without regression: persistence, seasonal naive, climatology, pure physics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions.timeaxis import plus_hours
from helioframe.models.base import Forecaster, unit_interval
from helioframe.operators.lags import add_lag_features, lag_name
from helioframe.operators.splits import split_label
from helioframe.schema import TALL, Axis, Split


class LaggedValue(Forecaster):
    """Forecast = the value ``lag`` hours ago, within the same split.

    A forecast made for one split does not see the rows of another. The split is a function
    of time alone, so the restart needs no window of its own: the lag is masked where the
    earlier hour carries another label. With ``split=None`` the frame is one period.
    A lag column already present (``{target}_lag_{k}h``) is used as it is.
    """

    lag = 1

    def __init__(self, target: str = "cf", axis: Axis = TALL, split: Split | None = None):
        super().__init__(target, axis)
        self.split = split

    def fit(self, df: DataFrame) -> LaggedValue:
        return self

    def _same_split(self) -> Column:
        ts = F.col(self.axis.ts)
        earlier = split_label(plus_hours(ts, -self.lag), self.split)
        return split_label(ts, self.split) == earlier

    def transform(self, df: DataFrame, output: str = "pred") -> DataFrame:
        name = lag_name(self.target, self.lag)
        ready = name in df.columns
        lagged = df if ready else add_lag_features(df, self.target, [self.lag], self.axis)
        value = F.col(name)
        if self.split is not None:
            value = F.when(self._same_split(), value)
        out = lagged.withColumn(output, value)
        return out if ready else out.drop(name)


class Persistence(LaggedValue):
    name = "persistence"
    lag = 1


class DailySeasonalNaive(LaggedValue):
    name = "daily_seasonal_naive"
    lag = 24


class HourOfYearClimatology(Forecaster):
    """Mean of the target per series, month, day and hour of the training rows.

    Keyed by month and day, so dates stay aligned over leap years. A key unseen in
    training, or without any known target, yields NULL.
    """

    name = "hour_of_year_climatology"

    def __init__(self, target: str = "cf", axis: Axis = TALL):
        super().__init__(target, axis)
        self.table: DataFrame | None = None

    def _key(self) -> dict[str, Column]:
        ts = F.col(self.axis.ts)
        return {"__month": F.month(ts), "__day": F.dayofmonth(ts), "__hour": F.hour(ts)}

    def fit(self, df: DataFrame) -> HourOfYearClimatology:
        self.release()
        key = self._key()
        self.table = (
            df.groupBy(*self.axis.keys, *[c.alias(n) for n, c in key.items()])
            .agg(F.avg(self.target).alias("__mean"))
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        # Counting fills the cache, after which Spark knows the table's true size.
        self.table.count()
        return self

    def release(self) -> None:
        if self.table is not None:
            self.table.unpersist()

    def transform(self, df: DataFrame, output: str = "pred") -> DataFrame:
        # At most 8,784 rows per series. Spark broadcasts the table if its known size is
        # below spark.sql.autoBroadcastJoinThreshold and shuffles both sides otherwise.
        table = self._require(self.table)
        key = self._key()
        on = [*self.axis.keys, *key]
        joined = df.withColumns(key).join(table, on, "left")
        return joined.select(*df.columns, F.col("__mean").alias(output))


class PurePhysics(Forecaster):
    """Forecast = the theoretical capacity factor."""

    name = "pure_physics"

    def __init__(self, theory: str = "cf_theory", target: str = "cf", axis: Axis = TALL):
        super().__init__(target, axis)
        self.theory = theory

    def fit(self, df: DataFrame) -> PurePhysics:
        return self

    def transform(self, df: DataFrame, output: str = "pred") -> DataFrame:
        return df.withColumn(output, unit_interval(F.col(self.theory)))
