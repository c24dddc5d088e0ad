"""Bounded neighbourhoods on the time axis.

A window over a whole series puts that series into one task, and one series may hold a
third of all rows. Here the hour axis is cut into spans of fixed length, and rows near a
border are copied to the neighbouring span (its halo). A neighbourhood operator whose
reach is at most the halo then works on ``(keys, span)``: never more than
``hours + back + ahead`` rows per group, whatever the length of a series.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from helioframe.functions.timeaxis import EPOCH, hours_since
from helioframe.schema import TALL, Axis

HOUR = "__hour"
SPAN = "__span"


@dataclass(frozen=True)
class Spans:
    axis: Axis = TALL
    hours: int = 1344
    back: int = 0
    ahead: int = 0
    origin: datetime = EPOCH

    def __post_init__(self) -> None:
        if max(self.back, self.ahead) > self.hours:
            raise ValueError("a halo may not be longer than a span")

    def own(self, hour: Column | str = HOUR) -> Column:
        """The span an hour belongs to."""
        col = F.col(hour) if isinstance(hour, str) else hour
        return F.floor(col / F.lit(self.hours)).cast("bigint")

    def members(self) -> Column:
        """All spans that need to see an hour: its own and, near a border, a neighbour."""
        own = self.own()
        inside = F.pmod(F.col(HOUR), F.lit(self.hours))
        low, high = inside < self.ahead, inside >= self.hours - self.back
        return (
            F.when(low & high, F.array(own - 1, own, own + 1))
            .when(low, F.array(own - 1, own))
            .when(high, F.array(own, own + 1))
            .otherwise(F.array(own))
        )

    def scatter(self, df: DataFrame) -> DataFrame:
        """Add the hour index and one copy of each row per span that needs it."""
        return self.assign(df.withColumn(HOUR, hours_since(self.axis.ts, self.origin)))

    def assign(self, df: DataFrame) -> DataFrame:
        """``scatter`` for rows that already carry their hour index."""
        if not (self.back or self.ahead):
            return df.withColumn(SPAN, self.own())
        return df.withColumn(SPAN, F.explode(self.members()))

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.axis.keys, SPAN).orderBy(HOUR)

    def gather(self, df: DataFrame) -> DataFrame:
        """Drop halo copies and helper columns."""
        if self.back or self.ahead:
            df = df.where(self.own() == F.col(SPAN))
        return df.drop(HOUR, SPAN)
