"""Lagged values on an hourly axis."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions.timeaxis import plus_hours
from helioframe.operators.spans import Spans
from helioframe.schema import DEFAULT_LAGS, TALL, Axis


def lag_name(target: str, hours: int) -> str:
    return f"{target}_lag_{hours}h"


def _hours_ago(target: str, hours: int, spans: Spans) -> Column:
    # A range frame is exact in time, so a missing row yields NULL and not a neighbour.
    return F.max(target).over(spans.window().rangeBetween(-hours, -hours))


def lag_on_grid(df: DataFrame, target: str, lags: Sequence[int], spans: Spans) -> DataFrame:
    """Lags over the emitted rows of an alignment, where k rows back is k hours back."""
    order = spans.window()
    return df.withColumns({lag_name(target, k): F.lag(target, k).over(order) for k in lags})


def add_lag_features(
    df: DataFrame,
    target: str,
    lags: Iterable[int] = DEFAULT_LAGS,
    axis: Axis = TALL,
    span_hours: int = 1344,
) -> DataFrame:
    """Add ``{target}_lag_{k}h``: the value exactly k hours earlier in the same series.

    Reads only the past, so it may run before the chronological split. The first k hours
    of a series are NULL and are kept. One shuffle by ``(keys, span)``.
    """
    lags = list(lags)
    if not lags:
        return df
    if min(lags) < 1:
        raise ValueError("lags must be positive")
    reach = max(lags)
    spans = Spans(axis, max(span_hours, reach), back=reach)
    lagged = spans.scatter(df).withColumns(
        {lag_name(target, k): _hours_ago(target, k, spans) for k in lags}
    )
    return spans.gather(lagged)


def add_lag_features_by_join(
    df: DataFrame, target: str, lags: Iterable[int] = DEFAULT_LAGS, axis: Axis = TALL
) -> DataFrame:
    """The same columns as an equi-join on the shifted timestamp, with one read and one shuffle for all lags.

    Every row is stacked with a copy of its target per lag, moved to the hour that sees it, and all that meets at one
    ``(keys, ts)`` is merged. That key is unique, so the groups are balanced whatever the length of a series.
    """
    lags = list(lags)
    if not lags:
        return df
    others = [c for c in df.columns if c not in axis.columns]
    row = F.struct(*others)
    kind = df.select(row.alias("row")).schema["row"].dataType
    nothing = F.lit(None).cast(df.schema[target].dataType)

    def entry(ts: Column, row: Column, k: int, value: Column) -> Column:
        return F.struct(ts.alias("ts"), row.alias("row"), F.lit(k).alias("lag"), value.alias("value"))

    stacked = [entry(F.col(axis.ts), row, 0, nothing)]
    stacked += [entry(plus_hours(axis.ts, k), F.lit(None).cast(kind), k, F.col(target)) for k in lags]
    merged = (
        df.select(*axis.keys, F.explode(F.array(*stacked)).alias("__e"))
        .groupBy(*axis.keys, F.col("__e.ts").alias(axis.ts))
        .agg(
            F.collect_list(F.when(F.col("__e.lag") == 0, F.col("__e.row"))).alias("__rows"),
            *[F.max(F.when(F.col("__e.lag") == k, F.col("__e.value"))).alias(lag_name(target, k)) for k in lags],
        )
    )
    names = [lag_name(target, k) for k in lags]
    return merged.select(*axis.columns, F.explode("__rows").alias("__row"), *names).select(
        *[F.col(c) if c in axis.columns else F.col(f"__row.{c}").alias(c) for c in df.columns], *names
    )
