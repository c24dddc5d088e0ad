"""Short-gap interpolation and gap inventory on a strict hourly grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from helioframe.functions.timeaxis import EPOCH, instant, plus_hours
from helioframe.operators.neighbours import Neighbours
from helioframe.operators.spans import HOUR, SPAN, Spans
from helioframe.schema import TALL, Axis


def _filled(
    df: DataFrame, columns: Sequence[str], max_gap_hours: int, axis: Axis, span_hours: int, absent: dict[str, str]
) -> DataFrame:
    """``df`` with short gaps closed; ``absent`` names a flag for columns whose hours missing before are to be told."""
    spans = Spans(axis, max(span_hours, max_gap_hours), back=max_gap_hours, ahead=max_gap_hours)
    known = Neighbours(columns, [*axis.keys, SPAN])
    marked = df.withColumns({flag: F.col(c).isNull() for c, flag in absent.items()}) if absent else df
    return spans.gather(known.fill(spans.scatter(marked), max_gap_hours))


def _fill_counts(absent: dict[str, str]) -> list[Column]:
    return [F.count_if(F.col(flag) & F.col(c).isNotNull()).alias(c) for c, flag in absent.items()]


def interpolate_short_gaps(
    df: DataFrame,
    columns: Sequence[str],
    max_gap_hours: int = 3,
    axis: Axis = TALL,
    span_hours: int = 240,
    observation: Observation | None = None,
) -> DataFrame:
    """Fill runs of at most ``max_gap_hours`` missing hours; longer and edge runs stay NULL.

    Each column is filled on its own. One shuffle by ``(keys, span)``: a fillable hour has
    both neighbours within ``max_gap_hours``, which is the halo of a span. ``observation``
    receives the filled hours of each column in the next action.
    """
    if max_gap_hours < 1 or not columns:
        return df
    absent = {c: f"__absent_{c}" for c in columns} if observation is not None else {}
    filled = _filled(df, columns, max_gap_hours, axis, span_hours, absent)
    if observation is not None:
        filled = filled.observe(observation, *_fill_counts(absent))
    return filled.select(*df.columns)


def filled_hours(
    df: DataFrame,
    columns: Sequence[str],
    max_gap_hours: int = 3,
    axis: Axis = TALL,
    span_hours: int = 240,
) -> DataFrame:
    """How many missing hours ``interpolate_short_gaps`` fills, one row per column.

    Counted in the pass that fills, from a flag that says which hours were missing; ``df``
    is read once.
    """
    absent = {c: f"__absent_{c}" for c in columns}
    counts = _filled(df, columns, max_gap_hours, axis, span_hours, absent).agg(*_fill_counts(absent))
    return counts.unpivot([], list(columns), "column", "filled_hours")


def gap_runs(
    df: DataFrame,
    column: str,
    max_gap_hours: int = 3,
    axis: Axis = TALL,
    span_hours: int = 1344,
) -> DataFrame:
    """One row per run of missing hours: first and last hour, length, whether it is filled.

    The input is read and shuffled once. Every span is reduced to a summary: its runs in order, and whether the first one
    touches its start and the last one its end. Summaries of neighbouring spans are folded by windows that see one row
    per span: a run that goes on is reported by the last span it reaches, with the start that was carried there.
    A run may be as long as the series.
    """
    spans = Spans(axis, span_hours)
    missing = F.col(column).isNull()
    keys = list(axis.keys)
    # A known hour and the missing ones behind it are one block.
    block = F.sum(F.when(missing, 0).otherwise(1)).over(spans.window())
    summary = (
        spans.scatter(df)
        .select(*keys, SPAN, HOUR, missing.alias("__missing"), block.alias("__block"))
        .groupBy(*keys, SPAN, "__block")
        .agg(
            F.min(HOUR).alias("__low"),
            F.max(HOUR).alias("__high"),
            F.min(F.when(F.col("__missing"), F.col(HOUR))).alias("__from"),
        )
        .groupBy(*keys, SPAN)
        .agg(
            F.min("__low").alias("__first"),
            F.max("__high").alias("__last"),
            F.sort_array(
                F.collect_list(
                    F.when(F.col("__from").isNotNull(), F.struct(F.col("__from").alias("a"), F.col("__high").alias("b")))
                )
            ).alias("__runs"),
        )
    )
    series = Window.partitionBy(*keys)
    order = series.orderBy(SPAN)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = F.col("__runs")
    head = F.coalesce(F.get(runs, 0)["a"] == F.col(SPAN) * span_hours, F.lit(False))
    last_run = F.get(runs, F.size(runs) - 1)
    tail = F.coalesce(last_run["b"] == (F.col(SPAN) + 1) * span_hours - 1, F.lit(False))
    touched = summary.select(
        "*",
        head.alias("__head"),
        tail.alias("__tail"),
        F.min("__first").over(series).alias("__begin"),
        F.max("__last").over(series).alias("__end"),
    )
    goes_on = F.col("__head") & F.lag("__tail").over(order) & (F.lag(SPAN).over(order) + 1 == F.col(SPAN))
    will_go_on = F.col("__tail") & F.lead("__head").over(order) & (F.lead(SPAN).over(order) - 1 == F.col(SPAN))
    chained = touched.select(
        "*",
        F.coalesce(goes_on, F.lit(False)).alias("__goes_on"),
        F.coalesce(will_go_on, F.lit(False)).alias("__will_go_on"),
    )
    # A span that is missing throughout only passes on the start that reached it.
    passes = F.col("__goes_on") & F.col("__tail") & (F.size(runs) == 1)
    started = F.when(F.col("__tail") & ~passes, last_run["a"])
    carried = chained.withColumn("__carried", F.last(started, ignorenulls=True).over(before))
    whole = F.transform(
        runs,
        lambda r, i: F.struct(
            F.when(F.col("__goes_on") & (i == 0), F.col("__carried")).otherwise(r["a"]).alias("a"),
            r["b"].alias("b"),
            (F.col("__will_go_on") & (i == F.size(runs) - 1)).alias("open"),
        ),
    )
    found = carried.select(*keys, "__begin", "__end", F.explode(F.filter(whole, lambda r: ~r["open"])).alias("__run"))
    low, high = F.col("__run.a"), F.col("__run.b")
    length = high - low + 1
    inside = (low > F.col("__begin")) & (high < F.col("__end"))
    epoch = instant(EPOCH)
    return found.select(
        *keys,
        plus_hours(epoch, low).alias("gap_start"),
        plus_hours(epoch, high).alias("gap_end"),
        length.alias("gap_hours"),
        (inside & (length <= max_gap_hours)).alias("filled"),
    )
