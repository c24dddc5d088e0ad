"""Chronological train / validation / test split and the tail hold-out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.functions.exprs import as_column
from helioframe.functions.timeaxis import EPOCH, end_of_period, hours_since, instant
from helioframe.operators.spans import HOUR, SPAN, Spans
from helioframe.schema import TALL, Axis, Split


def _period(ts: Column, start: str, end: str) -> Column:
    return (ts >= instant(start)) & (ts < instant(end_of_period(end)))


def split_label(ts: Column | str, split: Split | None = None) -> Column:
    """``train``, ``val``, ``test`` or NULL outside all three."""
    s = split or Split()
    col = as_column(ts)
    return (
        F.when(_period(col, s.train_start, s.train_end), "train")
        .when(_period(col, s.val_start, s.val_end), "val")
        .when(_period(col, s.test_start, s.test_end), "test")
    )


def add_split(df: DataFrame, split: Split | None = None, axis: Axis = TALL) -> DataFrame:
    return df.withColumn("split", split_label(axis.ts, split))


def split_dataset(
    df: DataFrame, split: Split | None = None, axis: Axis = TALL
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three filtered views; the bounds are plain ranges and reach the file scan."""
    s = split or Split()
    ts = F.col(axis.ts)
    return (
        df.where(_period(ts, s.train_start, s.train_end)),
        df.where(_period(ts, s.val_start, s.val_end)),
        df.where(_period(ts, s.test_start, s.test_end)),
    )


def tail_start(
    df: DataFrame,
    target: str,
    fraction: float = 0.1,
    axis: Axis = TALL,
    span_hours: int = 1344,
) -> datetime | None:
    """The moment from which on the last ``fraction`` of all rows with a target lie (one row at least); None without rows.

    An order statistic from counts: rows per moment, summed per span of hours, name the span that holds the cut, and
    the counts inside this one span name the moment. Only counts are sorted, one span's and one per span.
    """
    moments = df.where(F.col(target).isNotNull()).groupBy(axis.ts).agg(F.count("*").alias("__n"))
    moments = moments.withColumn(SPAN, F.floor(hours_since(axis.ts, EPOCH) / span_hours))
    late = Window.orderBy(F.desc(SPAN))
    total = F.sum("__n").over(late.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    spans = (
        moments.groupBy(SPAN)
        .agg(F.sum("__n").alias("__n"))
        .select(
            SPAN,
            (F.sum("__n").over(late) - F.col("__n")).alias("__after"),
            F.sum("__n").over(late).alias("__upto"),
            F.greatest(F.lit(1), F.floor(total * fraction)).alias("__take"),
        )
    )
    cut = spans.where("__after < __take AND __take <= __upto").select(SPAN, (F.col("__take") - F.col("__after")).alias("__need"))
    reached = F.sum("__n").over(Window.orderBy(F.desc(axis.ts)))
    inside = moments.join(cut, SPAN).withColumn("__reached", reached)
    return inside.where("__reached >= __need").agg(F.max(axis.ts)).first()[0]


def mark_holdout(
    df: DataFrame,
    target: str,
    fraction: float = 0.1,
    axis: Axis = TALL,
    output: str = "holdout",
    span_hours: int = 1344,
    per_series: bool = False,
) -> DataFrame:
    """Rows with a target, flagged where they belong to the last ``fraction`` by time.

    One cut-off holds for all series, so that no series is trained on hours at which another one is held out; rows of the
    cut-off itself are held out together. With ``per_series`` each series has a tail of its own, of one row at least.
    """
    if per_series:
        return _mark_tails(df, target, fraction, axis, output, span_hours)
    start = tail_start(df, target, fraction, axis, span_hours)
    held = F.lit(False) if start is None else F.col(axis.ts) >= instant(start)
    return df.where(F.col(target).isNotNull()).withColumn(output, held)


def _mark_tails(
    df: DataFrame, target: str, fraction: float, axis: Axis, output: str, span_hours: int
) -> DataFrame:
    """Ranks are built from counts per span plus a rank inside the span, so no series is ever sorted as a whole."""
    keys = list(axis.keys)
    spans = Spans(axis, span_hours)
    usable = spans.scatter(df.where(F.col(target).isNotNull()))
    counts = usable.groupBy(*keys, SPAN).agg(F.count("*").alias("__n"))
    series = Window.partitionBy(*keys)
    later = series.orderBy(F.desc(SPAN)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        SPAN,
        F.coalesce(F.sum("__n").over(later), F.lit(0)).alias("__after"),
        F.greatest(F.lit(1), F.floor(F.sum("__n").over(series) * fraction)).alias("__take"),
    )
    inside = Window.partitionBy(*keys, SPAN).orderBy(F.desc(HOUR))
    ranked = usable.withColumn("__rank", F.row_number().over(inside)).join(
        offsets, [*keys, SPAN], "inner"
    )
    flagged = ranked.withColumn(output, F.col("__after") + F.col("__rank") <= F.col("__take"))
    return flagged.select(*df.columns, output)
