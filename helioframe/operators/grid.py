"""Hourly grid and alignment of feeds onto it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.functions.timeaxis import (
    between,
    grid_hours,
    hours_since,
    instant,
    parse_instant,
    plus_hours,
)
from helioframe.operators.neighbours import Neighbours
from helioframe.operators.spans import HOUR, SPAN, Spans
from helioframe.schema import TALL, Axis

_NEXT = "__next"
_LISTED = "__listed"
CARRIED = "__carried"
#: Most grid rows meant for one task where they are sorted once more, as for lags, and fewest while cores are idle.
GRID_ROWS, FEW_GRID_ROWS = 1_000_000, 100_000


def _span_skeleton(series: DataFrame | None, spark: SparkSession, count: int) -> DataFrame:
    """One row per series and span; the only part of the grid that is ever shuffled."""
    if series is None:
        return spark.range(count).select(F.col("id").alias(SPAN))
    return series.withColumn(
        SPAN, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    )


def hourly_grid(
    spark: SparkSession,
    start: str | datetime,
    end: str | datetime,
    series: DataFrame | None = None,
    axis: Axis = TALL,
    span_hours: int = 240,
) -> DataFrame:
    """Every hour from ``start`` to ``end`` for every row of ``series``.

    Spans are generated first and spread over the cluster, then expanded to hours, so
    that neither a single long series nor its hour array lands in one task.
    """
    hours = grid_hours(start, end)
    spans = -(-hours // span_hours)
    keys = None if series is None else series.select(*axis.keys).distinct()
    names = [] if series is None else list(axis.keys)
    first = F.col(SPAN) * span_hours
    last = F.least(first + (span_hours - 1), F.lit(hours - 1))
    return (
        _span_skeleton(keys, spark, spans)
        .repartition(*names, SPAN)
        .withColumn(HOUR, F.explode(F.sequence(first, last)))
        .select(*names, plus_hours(instant(start), F.col(HOUR)).alias(axis.ts))
    )


def duplicate_hours(df: DataFrame, axis: Axis = TALL) -> DataFrame:
    """``(keys, ts)`` pairs that occur more than once, with their count."""
    return df.groupBy(*axis.columns).agg(F.count("*").alias("n")).where("n > 1")


def _measures(df: DataFrame, axis: Axis) -> list[str]:
    return [c for c in df.columns if c not in axis.columns]


def common_series(feeds: Sequence[DataFrame], axis: Axis = TALL) -> DataFrame | None:
    """The series present in all feeds; None on an axis without keys."""
    if not axis.keys:
        return None
    distinct = [feed.select(*axis.keys).distinct() for feed in feeds]
    return reduce(lambda a, b: a.join(b, list(axis.keys), "inner"), distinct)


def _estimated_series(tables: Sequence[DataFrame], axis: Axis) -> int:
    """About how many series (5 % error) the table with the fewest has; read and sketched at once, without a shuffle of rows."""
    if not axis.keys:
        return 1
    return min(t.agg(F.approx_count_distinct(F.xxhash64(*axis.keys))).head()[0] for t in tables)


def align_within_spans(
    feeds: Sequence[DataFrame],
    start: str | datetime,
    end: str | datetime,
    spans: Spans,
    series: DataFrame | None = None,
    on_duplicate: str = "fail",
    fill: Sequence[str] = (),
    max_gap_hours: int = 0,
    emit_back: int = 0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Aligned feeds with their hour and span, short gaps of the ``fill`` columns closed.

    Feeds are stacked, sent once to their ``(keys, span)`` and merged there by hour, which
    is the equi-join of the aligned feeds without shuffling any grid. Neighbours for the
    fill are found among the present rows; only then are absent hours written out between
    one present hour and the next. Each span emits its own hours and ``emit_back`` hours
    before them. ``spans`` needs a halo of ``max_gap_hours`` around what it emits, and
    ``start`` as its origin. The ``carry`` columns of ``series`` come back on every row as one
    struct, ``CARRIED``: they ride on the one row per series and span that opens a span, so
    no row is joined to them.

    Bytes of the shuffle do not tell how many hours a task writes out. With ``emit_back``,
    for lags that sort these hours, the shuffle therefore has a partition per ``GRID_ROWS``
    hours, or per ``FEW_GRID_ROWS`` while that makes no more tasks than cores. The number of
    series that this needs is estimated at once, in a pass of its own over the key columns.
    """
    if on_duplicate not in ("fail", "mean"):
        raise ValueError(f"on_duplicate must be 'fail' or 'mean', got {on_duplicate!r}")
    axis = spans.axis
    hours = grid_hours(start, end)
    count = -(-hours // spans.hours)
    columns: list[str] = []
    parts: list[DataFrame] = []
    for i, feed in enumerate(feeds):
        names = _measures(feed, axis)
        clash = set(names) & set(columns)
        if clash:
            raise ValueError(f"feeds share measures {sorted(clash)}")
        columns += names
        hour = hours_since(axis.ts, start)
        on_grid = feed.where(between(axis.ts, start, end)).where(
            plus_hours(instant(start), hour) == F.col(axis.ts)
        )
        if on_duplicate == "mean":
            on_grid = on_grid.groupBy(*axis.columns).agg(*[F.avg(c).alias(c) for c in names])
        rows = on_grid.select(*axis.keys, hour.alias(HOUR), *names, F.lit(1).alias(f"__feed{i}"))
        parts.append(spans.assign(rows).where(F.col(SPAN).between(0, count - 1)))

    if series is None:
        listed = common_series(feeds, axis)
    elif carry:
        # One row per series, the same one whatever the order of the input.
        listed = series.groupBy(*axis.keys).agg(F.max(F.struct(*carry)).alias(CARRIED))
    else:
        listed = series.select(*axis.keys).distinct()
    carried = [CARRIED] if series is not None and carry else []
    dealt: list[int | str] = [*axis.keys, SPAN]
    if emit_back:
        emitted = _estimated_series(feeds if series is None else [series], axis) * (hours + count * emit_back)
        cores = feeds[0].sparkSession.sparkContext.defaultParallelism
        dealt.insert(0, max(2, -(-emitted // GRID_ROWS), min(cores, -(-emitted // FEW_GRID_ROWS))))
    skeleton = _span_skeleton(listed, feeds[0].sparkSession, count).select(
        *axis.keys,
        SPAN,
        F.greatest(F.col(SPAN) * spans.hours - spans.back, F.lit(0)).alias(HOUR),
        F.lit(1).alias(_LISTED),
        *carried,
    )
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, skeleton])

    seen = [f"__feed{i}" for i in range(len(feeds))]
    merged = (
        stacked.repartition(*dealt)
        .groupBy(*axis.keys, SPAN, HOUR)
        .agg(
            *[F.max(c).alias(c) for c in columns],
            *[F.count(c).alias(c) for c in seen],
            F.max(_LISTED).alias(_LISTED),
            *[F.max(c).alias(c) for c in carried],
        )
    )
    twice = reduce(lambda a, b: a | b, [F.col(c) > 1 for c in seen])
    order = spans.window()
    first = F.greatest(F.col(SPAN) * spans.hours - emit_back, F.lit(0))
    stop = F.least((F.col(SPAN) + 1) * spans.hours, F.lit(hours))
    filled = [c for c in columns if c in fill and max_gap_hours > 0]
    known = Neighbours(filled, [*axis.keys, SPAN])
    bounded = merged.select(
        *axis.keys,
        SPAN,
        F.when(twice, F.raise_error(F.lit("duplicate hour in a feed")).cast("bigint"))
        .otherwise(F.col(HOUR))
        .alias(HOUR),
        *[c for c in columns if c not in filled],
        *[h.alias(n) for n, h in known.helpers().items()],
        # The skeleton row opens its span, so the first row tells whether the series is wanted.
        *[F.first(c).over(order).alias(c) for c in (_LISTED, *carried)],
        F.lead(HOUR).over(order).alias(_NEXT),
    ).where(F.col(_LISTED).isNotNull())
    ranged = bounded.withColumns(
        {
            "__from": F.greatest(F.col(HOUR), first),
            "__to": F.least(F.coalesce(F.col(_NEXT), stop), stop) - 1,
        }
    ).where(F.col("__from") <= F.col("__to"))
    at = F.col("__at")
    return ranged.withColumn("__at", F.explode(F.sequence("__from", "__to"))).select(
        *axis.keys,
        plus_hours(instant(start), at).alias(axis.ts),
        *[
            (
                known.value_at(c, at, max_gap_hours)
                if c in filled
                else F.when(at == F.col(HOUR), F.col(c))
            ).alias(c)
            for c in columns
        ],
        at.alias(HOUR),
        SPAN,
        *carried,
    )


def align_feeds(
    feeds: Sequence[DataFrame],
    start: str | datetime,
    end: str | datetime,
    axis: Axis = TALL,
    series: DataFrame | None = None,
    on_duplicate: str = "fail",
    span_hours: int = 1344,
) -> DataFrame:
    """Inner join of feeds on a strict hourly grid; hours absent from a feed become NULL.

    Every wanted series gets every hour of the window. Wanted are the series listed in
    ``series``, else those present in all feeds. Readings off the grid vanish; two readings
    of one hour raise, or are averaged with ``on_duplicate="mean"``.
    """
    spans = Spans(axis, span_hours, origin=parse_instant(start))
    aligned = align_within_spans(feeds, start, end, spans, series, on_duplicate)
    return aligned.drop(HOUR, SPAN)


def align_to_window(
    df: DataFrame,
    start: str | datetime,
    end: str | datetime,
    axis: Axis = TALL,
    series: DataFrame | None = None,
    on_duplicate: str = "fail",
    span_hours: int = 1344,
) -> DataFrame:
    """One feed on the strict hourly grid (see ``align_feeds``)."""
    return align_feeds([df], start, end, axis, series, on_duplicate, span_hours)


def align_by_join(
    df: DataFrame,
    grid: DataFrame,
    axis: Axis = TALL,
) -> DataFrame:
    """Alignment as a left join from a given grid, for grids that are not a full window.

    Duplicates are the caller's to check (``duplicate_hours``).
    """
    return grid.join(df, axis.columns, "left")


def is_aligned(df: DataFrame, start: str | datetime, end: str | datetime, axis: Axis = TALL) -> Column:
    """Aggregate expression: the group holds each hour of the window exactly once."""
    hours = grid_hours(start, end)
    return (
        (F.count("*") == hours)
        & (F.min(axis.ts) == instant(start))
        & (F.max(hours_since(axis.ts, start)) == hours - 1)
    )
