"""Quality profile of raw feeds. Every profile is a distributed aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions.exprs import as_column, is_night, pearson, ratio
from helioframe.functions.timeaxis import hours_between, instant
from helioframe.schema import NIGHT_HOURS_IRRADIANCE_PROFILE, TALL, Axis

MONTHS = tuple(range(1, 13))


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _present_pct(column: str) -> Column:
    return 100.0 * F.count(column) / F.count(F.lit(1))


def coverage(feeds: Mapping[str, DataFrame], axis: Axis = TALL, by: Sequence[str] = ()) -> DataFrame:
    """First and last timestamp and row count of each feed; ``by`` keeps series apart."""
    return _stack(
        [
            df.groupBy(*by)
            .agg(
                F.min(axis.ts).alias("start_ts"),
                F.max(axis.ts).alias("end_ts"),
                F.count("*").alias("n_rows"),
            )
            .select(F.lit(source).alias("source"), *by, "start_ts", "end_ts", "n_rows")
            for source, df in feeds.items()
        ]
    )


def usable_overlap(covered: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Period shared by all feeds of a ``coverage`` table, in hours and years of 8,760 hours."""
    # Whole hours, rounded down also where the feeds do not meet.
    seconds = F.expr("timestampdiff(SECOND, overlap_start, overlap_end)")
    hours = F.floor(seconds / 3600) + 1
    return (
        covered.groupBy(*by)
        .agg(
            F.max("start_ts").alias("overlap_start"), F.min("end_ts").alias("overlap_end")
        )
        .withColumn("overlap_hours", hours)
        .withColumn("overlap_years", F.col("overlap_hours") / F.lit(8760.0))
    )


def column_completeness(
    feeds: Mapping[str, DataFrame], axis: Axis = TALL, digits: int = 2, by: Sequence[str] = ()
) -> DataFrame:
    """Percentage of present values per feed and column, least complete first; ``by`` keeps series apart."""
    profiles = []
    for source, df in feeds.items():
        names = [c for c in df.columns if c not in axis.columns]
        profiles.append(
            df.groupBy(*by)
            .agg(*[_present_pct(c).alias(c) for c in names])
            .unpivot(list(by), names, "column", "pct")
            .select(
                F.lit(source).alias("source"),
                *by,
                "column",
                F.bround("pct", digits).alias("present_pct"),
            )
        )
    return _stack(profiles).orderBy("present_pct", "source", *by, "column")


def completeness_by_year(
    df: DataFrame,
    column: str = "generation",
    axis: Axis = TALL,
    digits: int = 2,
    by: Sequence[str] = (),
) -> DataFrame:
    return (
        df.groupBy(*by, F.year(axis.ts).alias("year"))
        .agg(F.bround(_present_pct(column), digits).alias("present_pct"))
        .orderBy(*by, "year")
    )


def target_completeness(df: DataFrame, column: str = "cf") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), _present_pct(column).alias("present_pct"))


def reading_anomalies(
    df: DataFrame,
    generation: str = "generation",
    axis: Axis = TALL,
    night_threshold: float = 1.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Negative generation (count and share of all rows) and generation at night."""
    g = F.col(generation)
    negative = F.count_if(g < 0)
    return df.groupBy(*by).agg(
        negative.alias("negative_generation"),
        ratio(100.0 * negative, F.count(F.lit(1))).alias("negative_generation_pct"),
        F.count_if(is_night(axis.ts) & (g > night_threshold)).alias("night_generation"),
    )


def weather_anomalies(
    df: DataFrame,
    temperature: str = "temperature",
    direct: str = "direct",
    diffuse: str = "diffuse",
    axis: Axis = TALL,
    low: float = -30.0,
    high: float = 45.0,
    night_threshold: float = 1.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Implausible temperatures and irradiance at night.

    Unlike cleaning, this check starts the day at 04:00 and lets a missing component
    count as zero.
    """
    t = F.col(temperature)
    total = F.coalesce(F.col(direct), F.lit(0.0)) + F.coalesce(F.col(diffuse), F.lit(0.0))
    dark = is_night(axis.ts, NIGHT_HOURS_IRRADIANCE_PROFILE)
    return df.groupBy(*by).agg(
        F.count_if((t < low) | (t > high)).alias("temperature_out_of_range"),
        F.count_if(dark & (total > night_threshold)).alias("night_irradiance"),
    )


def side_by_side(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two aggregates over the same series in one table; without ``by`` both are single rows."""
    if by:
        return left.join(right, list(by), "full")
    one = "__one"
    return left.withColumn(one, F.lit(1)).join(right.withColumn(one, F.lit(1)), one).drop(one)


def anomaly_counts(
    readings: DataFrame, weather: DataFrame, axis: Axis = TALL, by: Sequence[str] = ()
) -> DataFrame:
    """All anomaly counts as one row, or one for each series; one pass over each feed.

    Counts of a feed that a series does not have are NULL.
    """
    return side_by_side(
        reading_anomalies(readings, axis=axis, by=by), weather_anomalies(weather, axis=axis, by=by), by
    )


def paired_feeds(
    readings: DataFrame,
    weather: DataFrame,
    generation: str = "generation",
    temperature: str = "temperature",
    direct: str = "direct",
    diffuse: str = "diffuse",
    axis: Axis = TALL,
) -> DataFrame:
    """Raw feeds joined on their timestamps, complete rows only, with ``ghi``."""
    return (
        readings.select(*axis.columns, generation)
        .join(weather.select(*axis.columns, direct, diffuse, temperature), axis.columns, "inner")
        .dropna()
        .withColumn("ghi", F.col(direct) + F.col(diffuse))
    )


def overall_correlation(
    paired: DataFrame, x: str = "generation", y: str = "ghi", by: Sequence[str] = ()
) -> DataFrame:
    """Correlation of all rows, or one for each value of the columns ``by``."""
    return paired.groupBy(*by).agg(pearson(x, y).alias("corr"), F.count("*").alias("n"))


def correlation_by_month(
    paired: DataFrame,
    x: str = "generation",
    y: str = "ghi",
    axis: Axis = TALL,
    digits: int = 3,
    by: Sequence[str] = (),
) -> DataFrame:
    """Correlation per calendar month, over all years together."""
    return (
        paired.groupBy(*by, F.month(axis.ts).alias("month"))
        .agg(F.bround(pearson(x, y), digits).alias("corr"))
        .orderBy(*by, "month")
    )


def capacity_by_year(
    df: DataFrame, capacity: str = "capacity", axis: Axis = TALL, by: Sequence[str] = ()
) -> DataFrame:
    """Lowest and highest capacity of each year, rounded to whole units; ``by`` keeps series apart."""
    return (
        df.where(F.col(capacity).isNotNull())
        .groupBy(*by, F.year(axis.ts).alias("year"))
        .agg(
            F.bround(F.min(capacity), 0).alias("min_capacity"),
            F.bround(F.max(capacity), 0).alias("max_capacity"),
        )
        .orderBy(*by, "year")
    )


def capacity_timeline(df: DataFrame, capacity: str = "capacity", axis: Axis = TALL) -> DataFrame:
    """Known capacity over time, in thousands."""
    known = df.where(F.col(capacity).isNotNull())
    return known.select(*axis.columns, (F.col(capacity) / 1000.0).alias("capacity_thousands"))


def capacity_growth(yearly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Growth from the first year's minimum to the last year's maximum, 0 for a single year.

    With several series pass ``by``, here and to ``capacity_by_year``: pooled, it compares one
    series' minimum with another's maximum.
    """
    first, last = F.min_by("min_capacity", "year"), F.max_by("max_capacity", "year")
    growth = (ratio(last, first) - 1.0) * 100.0
    return yearly.groupBy(*by).agg(
        F.count("*").alias("n_years"),
        F.when(F.count("*") > 1, growth).otherwise(F.lit(0.0)).alias("growth_pct"),
    )


def missing_heatmap(
    df: DataFrame, column: str = "generation", axis: Axis = TALL, by: Sequence[str] = ()
) -> DataFrame:
    """Share of missing values per year (rows) and month (columns ``m01`` to ``m12``)."""
    month = F.month(axis.ts)
    cells = df.groupBy(*by, F.year(axis.ts).alias("year"), month.alias("month")).agg(
        F.avg(F.when(F.col(column).isNull(), 1.0).otherwise(0.0)).alias("missing")
    )
    # Twelve fixed columns: no extra job to discover the pivot values.
    pivoted = cells.groupBy(*by, "year").pivot("month", list(MONTHS)).agg(F.first("missing"))
    return pivoted.select(
        *by, "year", *[F.col(str(m)).alias(f"m{m:02d}") for m in MONTHS]
    ).orderBy(*by, "year")


def one_year(
    readings: DataFrame,
    weather: DataFrame,
    year: int = 2018,
    generation: str = "generation",
    direct: str = "direct",
    diffuse: str = "diffuse",
    axis: Axis = TALL,
) -> DataFrame:
    """Generation next to irradiance for one calendar year, one row per hour of either feed."""
    ts = as_column(axis.ts)
    inside = (ts >= instant(f"{year}-01-01")) & (ts < instant(f"{year + 1}-01-01"))
    left = readings.where(inside).select(*axis.columns, generation)
    right = weather.where(inside).select(
        *axis.columns, (F.col(direct) + F.col(diffuse)).alias("ghi")
    )
    return left.join(right, axis.columns, "full")
