"""The whole quality profile of a pair of raw feeds, as named tables.

Each feed is read once: its facts are aggregated per year and month (and per series, where
these are kept apart), and the profile tables are rolled up from those few rows. The tables
equal those of ``operators.quality``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions.exprs import is_night, pearson, ratio
from helioframe.operators import quality as q
from helioframe.schema import NIGHT_HOURS_IRRADIANCE_PROFILE, TALL, Axis
from helioframe.sources.files import join_path
from helioframe.sources.raw_feeds import tall_readings, tall_weather

# Prefixes of the four grid operators in the published file.
OPERATORS = ("DE_50hertz", "DE_amprion", "DE_tennet", "DE_transnetbw")


def monthly_facts(
    df: DataFrame, axis: Axis = TALL, extra: Sequence[Column] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Rows, time range and present values per column for each year and month of a feed."""
    names = [c for c in df.columns if c not in axis.columns]
    return df.groupBy(*by, F.year(axis.ts).alias("year"), F.month(axis.ts).alias("month")).agg(
        F.count("*").alias("n_rows"),
        F.min(axis.ts).alias("start_ts"),
        F.max(axis.ts).alias("end_ts"),
        *[F.count(c).alias(f"n_{c}") for c in names],
        *extra,
    )


def reading_facts(
    df: DataFrame, axis: Axis = TALL, night_threshold: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    g = F.col("generation")
    return monthly_facts(
        df,
        axis,
        [
            F.count_if(g < 0).alias("negative"),
            F.count_if(is_night(axis.ts) & (g > night_threshold)).alias("at_night"),
            F.min("capacity").alias("min_capacity"),
            F.max("capacity").alias("max_capacity"),
        ],
        by,
    )


def weather_facts(
    df: DataFrame, axis: Axis = TALL, night_threshold: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    t = F.col("temperature")
    total = F.coalesce("direct", F.lit(0.0)) + F.coalesce("diffuse", F.lit(0.0))
    dark = is_night(axis.ts, NIGHT_HOURS_IRRADIANCE_PROFILE)
    return monthly_facts(
        df,
        axis,
        [
            F.count_if((t < -30.0) | (t > 45.0)).alias("odd_temperature"),
            F.count_if(dark & (total > night_threshold)).alias("at_night"),
        ],
        by,
    )


def _coverage(facts: DataFrame, source: str, by: Sequence[str]) -> DataFrame:
    return facts.groupBy(*by).agg(
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
    ).select(F.lit(source).alias("source"), *by, "start_ts", "end_ts", "n_rows")


def _completeness(facts: DataFrame, source: str, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    return (
        facts.groupBy(*by)
        .agg(*[(100.0 * F.sum(f"n_{c}") / F.sum("n_rows")).alias(c) for c in names])
        .unpivot(list(by), list(names), "column", "pct")
        .select(F.lit(source).alias("source"), *by, "column", F.bround("pct", 2).alias("present_pct"))
    )


def _anomalies(readings: DataFrame, weather: DataFrame, by: Sequence[str]) -> DataFrame:
    left = readings.groupBy(*by).agg(
        F.sum("negative").alias("negative_generation"),
        ratio(100.0 * F.sum("negative"), F.sum("n_rows")).alias("negative_generation_pct"),
        F.sum("at_night").alias("night_generation"),
    )
    right = weather.groupBy(*by).agg(
        F.sum("odd_temperature").alias("temperature_out_of_range"),
        F.sum("at_night").alias("night_irradiance"),
    )
    return q.side_by_side(left, right, by)


def _correlations(paired: DataFrame, axis: Axis, by: Sequence[str]) -> DataFrame:
    """Overall (level 1) and monthly (level 0) correlation from one pass over the joined feeds."""
    month = F.month(axis.ts).alias("month")
    levels = paired.select(*by, month, "generation", "ghi").rollup(*by, "month").agg(
        pearson("generation", "ghi").alias("corr"),
        F.count("*").alias("n"),
        F.grouping_id().alias("level"),
    )
    return levels.where("level <= 1")


def quality_profile(
    readings: DataFrame,
    weather: DataFrame,
    year: int = 2018,
    axis: Axis = TALL,
    by: Sequence[str] = (),
) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Profile tables by name, and the small cached frames they are derived from.

    The feeds are taken raw, before any cleaning. ``by`` (key columns) gives every table a
    row set of its own for each series instead of pooling them.
    """
    by = list(by)
    r = reading_facts(readings, axis, by=by).persist(StorageLevel.MEMORY_AND_DISK)
    w = weather_facts(weather, axis, by=by).persist(StorageLevel.MEMORY_AND_DISK)
    paired = q.paired_feeds(readings, weather, axis=axis)
    c = _correlations(paired, axis, by).persist(StorageLevel.MEMORY_AND_DISK)
    measures = {
        source: [n for n in df.columns if n not in axis.columns]
        for source, df in (("time_series", readings), ("weather", weather))
    }
    covered = _coverage(r, "time_series", by).unionByName(_coverage(w, "weather", by))
    complete = _completeness(r, "time_series", measures["time_series"], by).unionByName(
        _completeness(w, "weather", measures["weather"], by)
    )
    capacity = (
        r.groupBy(*by, "year")
        .agg(
            F.bround(F.min("min_capacity"), 0).alias("min_capacity"),
            F.bround(F.max("max_capacity"), 0).alias("max_capacity"),
        )
        .where("min_capacity IS NOT NULL")
        .orderBy(*by, "year")
    )
    absent = 1.0 - F.first("n_generation") / F.first("n_rows")
    heat = r.groupBy(*by, "year").pivot("month", list(q.MONTHS)).agg(absent)
    tables = {
        "coverage": covered,
        "usable_overlap": q.usable_overlap(covered, by),
        "column_completeness": complete.orderBy("present_pct", "source", *by, "column"),
        "completeness_by_year": r.groupBy(*by, "year")
        .agg(
            F.bround(100.0 * F.sum("n_generation") / F.sum("n_rows"), 2).alias("present_pct")
        )
        .orderBy(*by, "year"),
        "anomaly_counts": _anomalies(r, w, by),
        "correlation": c.where("level = 1").select(*by, "corr", "n"),
        "correlation_by_month": c.where("level = 0")
        .select(*by, "month", F.bround("corr", 3).alias("corr"))
        .orderBy(*by, "month"),
        "capacity_by_year": capacity,
        "capacity_growth": q.capacity_growth(capacity, by),
        "missing_heatmap": heat.select(
            *by, "year", *[F.col(str(m)).alias(f"m{m:02d}") for m in q.MONTHS]
        ).orderBy(*by, "year"),
        "capacity_timeline": q.capacity_timeline(readings, axis=axis),
        "one_year": q.one_year(readings, weather, year, axis=axis),
    }
    return tables, [r, w, c]


def write_profile(
    readings: DataFrame,
    weather: DataFrame,
    folder: str,
    year: int = 2018,
    axis: Axis = TALL,
    by: Sequence[str] = (),
) -> list[str]:
    """Write each profile table as parquet under ``folder``; returns the table names."""
    tables, cached = quality_profile(readings, weather, year, axis, by)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(join_path(folder, name))
    for df in cached:
        df.unpersist()
    return list(tables)


def write_wide_profile(
    time_series: DataFrame,
    weather: DataFrame,
    folder: str,
    year: int = 2018,
    series: Sequence[str] = ("DE", "IT", *OPERATORS),
    weather_series: Sequence[str] = ("DE", "IT"),
) -> list[str]:
    """The profile of the published wide feeds (``load_profile_feeds``), a row set for each country and grid operator.

    A measure that a series does not publish counts as missing in all its rows.
    """
    return write_profile(
        tall_readings(time_series, series),
        tall_weather(weather, weather_series),
        folder,
        year,
        by=TALL.keys,
    )
