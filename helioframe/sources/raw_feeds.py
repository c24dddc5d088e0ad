"""Raw hourly CSV feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.functions.exprs import measure
from helioframe.functions.timeaxis import utc_from_text
from helioframe.schema import (
    PROFILE_TIME_SERIES_COLUMNS,
    TIME_SERIES_COLUMNS,
    TIME_SERIES_FILE,
    WEATHER_COLUMNS,
    WEATHER_FILE,
)
from helioframe.sources.files import join_path, path_exists


def read_feed(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The contract columns of one CSV: first a UTC timestamp, then measures.

    Columns are found by header name without inference, so a renamed one fails when the
    plan is analysed and only the named ones are parsed. (A CSV schema would be applied by
    position.)
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"raw feed not found at {path}")
    ts, *measures = columns
    raw = spark.read.option("header", True).csv(path)
    return raw.select(utc_from_text(ts).alias(ts), *[measure(c).alias(c) for c in measures])


def load_raw(spark: SparkSession, raw_dir: str) -> tuple[DataFrame, DataFrame]:
    """Time series and weather with the columns the dataset build uses."""
    return (
        read_feed(spark, join_path(raw_dir, TIME_SERIES_FILE), TIME_SERIES_COLUMNS),
        read_feed(spark, join_path(raw_dir, WEATHER_FILE), WEATHER_COLUMNS),
    )


def load_profile_feeds(spark: SparkSession, raw_dir: str) -> tuple[DataFrame, DataFrame]:
    """Time series including the four grid operators, and weather, for the quality profile."""
    return (
        read_feed(spark, join_path(raw_dir, TIME_SERIES_FILE), PROFILE_TIME_SERIES_COLUMNS),
        read_feed(spark, join_path(raw_dir, WEATHER_FILE), WEATHER_COLUMNS),
    )


def _stacked(df: DataFrame, ts: str, fields: dict[str, str], prefixes: Sequence[str]) -> DataFrame:
    """One pass from ``{prefix}_{suffix}`` columns to one row per prefix."""

    def value(prefix: str, suffix: str) -> Column:
        name = f"{prefix}_{suffix}"
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    for prefix in prefixes:
        if not any(f"{prefix}_{suffix}" in df.columns for suffix in fields.values()):
            raise ValueError(f"no column belongs to series {prefix!r}")
    rows = [
        F.struct(
            F.lit(prefix).alias("series_id"),
            *[value(prefix, suffix).alias(field) for field, suffix in fields.items()],
        )
        for prefix in prefixes
    ]
    return df.select(F.col(ts).alias("ts"), F.inline(F.array(*rows))).select(
        "series_id", "ts", *fields
    )


def tall_readings(
    time_series: DataFrame, series: Sequence[str] = ("DE", "IT"), ts: str = "utc_timestamp"
) -> DataFrame:
    """Wide time series -> ``(series_id, ts, generation, capacity, load)``.

    Works for countries and grid operators alike (``DE_tennet``); measures a series does not
    publish are NULL.
    """
    # Variable names of the published file.
    fields = {
        "generation": "solar_generation_actual",
        "capacity": "solar_capacity",
        "load": "load_actual_entsoe_transparency",
    }
    return _stacked(time_series, ts, fields, series)


def tall_weather(
    weather: DataFrame, series: Sequence[str] = ("DE", "IT"), ts: str = "utc_timestamp"
) -> DataFrame:
    """Wide weather -> ``(series_id, ts, temperature, direct, diffuse)``."""
    # Variable names of the published file.
    fields = {
        "temperature": "temperature",
        "direct": "radiation_direct_horizontal",
        "diffuse": "radiation_diffuse_horizontal",
    }
    return _stacked(weather, ts, fields, series)
