"""Cleaning and physics on streaming feeds.

These steps look at one row at a time, so the batch operators apply to a streaming frame as
they are. Alignment, gap filling and lags need neighbouring hours and stay in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from helioframe.operators.clean import add_ghi
from helioframe.operators.physics import add_calendar_features, add_physics
from helioframe.plans.dataset import clean_readings, clean_weather
from helioframe.schema import PreprocessConfig, SiteConfig


def clean_readings_stream(stream: DataFrame, config: PreprocessConfig | None = None) -> DataFrame:
    return clean_readings(stream, config or PreprocessConfig())


def weather_features_stream(
    stream: DataFrame,
    sites: DataFrame | SiteConfig | None = None,
    config: PreprocessConfig | None = None,
) -> DataFrame:
    """Clean weather with ``ghi``, physics and calendar columns; ``sites`` is a static table."""
    clean = add_ghi(clean_weather(stream, config or PreprocessConfig()))
    return add_calendar_features(add_physics(clean, sites))
