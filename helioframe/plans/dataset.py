"""Raw feeds to the clean hourly dataset and its feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from helioframe.functions.timeaxis import parse_instant
from helioframe.operators.clean import (
    add_ghi,
    clip_nighttime_generation,
    clip_nighttime_irradiance,
    normalize_to_capacity_factor,
)
from helioframe.operators.grid import CARRIED, align_within_spans, common_series
from helioframe.operators.lags import lag_on_grid
from helioframe.operators.physics import (
    SITE_PARAMETERS,
    add_calendar_features,
    add_physics,
    add_physics_at,
)
from helioframe.operators.spans import HOUR, SPAN, Spans
from helioframe.operators.splits import add_split
from helioframe.schema import DEFAULT_LAGS, TALL, WIDE, Axis, PreprocessConfig, SiteConfig, Split

FILLED = ("generation", "cf", "load")


def clean_readings(df: DataFrame, config: PreprocessConfig, axis: Axis = TALL) -> DataFrame:
    """Night output removed, capacity factor added; row-local."""
    clipped = clip_nighttime_generation(df, threshold=config.night_solar_threshold_mw, axis=axis)
    return normalize_to_capacity_factor(clipped)


def clean_weather(df: DataFrame, config: PreprocessConfig, axis: Axis = TALL) -> DataFrame:
    """Night irradiance removed; row-local."""
    return clip_nighttime_irradiance(df, threshold=config.night_ghi_threshold_w_m2, axis=axis)


def build_dataset(
    readings: DataFrame,
    weather: DataFrame,
    config: PreprocessConfig | None = None,
    series: DataFrame | None = None,
    on_duplicate: str = "fail",
    fill_columns: Sequence[str] = FILLED,
    span_hours: int = 1344,
) -> DataFrame:
    """Clean, align, join, fill short gaps and add ``ghi`` for all series at once.

    The capacity factor is computed before alignment and filled on its own. Raw rows are
    shuffled once, by series and span; the grid is written out after that shuffle.
    """
    cfg = config or PreprocessConfig()
    gap = cfg.max_interpolation_gap_hours
    spans = Spans(TALL, span_hours, gap, gap, parse_instant(cfg.overlap_start))
    aligned = align_within_spans(
        [clean_readings(readings, cfg), clean_weather(weather, cfg)],
        cfg.overlap_start,
        cfg.overlap_end,
        spans,
        series,
        on_duplicate,
        fill_columns,
        gap,
    )
    return add_ghi(aligned.drop(HOUR, SPAN))


def build_features(
    readings: DataFrame,
    weather: DataFrame,
    sites: DataFrame | SiteConfig | None = None,
    config: PreprocessConfig | None = None,
    split: Split | None = None,
    lags: Sequence[int] = DEFAULT_LAGS,
    target: str = "cf",
    azimuth_mode: str = "as_coded",
    on_duplicate: str = "fail",
    span_hours: int = 1344,
    series: DataFrame | None = None,
) -> DataFrame:
    """The dataset with lag, physics and calendar features and its ``split`` label.

    Lags ride on the shuffle of the dataset build: the halo covers the longest lag plus the
    gap that a lagged value may have been filled across. Site parameters ride on the one row
    per series and span that the grid is made from. Wanted are the series listed in
    ``series`` (the table of sites itself, for one), else those present in both feeds, which
    takes a second scan of the feeds' key columns.
    """
    cfg = config or PreprocessConfig()
    gap = cfg.max_interpolation_gap_hours
    reach = max(lags) + gap
    spans = Spans(TALL, max(span_hours, reach), reach, gap, parse_instant(cfg.overlap_start))
    feeds = [clean_readings(readings, cfg), clean_weather(weather, cfg)]
    located = isinstance(sites, DataFrame)
    if located and series is not sites:
        listed = series.select(*TALL.keys).distinct() if series is not None else common_series(feeds)
        series = listed.join(sites, list(TALL.keys), "left")
    aligned = align_within_spans(
        feeds,
        cfg.overlap_start,
        cfg.overlap_end,
        spans,
        series,
        on_duplicate,
        FILLED,
        gap,
        emit_back=max(lags),
        carry=SITE_PARAMETERS if located else (),
    )
    lagged = add_ghi(spans.gather(lag_on_grid(aligned, target, lags, spans)))
    if not located:
        return feature_columns(lagged, sites, split, azimuth_mode)
    physics = add_physics_at(lagged, CARRIED, azimuth_mode=azimuth_mode)
    return add_split(add_calendar_features(physics), split)


def feature_columns(
    dataset: DataFrame,
    sites: DataFrame | SiteConfig | None = None,
    split: Split | None = None,
    azimuth_mode: str = "as_coded",
) -> DataFrame:
    """Row-local part of the feature table: physics, calendar and split label."""
    physics = add_physics(dataset, sites, azimuth_mode=azimuth_mode)
    return add_split(add_calendar_features(physics), split)


def build_wide_dataset(
    time_series: DataFrame,
    weather: DataFrame,
    config: PreprocessConfig | None = None,
    on_duplicate: str = "fail",
    span_hours: int = 1344,
) -> DataFrame:
    """The same build for one wide table with ``DE_`` and ``IT_`` columns.

    Both countries are cleaned; capacity factor and gap filling apply to ``DE`` only, since
    ``IT`` publishes no capacity.
    """
    cfg = config or PreprocessConfig()
    gap = cfg.max_interpolation_gap_hours
    ts, wx = time_series, weather
    for country in ("DE", "IT"):
        ts = clip_nighttime_generation(
            ts, f"{country}_solar_generation_actual", cfg.night_solar_threshold_mw, WIDE
        )
        wx = clip_nighttime_irradiance(
            wx,
            f"{country}_radiation_direct_horizontal",
            f"{country}_radiation_diffuse_horizontal",
            cfg.night_ghi_threshold_w_m2,
            WIDE,
        )
    ts = normalize_to_capacity_factor(
        ts, "DE_solar_generation_actual", "DE_solar_capacity", "DE_solar_cf"
    )
    spans = Spans(WIDE, span_hours, gap, gap, parse_instant(cfg.overlap_start))
    filled = (
        "DE_solar_generation_actual",
        "DE_solar_cf",
        "DE_load_actual_entsoe_transparency",
    )
    out = align_within_spans(
        [ts, wx], cfg.overlap_start, cfg.overlap_end, spans, None, on_duplicate, filled, gap
    ).drop(HOUR, SPAN)
    for country in ("DE", "IT"):
        out = add_ghi(
            out,
            f"{country}_radiation_direct_horizontal",
            f"{country}_radiation_diffuse_horizontal",
            f"{country}_ghi",
        )
    return out
