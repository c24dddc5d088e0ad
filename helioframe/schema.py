"""Column contracts and frozen configuration shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Axis:
    """Which columns identify a series and its time.

    ``TALL`` is the canonical layout (many series in one table). ``WIDE`` is a single
    series whose measures are spread over columns named ``{country}_{variable}``.
    """

    keys: tuple[str, ...] = ("series_id",)
    ts: str = "ts"

    @property
    def columns(self) -> list[str]:
        return [*self.keys, self.ts]


TALL = Axis()
WIDE = Axis(keys=(), ts="utc_timestamp")

# Column names of the published hourly CSV files.
TIME_SERIES_FILE = "time_series_60min_singleindex.csv"
WEATHER_FILE = "weather_data.csv"
TIME_SERIES_COLUMNS = (
    "utc_timestamp",
    "DE_load_actual_entsoe_transparency",
    "DE_solar_generation_actual",
    "DE_solar_capacity",
    "IT_solar_generation_actual",
)
WEATHER_COLUMNS = (
    "utc_timestamp",
    "DE_temperature",
    "DE_radiation_direct_horizontal",
    "DE_radiation_diffuse_horizontal",
    "IT_temperature",
    "IT_radiation_direct_horizontal",
    "IT_radiation_diffuse_horizontal",
)
PROFILE_TIME_SERIES_COLUMNS = (
    "utc_timestamp",
    "DE_load_actual_entsoe_transparency",
    "DE_solar_generation_actual",
    "DE_solar_capacity",
    "DE_50hertz_solar_generation_actual",
    "DE_amprion_solar_generation_actual",
    "DE_tennet_solar_generation_actual",
    "DE_transnetbw_solar_generation_actual",
    "IT_solar_generation_actual",
)

# UTC hours treated as night. Cleaning includes 04:00, the irradiance
# check of the quality profile does not.
NIGHT_HOURS = (22, 23, 0, 1, 2, 3, 4)
NIGHT_HOURS_IRRADIANCE_PROFILE = (22, 23, 0, 1, 2, 3)

READING_MEASURES = ("generation", "capacity", "load")
WEATHER_MEASURES = ("temperature", "direct", "diffuse")
PHYSICS_COLUMNS = (
    "solar_elevation_deg",
    "solar_zenith_deg",
    "clearness_index",
    "g_poa",
    "t_cell_c",
    "cf_theory",
)
CALENDAR_COLUMNS = ("hour_sin", "hour_cos", "doy_sin", "doy_cos")
DEFAULT_LAGS = (1, 24, 168)

# Feature sets of the regression forecasters, in tall column names.
WEATHER_FEATURES = ("ghi", "temperature")
PHYSICS_FEATURES = (
    *WEATHER_FEATURES,
    "g_poa",
    "cf_theory",
    "clearness_index",
    "t_cell_c",
    "solar_elevation_deg",
)
LAG_FEATURES = (
    *PHYSICS_FEATURES,
    "cf_lag_1h",
    "cf_lag_24h",
    "cf_lag_168h",
    *CALENDAR_COLUMNS,
)


@dataclass(frozen=True)
class PreprocessConfig:
    """Knobs of the dataset build. Window bounds are exact UTC instants, inclusive."""

    overlap_start: str = "2015-01-01"
    overlap_end: str = "2019-12-31 23:00:00"
    night_solar_threshold_mw: float = 1.0
    night_ghi_threshold_w_m2: float = 1.0
    max_interpolation_gap_hours: int = 3


@dataclass(frozen=True)
class SiteConfig:
    """Location and orientation of one photovoltaic fleet (180 = facing south)."""

    latitude_deg: float = 51.0
    longitude_deg: float = 10.5
    tilt_deg: float = 35.0
    azimuth_deg: float = 180.0


@dataclass(frozen=True)
class Split:
    """Chronological split, inclusive at both ends at the resolution each bound is written in."""

    train_start: str = "2015-01-01 00:00:00"
    train_end: str = "2017-12-31 23:00:00"
    val_start: str = "2018-01-01 00:00:00"
    val_end: str = "2018-12-31 23:00:00"
    test_start: str = "2019-01-01 00:00:00"
    test_end: str = "2019-12-31 23:00:00"
