"""Physics and calendar features over whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions import irradiance as irr
from helioframe.functions import sun
from helioframe.functions.exprs import as_column
from helioframe.functions.timeaxis import require_utc
from helioframe.schema import PHYSICS_COLUMNS, TALL, WIDE, Axis, SiteConfig

SITE_PARAMETERS = ("latitude_deg", "longitude_deg", "tilt_deg", "azimuth_deg")


_HELPERS = ("__lat", "__day", "__hour_angle", "__decl", "__sin_lat", "__cos_lat", "__sin_decl", "__cos_decl")


def _with_sun(df: DataFrame, latitude: Column, longitude: Column, axis: Axis) -> DataFrame:
    """Add the sun vector as ``__east``, ``__north``, ``__up``.

    Each quantity that is used more than once is a column of its own: Spark then computes
    it once per row, where one nested expression would repeat it.
    """
    eot = sun.equation_of_time(F.col("__day"))
    angles = (
        df.withColumns({"__lat": F.radians(latitude), "__day": sun.day_angle(axis.ts)})
        .withColumns(
            {
                "__decl": F.radians(sun.declination(F.col("__day"))),
                "__hour_angle": sun.hour_angle(sun.utc_hour(axis.ts), longitude, eot),
            }
        )
        .withColumns(
            {
                "__sin_lat": F.sin("__lat"),
                "__cos_lat": F.cos("__lat"),
                "__sin_decl": F.sin("__decl"),
                "__cos_decl": F.cos("__decl"),
            }
        )
    )
    vector = sun.sun_vector(
        *[F.col(c) for c in ("__sin_lat", "__cos_lat", "__sin_decl", "__cos_decl", "__hour_angle")]
    )
    return angles.withColumns(
        {"__east": vector.east, "__north": vector.north, "__up": vector.up}
    ).drop(*_HELPERS)


def solar_position(
    df: DataFrame,
    latitude: Column | str | float,
    longitude: Column | str | float,
    axis: Axis = TALL,
    azimuth_mode: str = "as_coded",
    prefix: str = "",
) -> DataFrame:
    """Add ``elevation_deg``, ``azimuth_deg`` and ``zenith_deg`` (after ``prefix``).

    Location may be constant or per row. A timestamp that is not a UTC instant is refused.
    """
    lat, lon = as_column(latitude).cast("double"), as_column(longitude).cast("double")
    elevation = F.col(f"{prefix}elevation_deg")
    return (
        _with_sun(require_utc(df, axis.ts), lat, lon, axis)
        .withColumns(
            {
                f"{prefix}elevation_deg": sun.elevation(F.col("__up")),
                f"{prefix}azimuth_deg": sun.azimuth(
                    F.col("__east"), F.col("__north"), azimuth_mode
                ),
            }
        )
        .withColumn(f"{prefix}zenith_deg", 90.0 - elevation)
        .drop("__east", "__north", "__up")
    )


def _add_physics(
    df: DataFrame,
    inputs: dict[str, str],
    site: dict[str, Column],
    output: str,
    axis: Axis,
    azimuth_mode: str,
    poa_max: float | None,
) -> DataFrame:
    facing, tilt = F.radians(site["azimuth_deg"]), F.radians(site["tilt_deg"])
    east, north, up = F.col("__east"), F.col("__north"), F.col("__up")
    toward = north * F.cos(facing) + east * F.sin(facing)
    side = -toward if sun.half_turn(azimuth_mode) else toward
    cos_aoi = up * F.cos(tilt) + side * F.sin(tilt)
    direct, diffuse = F.col(inputs["direct"]), F.col(inputs["diffuse"])
    names = {c: f"{output}{c}" for c in PHYSICS_COLUMNS}
    poa, cell = F.col(names["g_poa"]), F.col(names["t_cell_c"])
    placed = _with_sun(
        require_utc(df, axis.ts), site["latitude_deg"], site["longitude_deg"], axis
    )
    return (
        placed.withColumns(
            {
                "__clear": irr.clear_sky_from_up(up),
                "__aoi": cos_aoi,
                names["solar_elevation_deg"]: sun.elevation(up),
            }
        )
        .withColumns(
            {
                names["solar_zenith_deg"]: 90.0 - F.col(names["solar_elevation_deg"]),
                names["clearness_index"]: irr.clearness_index(direct + diffuse, F.col("__clear")),
                names["g_poa"]: irr.panel_irradiance(
                    direct, diffuse, up, F.col("__aoi"), F.cos(tilt), poa_max=poa_max
                ),
            }
        )
        .withColumn(
            names["t_cell_c"], irr.cell_temperature(F.col(inputs["temperature"]), poa)
        )
        .withColumn(names["cf_theory"], irr.theoretical_capacity_factor(poa, cell))
        .drop("__east", "__north", "__up", "__clear", "__aoi")
    )


def add_physics(
    df: DataFrame,
    sites: DataFrame | SiteConfig | None = None,
    axis: Axis = TALL,
    azimuth_mode: str = "as_coded",
    poa_max: float | None = None,
) -> DataFrame:
    """Add the six physics columns to a tall frame with temperature, direct and diffuse.

    ``sites`` is a table with one row per series, joined on the series key (Spark
    broadcasts it when its size allows), or one location for all series. Series without a
    site keep their rows with NULL physics.
    """
    inputs = {"temperature": "temperature", "direct": "direct", "diffuse": "diffuse"}
    if isinstance(sites, DataFrame):
        renamed = sites.select(*axis.keys, *[F.col(c).alias(f"__{c}") for c in SITE_PARAMETERS])
        located = df.join(renamed, list(axis.keys), "left")
        params = {c: F.col(f"__{c}") for c in SITE_PARAMETERS}
        added = _add_physics(located, inputs, params, "", axis, azimuth_mode, poa_max)
        return added.select(*df.columns, *PHYSICS_COLUMNS)
    config = sites or SiteConfig()
    params = {c: F.lit(getattr(config, c)) for c in SITE_PARAMETERS}
    return _add_physics(df, inputs, params, "", axis, azimuth_mode, poa_max)


def add_physics_at(
    df: DataFrame,
    site: str,
    axis: Axis = TALL,
    azimuth_mode: str = "as_coded",
    poa_max: float | None = None,
) -> DataFrame:
    """``add_physics`` for rows that carry the parameters of their site in the struct column ``site``, which is dropped."""
    inputs = {"temperature": "temperature", "direct": "direct", "diffuse": "diffuse"}
    params = {c: F.col(f"{site}.{c}") for c in SITE_PARAMETERS}
    return _add_physics(df, inputs, params, "", axis, azimuth_mode, poa_max).drop(site)


def add_physics_features(
    df: DataFrame,
    country: str = "DE",
    site: SiteConfig | None = None,
    axis: Axis = WIDE,
    azimuth_mode: str = "as_coded",
    poa_max: float | None = None,
) -> DataFrame:
    """The same six columns on a wide frame, inputs and outputs prefixed by ``{country}_``."""
    config = site or SiteConfig()
    inputs = {
        "temperature": f"{country}_temperature",
        "direct": f"{country}_radiation_direct_horizontal",
        "diffuse": f"{country}_radiation_diffuse_horizontal",
    }
    params = {c: F.lit(getattr(config, c)) for c in SITE_PARAMETERS}
    return _add_physics(df, inputs, params, f"{country}_", axis, azimuth_mode, poa_max)


def add_calendar_features(df: DataFrame, axis: Axis = TALL) -> DataFrame:
    """Sine and cosine of hour of day and day of year (a year of 365.25 days)."""
    hour_sin, hour_cos = sun.cyclic(F.hour(axis.ts), 24.0)
    doy_sin, doy_cos = sun.cyclic(F.dayofyear(axis.ts), 365.25)
    return df.withColumns(
        {"hour_sin": hour_sin, "hour_cos": hour_cos, "doy_sin": doy_sin, "doy_cos": doy_cos}
    )


def add_calendar_parts(df: DataFrame, axis: Axis = TALL) -> DataFrame:
    ts = F.col(axis.ts)
    return df.withColumns(
        {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}
    )
