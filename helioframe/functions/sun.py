"""Sun geometry as Column expressions. Angles in degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.functions.exprs import as_column, clip

AZIMUTH_MODES = ("as_coded", "documented")


def utc_hour(ts: Column | str) -> Column:
    """Hour of day with its fraction."""
    t = as_column(ts)
    return F.hour(t) + F.minute(t) / F.lit(60.0) + F.second(t) / F.lit(3600.0)


def day_angle(ts: Column | str) -> Column:
    """Day of year as an angle in radians, zero near the March equinox."""
    # 81 days to the equinox, a year of 365 days.
    return F.radians((F.dayofyear(as_column(ts)) - 81) * F.lit(360.0) / F.lit(365.0))


def equation_of_time(angle: Column) -> Column:
    """Minutes by which apparent solar time runs ahead of mean solar time."""
    # The published three-term fit.
    return 9.87 * F.sin(2 * angle) - 7.53 * F.cos(angle) - 1.5 * F.sin(angle)


def declination(angle: Column) -> Column:
    return 23.45 * F.sin(angle)


def hour_angle(hour: Column, longitude: Column, eot: Column) -> Column:
    """Degrees from solar noon, 15 per hour."""
    return 15.0 * (hour + longitude / 15.0 + eot / 60.0 - 12.0)


@dataclass(frozen=True)
class SunVector:
    """Direction of the sun as unit vector components east, north and up.

    Elevation, bearing and the angle to any panel are dot products of it, so irradiance
    needs no inverse trigonometry.
    """

    east: Column
    north: Column
    up: Column


def sun_vector(
    sin_lat: Column, cos_lat: Column, sin_decl: Column, cos_decl: Column, ha: Column
) -> SunVector:
    """Components from the sines and cosines of latitude and declination; ``ha`` in degrees."""
    turn = F.radians(ha)
    return SunVector(
        east=-cos_decl * F.sin(turn),
        north=sin_decl * cos_lat - cos_decl * sin_lat * F.cos(turn),
        up=sin_lat * sin_decl + cos_lat * cos_decl * F.cos(turn),
    )


def elevation(up: Column) -> Column:
    """Angle above the horizon."""
    return F.degrees(F.asin(clip(up, -1.0, 1.0)))


def half_turn(mode: str) -> bool:
    """Whether ``mode`` carries a half turn on top of the true bearing."""
    if mode not in AZIMUTH_MODES:
        raise ValueError(f"azimuth mode must be one of {AZIMUTH_MODES}, got {mode!r}")
    return mode == "as_coded"


def azimuth(east: Column, north: Column, mode: str = "as_coded") -> Column:
    """Compass direction of the sun.

    ``documented`` is the north-based bearing (180 = south). ``as_coded`` carries a further
    half turn, which the established feature values of this data contain; it is the
    default so that results agree with them.
    """
    turn = 180.0 if half_turn(mode) else 0.0
    return F.pmod(F.degrees(F.atan2(east, north)) + turn, F.lit(360.0))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = F.lit(2.0 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
