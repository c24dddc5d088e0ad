"""Irradiance, cell temperature and theoretical output as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.functions.exprs import at_least, clip, ratio

# Constants of crystalline silicon panels and of the clear-sky model.
NOCT_DEG_C = 45.0
NOCT_IRRADIANCE = 800.0
NOCT_AIR_TEMP = 20.0
TEMP_COEFFICIENT_PER_C = 0.004
STC_TEMP = 25.0
STC_IRRADIANCE = 1000.0
GROUND_ALBEDO = 0.20
HAURWITZ_SCALE = 1098.0
HAURWITZ_DECAY = 0.057
MIN_COS_ZENITH = 1e-3
MIN_BEAM_ELEVATION_DEG = 1.0
MAX_CLEARNESS = 1.5


def clear_sky_from_up(up: Column) -> Column:
    """Haurwitz clear-sky irradiance from the cosine of the zenith angle; 0 by night."""
    cos_zenith = F.greatest(up, F.lit(MIN_COS_ZENITH))
    clear = HAURWITZ_SCALE * cos_zenith * F.exp(F.lit(-HAURWITZ_DECAY) / cos_zenith)
    return F.when(up > 0, clear).when(up <= 0, F.lit(0.0))


def clear_sky_ghi(elevation: Column) -> Column:
    """Haurwitz clear-sky irradiance; 0 with the sun at or below the horizon."""
    return clear_sky_from_up(F.sin(F.radians(elevation)))


def clearness_index(ghi: Column, clear: Column) -> Column:
    """Measured over clear-sky irradiance in [0, 1.5]; 0 at night whatever was measured."""
    by_day = clip(ratio(ghi, clear), 0.0, MAX_CLEARNESS)
    return F.when(clear > 1.0, by_day).when(clear <= 1.0, F.lit(0.0))


def cos_incidence(elevation: Column, sun_azimuth: Column, tilt: Column, facing: Column) -> Column:
    el, t = F.radians(elevation), F.radians(tilt)
    turn = F.cos(F.radians(sun_azimuth - facing))
    return clip(F.sin(el) * F.cos(t) + F.cos(el) * F.sin(t) * turn, -1.0, 1.0)


def angle_of_incidence(
    elevation: Column, sun_azimuth: Column, tilt: Column, facing: Column
) -> Column:
    return F.degrees(F.acos(cos_incidence(elevation, sun_azimuth, tilt, facing)))


def panel_irradiance(
    direct: Column,
    diffuse: Column,
    up: Column,
    cos_aoi: Column,
    cos_tilt: Column,
    albedo: float = GROUND_ALBEDO,
    poa_max: float | None = None,
) -> Column:
    """Beam, isotropic sky and ground-reflected irradiance on a tilted panel.

    Takes the upward component of the sun vector and the cosines of incidence and tilt.
    Near the horizon the beam term is amplified by up to 1 / sin(1 degree); ``poa_max``
    bounds the sum where that is unwanted.
    """
    lift = F.greatest(up, F.lit(math.sin(math.radians(MIN_BEAM_ELEVATION_DEG))))
    beam = F.when(up > 0, direct * at_least(cos_aoi, 0.0) / lift).when(up <= 0, F.lit(0.0))
    sky = diffuse * (1.0 + cos_tilt) / 2.0
    ground = (direct + diffuse) * albedo * (1.0 - cos_tilt) / 2.0
    total = at_least(beam + sky + ground, 0.0)
    return total if poa_max is None else clip(total, 0.0, poa_max)


def plane_of_array(
    direct: Column,
    diffuse: Column,
    elevation: Column,
    sun_azimuth: Column,
    tilt: Column,
    facing: Column,
    albedo: float = GROUND_ALBEDO,
    poa_max: float | None = None,
) -> Column:
    """``panel_irradiance`` from angles in degrees."""
    return panel_irradiance(
        direct,
        diffuse,
        F.sin(F.radians(elevation)),
        cos_incidence(elevation, sun_azimuth, tilt, facing),
        F.cos(F.radians(tilt)),
        albedo,
        poa_max,
    )


def cell_temperature(ambient: Column, poa: Column, noct: float = NOCT_DEG_C) -> Column:
    return ambient + (noct - NOCT_AIR_TEMP) * poa / NOCT_IRRADIANCE


def theoretical_capacity_factor(
    poa: Column, cell: Column, temp_coef: float = TEMP_COEFFICIENT_PER_C
) -> Column:
    return clip(poa / STC_IRRADIANCE * (1.0 - temp_coef * (cell - STC_TEMP)), 0.0, 1.0)
