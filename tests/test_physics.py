from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from helioframe.functions import irradiance as irr
from helioframe.operators import physics
from helioframe.schema import PHYSICS_COLUMNS, SiteConfig
from tests.conftest import column, hours


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize(
    "ts,lat,lon,low,high",
    [
        ("2018-03-20 12:00:00", 0.0, 0.0, 87, 90),
        ("2018-12-21 12:00:00", 90.0, 0.0, -90, 0),
        ("2018-06-21 12:00:00", 52.5, 13.4, 55, 65),
        ("2018-06-21 00:00:00", 52.5, 13.4, -90, 0),
    ],
)
def test_elevation(frame, ts, lat, lon, low, high):
    row = physics.solar_position(frame([(ts,)], "ts timestamp_ntz"), lat, lon).first()
    assert low < row["elevation_deg"] < high
    assert row["zenith_deg"] == pytest.approx(90 - row["elevation_deg"])


@pytest.mark.parametrize("mode,expected", [("documented", 170.4), ("as_coded", 350.4)])
def test_azimuth_near_noon(frame, mode, expected):
    df = frame([("2018-06-21 11:00:00",)], "ts timestamp_ntz")
    row = physics.solar_position(df, 51.0, 10.5, azimuth_mode=mode).first()
    assert row["azimuth_deg"] == pytest.approx(expected, abs=0.05)


def test_time_must_be_a_utc_instant(frame):
    df = frame([("noon",)], "ts string", ts="none")
    with pytest.raises(ValueError, match="UTC"):
        physics.solar_position(df, 0.0, 0.0)
    with pytest.raises(ValueError, match="azimuth mode"):
        physics.solar_position(frame([("2018-06-21 11:00:00",)], "ts timestamp_ntz"), 0, 0, azimuth_mode="x")


def test_clear_sky(spark):
    got = [value(spark, irr.clear_sky_ghi(lit(e))) for e in (-5.0, -1.0, 0.0, 10.0, 30.0, 60.0, 90.0)]
    assert got[:3] == [0.0, 0.0, 0.0]
    assert got[3] < got[4] < got[5] < got[6] and 1000 < got[6] < 1100


def test_clearness(spark):
    clear = value(spark, irr.clear_sky_ghi(lit(45.0)))
    index = lambda ghi, c: value(spark, irr.clearness_index(lit(ghi), lit(c)))
    assert index(clear, clear) == pytest.approx(1.0)
    assert index(clear / 2, clear) == pytest.approx(0.5)
    assert index(9 * clear, clear) == 1.5
    assert index(0.0, 0.0) == 0.0
    assert index(None, 0.0) == 0.0 and index(None, clear) is None and index(1.0, None) is None


def test_incidence(spark):
    aoi = lambda *a: value(spark, irr.angle_of_incidence(*[lit(x) for x in a]))
    assert aoi(55, 180, 35, 180) == pytest.approx(0.0, abs=0.01)
    assert aoi(0, 180, 90, 0) > 90


def test_plane_of_array(spark):
    poa = lambda *a, **k: value(spark, irr.plane_of_array(*[lit(x) for x in a], **k))
    assert poa(0, 0, -10, 0, 35, 180) == 0.0
    assert poa(700, 100, 60, 180, 0, 180) == pytest.approx(800, rel=0.02)
    assert poa(None, 100, -10, 0, 35, 180) is None
    assert poa(400, 100, 0.85, 180, 35, 180) > 5000
    assert poa(400, 100, 0.85, 180, 35, 180, poa_max=1500) == 1500


def test_cell_temperature_and_output(spark):
    assert value(spark, irr.cell_temperature(lit(10), lit(0))) == 10
    assert value(spark, irr.cell_temperature(lit(20), lit(800))) == 45
    out = [
        value(spark, irr.theoretical_capacity_factor(lit(g), lit(t)))
        for g, t in ((0, 10), (1000, 25), (1000, 50), (None, 25))
    ]
    assert out == [0.0, 1.0, pytest.approx(0.9), None]


@pytest.fixture(scope="module")
def day(frame):
    stamps = hours("2018-06-21", 24)
    rows = [("a", t, 15.0 + i * 15 / 23, i * 800 / 23, i * 200 / 23) for i, t in enumerate(stamps)]
    return frame(rows, "series_id string, ts timestamp_ntz, temperature double, direct double, diffuse double")


def test_six_columns_within_bounds(day):
    out = physics.add_physics(day)
    assert out.columns == [*day.columns, *PHYSICS_COLUMNS]
    assert all(0 <= v <= 1 for v in column(out, "cf_theory"))
    assert all(0 <= v <= 1.5 for v in column(out, "clearness_index"))


def restated(ts, lat, lon, tilt, facing, direct, diffuse, mode):
    """Plane-of-array irradiance by angles, hour by hour."""
    doy = ts.timetuple().tm_yday
    b = math.radians((doy - 81) * 360 / 365)
    eot = 9.87 * math.sin(2 * b) - 7.53 * math.cos(b) - 1.5 * math.sin(b)
    dec = math.radians(23.45 * math.sin(b))
    ha = math.radians(15 * (ts.hour + lon / 15 + eot / 60 - 12))
    phi = math.radians(lat)
    el = math.asin(math.sin(phi) * math.sin(dec) + math.cos(phi) * math.cos(dec) * math.cos(ha))
    s = -math.cos(dec) * math.sin(ha) / math.cos(el)
    c = (math.sin(dec) - math.sin(el) * math.sin(phi)) / (math.cos(el) * math.cos(phi))
    az = math.degrees(math.atan2(s, c)) + (180 if mode == "as_coded" else 0)
    t = math.radians(tilt)
    cos_aoi = math.sin(el) * math.cos(t) + math.cos(el) * math.sin(t) * math.cos(math.radians(az - facing))
    beam = direct * max(cos_aoi, 0) / math.sin(max(el, math.radians(1))) if el > 0 else 0.0
    sky, ground = (1 + math.cos(t)) / 2, 0.2 * (1 - math.cos(t)) / 2
    return math.degrees(el), beam + diffuse * sky + (direct + diffuse) * ground


@pytest.mark.parametrize("mode", ["as_coded", "documented"])
@pytest.mark.parametrize("site", [SiteConfig(), SiteConfig(-33.9, 151.2, 20.0, 0.0), SiteConfig(0.0, -78.5, 0.0, 90.0)])
def test_vector_form_equals_angles(day, mode, site):
    rows = physics.add_physics(day, site, azimuth_mode=mode).collect()
    for r in rows:
        el, poa = restated(
            r["ts"], site.latitude_deg, site.longitude_deg, site.tilt_deg, site.azimuth_deg,
            r["direct"], r["diffuse"], mode,
        )
        assert r["solar_elevation_deg"] == pytest.approx(el, abs=1e-9)
        assert r["g_poa"] == pytest.approx(poa, rel=1e-9, abs=1e-9)


def test_site_table_and_wide_form_agree_with_one_site(day, spark):
    site = SiteConfig(48.0, 11.0, 30.0, 170.0)
    table = spark.createDataFrame(
        [("a", 48.0, 11.0, 30.0, 170.0)],
        "series_id string, latitude_deg double, longitude_deg double, tilt_deg double, azimuth_deg double",
    )
    one = physics.add_physics(day, site)
    joined = physics.add_physics(day, table)
    wide = day.select(
        F.col("ts").alias("utc_timestamp"),
        F.col("temperature").alias("IT_temperature"),
        F.col("direct").alias("IT_radiation_direct_horizontal"),
        F.col("diffuse").alias("IT_radiation_diffuse_horizontal"),
    )
    prefixed = physics.add_physics_features(wide, "IT", site)
    assert set(prefixed.columns) - set(wide.columns) == {f"IT_{c}" for c in PHYSICS_COLUMNS}
    for c in PHYSICS_COLUMNS:
        assert column(one, c) == column(joined, c) == column(prefixed, f"IT_{c}", "utc_timestamp")


def test_series_without_a_site_keep_their_rows(day, spark):
    empty = spark.createDataFrame(
        [], "series_id string, latitude_deg double, longitude_deg double, tilt_deg double, azimuth_deg double"
    )
    out = physics.add_physics(day, empty)
    assert out.count() == 24 and out.dropna(subset=["g_poa"]).count() == 0
    assert out.dropna(subset=["clearness_index"]).count() == 0


def test_calendar_is_cyclic(frame):
    df = frame([("2018-01-01 00:00:00",), ("2018-01-01 06:00:00",), ("2018-01-01 23:00:00",)], "ts timestamp_ntz")
    rows = physics.add_calendar_features(df).orderBy("ts").collect()
    assert (rows[0]["hour_sin"], rows[0]["hour_cos"]) == pytest.approx((0, 1))
    assert (rows[1]["hour_sin"], rows[1]["hour_cos"]) == pytest.approx((1, 0))
    for r in rows:
        assert r["hour_sin"] ** 2 + r["hour_cos"] ** 2 == pytest.approx(1)
        assert r["doy_sin"] == pytest.approx(math.sin(2 * math.pi / 365.25))
