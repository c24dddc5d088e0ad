from __future__ import annotations

import pytest
from pyspark.sql import Observation

from helioframe.functions.exprs import measure
from helioframe.operators import clean
from tests.conftest import column

READING = "series_id string, ts timestamp_ntz, generation double, capacity double"
WEATHER = "series_id string, ts timestamp_ntz, direct double, diffuse double"


@pytest.fixture(scope="module")
def anomalies(frame):
    return frame(
        [
            ("a", "2018-06-21 02:00:00", 50.0, 45000.0),
            ("a", "2018-06-21 03:00:00", 0.5, 45000.0),
            ("a", "2018-06-21 04:00:00", None, 45000.0),
            ("a", "2018-06-21 05:00:00", 7.0, 45000.0),
            ("a", "2018-06-21 14:00:00", 25000.0, 45000.0),
        ],
        READING,
    )


def test_night_output_is_removed_and_counted(anomalies):
    seen = Observation("clips")
    out = clean.clip_nighttime_generation(anomalies, observation=seen)
    # An unsorted action: the sampling pass of a sort would be counted too.
    assert [r["generation"] for r in out.collect()] == [0.0, 0.5, None, 7.0, 25000.0]
    assert seen.get["night_clips"] == 1
    assert column(anomalies, "generation")[0] == 50.0


def test_night_irradiance_clears_both_components(frame):
    df = frame(
        [
            ("a", "2018-06-21 02:00:00", 3.0, 2.0),
            ("a", "2018-06-21 03:00:00", 3.0, None),
            ("a", "2018-06-21 04:00:00", 3.0, 2.0),
            ("a", "2018-06-21 14:00:00", 600.0, 200.0),
        ],
        WEATHER,
    )
    out = clean.clip_nighttime_irradiance(df)
    assert column(out, "direct") == [0.0, 3.0, 0.0, 600.0]
    assert column(out, "diffuse") == [0.0, None, 0.0, 200.0]


@pytest.mark.parametrize(
    "generation,capacity,expected",
    [
        (25000.0, 45000.0, 25000.0 / 45000.0),
        (50000.0, 45000.0, 1.0),
        (-5.0, 45000.0, 0.0),
        (1000.0, None, None),
        (None, 45000.0, None),
        (5.0, 0.0, 1.0),
        (0.0, 0.0, None),
        (-5.0, 0.0, 0.0),
    ],
)
def test_capacity_factor_edges(frame, generation, capacity, expected):
    df = frame([(generation, capacity)], "generation double, capacity double")
    assert clean.normalize_to_capacity_factor(df).first()["cf"] == expected


def test_ghi_needs_both_components(frame):
    df = frame([(500.0, 200.0), (600.0, 150.0), (1.0, None)], "direct double, diffuse double")
    assert [r["ghi"] for r in clean.add_ghi(df).collect()] == [700.0, 750.0, None]


def test_measure_turns_nan_into_null(frame):
    df = frame([(float("nan"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(measure("x")).collect()] == [None, 1.5, None]


def test_audit_counts_each_rule(anomalies, frame):
    weather = frame([("a", "2018-06-21 02:00:00", 3.0, 2.0)], WEATHER)
    rows = {r["rule"]: r["rows_changed"] for r in clean.cleaning_audit(anomalies, weather).collect()}
    assert rows == {"night_clips": 1, "over_capacity": 0, "irradiance_clips": 1}
