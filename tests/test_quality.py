from __future__ import annotations

import pytest

from helioframe.operators import quality as q
from helioframe.plans.profile import write_profile

READ = "series_id string, ts timestamp_ntz, generation double, capacity double, load double"
WX = "series_id string, ts timestamp_ntz, temperature double, direct double, diffuse double"


@pytest.fixture(scope="module")
def readings(frame):
    return frame(
        [
            ("a", "2017-12-31 23:00:00", -1.0, 100.4, 1.0),
            ("a", "2018-01-01 02:00:00", 5.0, 110.0, None),
            ("a", "2018-01-01 12:00:00", None, None, 1.0),
            ("a", "2018-02-01 12:00:00", 50.0, 120.0, 1.0),
            ("a", "2018-02-02 12:00:00", 70.0, 150.0, 1.0),
        ],
        READ,
    )


@pytest.fixture(scope="module")
def weather(frame):
    return frame(
        [
            ("a", "2018-01-01 02:00:00", -31.0, 3.0, None),
            ("a", "2018-01-01 04:00:00", 46.0, 3.0, 2.0),
            ("a", "2018-02-01 12:00:00", 10.0, 100.0, 10.0),
            ("a", "2018-02-02 12:00:00", 10.0, 200.0, 10.0),
            ("a", "2018-02-03 12:30:00", None, None, None),
        ],
        WX,
    )


def test_coverage_and_overlap(readings, weather):
    covered = q.coverage({"time_series": readings, "weather": weather})
    assert {r["source"]: r["n_rows"] for r in covered.collect()} == {"time_series": 5, "weather": 5}
    row = q.usable_overlap(covered).first()
    assert str(row["overlap_start"]) == "2018-01-01 02:00:00"
    assert str(row["overlap_end"]) == "2018-02-02 12:00:00"
    assert row["overlap_hours"] == 32 * 24 + 10 + 1
    assert row["overlap_years"] == row["overlap_hours"] / 8760


def test_completeness(readings, weather):
    rows = q.column_completeness({"time_series": readings, "weather": weather}).collect()
    assert {(r["source"], r["column"]): r["present_pct"] for r in rows} == {
        ("time_series", "generation"): 80.0,
        ("time_series", "capacity"): 80.0,
        ("time_series", "load"): 80.0,
        ("weather", "temperature"): 80.0,
        ("weather", "direct"): 80.0,
        ("weather", "diffuse"): 60.0,
    }
    assert rows[0]["column"] == "diffuse"
    yearly = {r["year"]: r["present_pct"] for r in q.completeness_by_year(readings).collect()}
    assert yearly == {2017: 100.0, 2018: 75.0}


def test_anomalies(readings, weather):
    row = q.anomaly_counts(readings, weather).first()
    assert row["negative_generation"] == 1 and row["negative_generation_pct"] == 20.0
    assert row["night_generation"] == 1
    assert row["temperature_out_of_range"] == 2
    # 3 + missing counts as 3; 04:00 is not night for this check.
    assert row["night_irradiance"] == 1


def test_correlation(readings, weather, frame):
    paired = q.paired_feeds(readings, weather)
    assert paired.count() == 2
    assert q.overall_correlation(paired).first()["corr"] == pytest.approx(1.0)
    assert [(r["month"], r["corr"]) for r in q.correlation_by_month(paired).collect()] == [(2, 1.0)]
    constant = frame([(1.0, 2.0), (1.0, 3.0)], "generation double, ghi double")
    assert q.overall_correlation(constant).first()["corr"] is None


def test_capacity(readings):
    yearly = q.capacity_by_year(readings)
    assert [tuple(r) for r in yearly.collect()] == [(2017, 100.0, 100.0), (2018, 110.0, 150.0)]
    assert q.capacity_growth(yearly).first()["growth_pct"] == pytest.approx(50.0)
    assert q.capacity_growth(yearly.where("year = 2018")).first()["growth_pct"] == 0.0
    assert q.capacity_timeline(readings).count() == 4


def test_heatmap(readings):
    rows = {r["year"]: r for r in q.missing_heatmap(readings).collect()}
    assert rows[2018]["m01"] == 0.5 and rows[2018]["m02"] == 0.0 and rows[2018]["m03"] is None
    assert rows[2017]["m12"] == 0.0 and len(rows[2017]) == 13


def test_one_year(readings, weather):
    rows = q.one_year(readings, weather, 2018).orderBy("ts").collect()
    assert [(r["generation"], r["ghi"]) for r in rows] == [
        (5.0, None), (None, 5.0), (None, None), (50.0, 110.0), (70.0, 210.0), (None, None),
    ]


@pytest.mark.parametrize("by", [(), ("series_id",)])
def test_profile_tables_equal_the_single_operators(readings, weather, spark, tmp_path, by):
    names = write_profile(readings, weather, str(tmp_path), by=by)
    feeds = {"time_series": readings, "weather": weather}
    paired = q.paired_feeds(readings, weather)
    single = {
        "coverage": q.coverage(feeds, by=by),
        "usable_overlap": q.usable_overlap(q.coverage(feeds, by=by), by),
        "column_completeness": q.column_completeness(feeds, by=by),
        "completeness_by_year": q.completeness_by_year(readings, by=by),
        "anomaly_counts": q.anomaly_counts(readings, weather, by=by),
        "correlation": q.overall_correlation(paired, by=by),
        "correlation_by_month": q.correlation_by_month(paired, by=by),
        "capacity_by_year": q.capacity_by_year(readings, by=by),
        "capacity_growth": q.capacity_growth(q.capacity_by_year(readings, by=by), by),
        "missing_heatmap": q.missing_heatmap(readings, by=by),
        "capacity_timeline": q.capacity_timeline(readings),
        "one_year": q.one_year(readings, weather),
    }
    assert sorted(names) == sorted(single)
    for name, want in single.items():
        got = spark.read.parquet(f"{tmp_path}/{name}")
        assert got.columns == want.columns, name
        key = lambda r: tuple(str(v) for v in r)
        for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == (pytest.approx(y) if isinstance(y, float) else y), name


def test_growth_of_each_series_is_its_own(spark):
    rows = [("a", 2019, 10.0), ("a", 2020, 11.0), ("b", 2019, 1000.0), ("b", 2020, 1100.0), ("c", 2020, 5.0)]
    feed = spark.createDataFrame(rows, "series_id string, year int, capacity double").selectExpr(
        "series_id", "make_timestamp_ntz(year, 6, 1, 12, 0, 0) AS ts", "capacity"
    )
    by = ("series_id",)
    got = q.capacity_growth(q.capacity_by_year(feed, by=by), by).collect()
    assert {r.series_id: (r.n_years, round(r.growth_pct, 6)) for r in got} == {
        "a": (2, 10.0),
        "b": (2, 10.0),
        "c": (1, 0.0),
    }
    heat = q.missing_heatmap(feed, "capacity", by=by).collect()
    assert [(r.series_id, r.year, r.m06, r.m01) for r in heat if r.series_id == "a"] == [
        ("a", 2019, 0.0, None),
        ("a", 2020, 0.0, None),
    ]
