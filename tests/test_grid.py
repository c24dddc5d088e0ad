from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from helioframe.operators import gaps, grid
from helioframe.operators.lags import add_lag_features, add_lag_features_by_join
from helioframe.schema import Axis
from tests.conftest import column, hours

VALUE = "series_id string, ts timestamp_ntz, x double"


def test_absent_hour_becomes_null(frame):
    df = frame([("a", "2018-06-21 00:00:00", 10.0), ("a", "2018-06-21 02:00:00", 20.0)], VALUE)
    out = grid.align_to_window(df, "2018-06-21 00:00:00", "2018-06-21 02:00:00")
    assert column(out, "x") == [10.0, None, 20.0]


@pytest.mark.parametrize("span", [24 * 7, 1344])
def test_window_is_inclusive_and_exact(frame, span):
    rows = [
        ("a", "2017-12-31 23:00:00", 1.0),
        ("a", "2018-01-01 00:00:00", 2.0),
        ("a", "2018-06-21 00:30:00", 3.0),
        ("a", "2018-12-31 23:00:00", 4.0),
        ("b", "2020-01-01 00:00:00", 5.0),
    ]
    out = grid.align_to_window(
        frame(rows, VALUE), "2018-01-01", "2018-12-31 23:00:00", span_hours=span
    ).cache()
    start, end = "2018-01-01", "2018-12-31 23:00:00"
    checks = out.groupBy("series_id").agg(grid.is_aligned(out, start, end).alias("ok"))
    assert {r["series_id"]: r["ok"] for r in checks.collect()} == {"a": True, "b": True}
    kept = out.where("x IS NOT NULL").collect()
    assert sorted(r["x"] for r in kept) == [2.0, 4.0]
    out.unpersist()


def test_duplicates_fail_or_average(frame):
    df = frame(
        [("a", "2018-01-01 01:00:00", 1.0), ("a", "2018-01-01 01:00:00", 3.0)], VALUE
    )
    with pytest.raises(Exception, match="duplicate hour"):
        grid.align_to_window(df, "2018-01-01", "2018-01-01 02:00:00").collect()
    mean = grid.align_to_window(df, "2018-01-01", "2018-01-01 02:00:00", on_duplicate="mean")
    assert column(mean, "x") == [None, 2.0, None]
    assert grid.duplicate_hours(df).first()["n"] == 2
    with pytest.raises(ValueError):
        grid.align_to_window(df, "2018-01-01", "2018-01-02", on_duplicate="first")


def test_feeds_join_on_common_series(frame):
    left = frame([("a", "2018-01-01 00:00:00", 1.0), ("b", "2018-01-01 00:00:00", 9.0)], VALUE)
    right = frame([("a", "2018-01-01 01:00:00", 2.0)], "series_id string, ts timestamp_ntz, y double")
    out = grid.align_feeds([left, right], "2018-01-01", "2018-01-01 02:00:00")
    assert column(out, "series_id") == ["a"] * 3
    assert column(out, "x") == [1.0, None, None]
    assert column(out, "y") == [None, 2.0, None]
    with pytest.raises(ValueError, match="share"):
        grid.align_feeds([left, left], "2018-01-01", "2018-01-02")


def test_listed_series_without_readings_get_a_grid(frame, spark):
    df = frame([("a", "2018-01-01 00:00:00", 1.0)], VALUE)
    listed = spark.createDataFrame([("a",), ("z",)], "series_id string")
    out = grid.align_to_window(df, "2018-01-01", "2018-01-01 03:00:00", series=listed)
    assert {r["series_id"]: r["count"] for r in out.groupBy("series_id").count().collect()} == {
        "a": 4,
        "z": 4,
    }


def test_hourly_grid_counts(spark):
    series = spark.createDataFrame([("a",), ("b",)], "series_id string")
    built = grid.hourly_grid(spark, "2015-01-01", "2019-12-31 23:00:00", series)
    assert built.count() == 2 * 43824
    assert built.distinct().count() == 2 * 43824
    single = grid.hourly_grid(spark, "2018-01-01", "2018-01-02", axis=Axis(keys=(), ts="ts"))
    assert single.count() == 25


def test_fully_present_feed_equals_join_form(frame, spark):
    rng = random.Random(5)
    rows = [
        (s, t, rng.random()) for s in "abc" for t in hours("2018-01-01", 400) if rng.random() < 0.4
    ]
    df = frame(rows, VALUE)
    start, end = "2018-01-01", "2018-01-17 15:00:00"
    aligned = grid.align_to_window(df, start, end, span_hours=48)
    joined = grid.align_by_join(df, grid.hourly_grid(spark, start, end, df))
    assert aligned.exceptAll(joined).isEmpty() and joined.exceptAll(aligned).isEmpty()


@pytest.mark.parametrize(
    "values,expected",
    [
        ([10.0, None, 30.0, 40.0, 50.0], [10.0, 20.0, 30.0, 40.0, 50.0]),
        ([10.0] + [None] * 8 + [100.0], [10.0] + [None] * 8 + [100.0]),
        ([None, 1.0, None, None, None, 5.0, None], [None, 1.0, 2.0, 3.0, 4.0, 5.0, None]),
        ([1.0] + [None] * 4 + [6.0], [1.0] + [None] * 4 + [6.0]),
    ],
)
def test_short_gaps(frame, values, expected):
    df = frame([("a", t, v) for t, v in zip(hours("2018-01-01", len(values)), values, strict=True)], VALUE)
    for span in (3, 5, 240):
        assert column(gaps.interpolate_short_gaps(df, ["x"], 3, span_hours=span), "x") == expected


def _runs(values):
    """Maximal runs of missing positions as (first, last)."""
    out, start = [], None
    for i, v in enumerate([*values, 0.0]):
        if v is None and start is None:
            start = i
        elif v is not None and start is not None:
            out.append((start, i - 1))
            start = None
    return out


def test_fill_and_runs_agree_with_pandas(frame):
    rng = random.Random(11)
    series = {
        s: [None if rng.random() < p else float(rng.randint(0, 99)) for _ in range(500)]
        for s, p in (("a", 0.3), ("b", 0.7), ("c", 0.97), ("d", 1.0))
    }
    stamps = hours("2018-01-01", 500)
    df = frame([(s, t, v) for s, vs in series.items() for t, v in zip(stamps, vs, strict=True)], VALUE).cache()
    filled = gaps.interpolate_short_gaps(df, ["x"], 3, span_hours=24)
    runs = gaps.gap_runs(df, "x", 3, span_hours=24).toPandas()
    for s, values in series.items():
        expected = pd.Series(values, index=stamps, dtype="float64")
        inside = expected.interpolate(method="time", limit_area="inside")
        wanted = expected.copy()
        found = _runs(values)
        for first, last in found:
            if last - first + 1 <= 3:
                wanted.iloc[first : last + 1] = inside.iloc[first : last + 1]
        got = pd.Series(column(filled.where(F.col("series_id") == s), "x"), index=stamps, dtype="float64")
        pd.testing.assert_series_equal(got, wanted, check_names=False, rtol=1e-12)
        mine = runs[runs.series_id == s].sort_values("gap_start")
        assert list(mine.gap_start) == [stamps[a] for a, _ in found]
        assert list(mine.gap_hours) == [b - a + 1 for a, b in found]
        assert list(mine.filled) == [b - a < 3 and a > 0 and b < 499 for a, b in found]
    df.unpersist()


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Scan ")


def test_runs_and_lags_read_their_input_once(frame):
    df = frame([("a", t, float(i) if i % 3 else None) for i, t in enumerate(hours("2018-01-01", 50))], VALUE)
    for out, shuffles in ((gaps.gap_runs(df, "x"), 2), (add_lag_features_by_join(df, "x"), 1)):
        assert _exchanges(out) == (shuffles, 1)


def test_a_run_may_cross_many_spans(frame):
    values = [None] * 30 + [1.0] + [None] * 100 + [2.0] * 24 + [None] * 24 + [3.0, None]
    df = frame([("a", t, v) for t, v in zip(hours("2018-01-01", len(values)), values, strict=True)], VALUE)
    for span in (1, 2, 5, 24, 1000):
        runs = gaps.gap_runs(df, "x", span_hours=span).orderBy("gap_start").collect()
        assert [(r["gap_hours"], r["filled"]) for r in runs] == [(30, False), (100, False), (24, False), (1, False)]


def test_lags_by_merge_keep_repeated_rows(frame):
    df = frame([("a", t, 1.0) for t in hours("2018-01-01", 3) for _ in range(2)], VALUE)
    out = add_lag_features_by_join(df, "x", (1,)).collect()
    assert len(out) == 6 and sorted(str(r["x_lag_1h"]) for r in out) == ["1.0"] * 4 + ["None"] * 2
    assert add_lag_features_by_join(df, "x", ()).count() == 6


def test_lags_are_exact_in_time(frame):
    df = frame([("a", t, float(i)) for i, t in enumerate(hours("2018-01-01", 200))], VALUE)
    for out in (
        add_lag_features(df, "x", (1, 24, 168), span_hours=168),
        add_lag_features_by_join(df, "x"),
    ):
        rows = out.orderBy("ts").collect()
        assert rows[100]["x_lag_1h"] == 99.0 and rows[100]["x_lag_24h"] == 76.0
        assert rows[199]["x_lag_168h"] == 31.0
        assert [r["x_lag_24h"] for r in rows[:24]] == [None] * 24
        assert all(r["x_lag_24h"] == r["x"] - 24 for r in rows[24:])
        assert len(rows) == 200


def test_lag_skips_to_null_where_the_hour_is_absent(frame):
    df = frame([("a", "2018-01-01 00:00:00", 1.0), ("a", "2018-01-01 02:00:00", 3.0)], VALUE)
    assert column(add_lag_features(df, "x", [1]), "x_lag_1h") == [None, None]
    assert column(add_lag_features(df, "x", [2]), "x_lag_2h") == [None, 1.0]
    with pytest.raises(ValueError):
        add_lag_features(df, "x", [0])


def test_filled_hours_are_counted_in_the_pass_that_fills(spark):
    day = datetime(2020, 1, 1)
    values = [1.0, None, None, 4.0, None, None, None, None, 9.0, None]
    rows = [("a", day + timedelta(hours=i), v, None if i == 0 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, x double, y double")
    counted = gaps.filled_hours(df, ["x", "y"], 3, span_hours=4)
    assert {r["column"]: r.filled_hours for r in counted.collect()} == {"x": 2, "y": 0}
    seen = Observation()
    filled = gaps.interpolate_short_gaps(df, ["x", "y"], 3, span_hours=4, observation=seen)
    assert filled.columns == df.columns and filled.collect() and seen.get == {"x": 2, "y": 0}
