from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helioframe.operators import scoring, splits
from helioframe.schema import Axis, Split
from tests.conftest import hours

VALUE = "series_id string, ts timestamp_ntz, x double"


def test_split_bounds_are_inclusive(frame):
    stamps = [
        ("2014-12-31 23:59:59", None),
        ("2015-01-01 00:00:00", "train"),
        ("2017-12-31 23:00:00", "train"),
        ("2017-12-31 23:00:01", None),
        ("2018-01-01 00:00:00", "val"),
        ("2018-12-31 23:00:00", "val"),
        ("2019-06-01 12:00:00", "test"),
        ("2020-01-01 00:00:00", None),
    ]
    df = frame([(t, want) for t, want in stamps], "ts timestamp_ntz, want string")
    for r in splits.add_split(df).collect():
        assert r["split"] == r["want"], r
    parts = splits.split_dataset(df)
    assert [p.count() for p in parts] == [2, 2, 1]


def test_end_second_counts_in_full_and_dates_mean_days(frame):
    df = frame([(datetime(2017, 12, 31, 23, 0, 0, 999999),)], "ts timestamp_ntz")
    assert splits.add_split(df).first()["split"] == "train"
    by_day = Split(train_end="2017-12-31")
    late = frame([("2017-12-31 23:59:00",)], "ts timestamp_ntz")
    assert splits.add_split(late, by_day).first()["split"] == "train"


@pytest.mark.parametrize("fraction", [0.1, 0.25])
def test_holdout_is_the_tail_of_each_series(frame, fraction):
    rng = random.Random(3)
    rows = [
        (s, t, None if rng.random() < 0.5 else 1.0)
        for s, n in (("a", 400), ("b", 37), ("c", 3))
        for t in hours("2018-01-01", n)
    ]
    rows += [("c", datetime(2018, 2, 1), 1.0)]
    out = splits.mark_holdout(frame(rows, VALUE), "x", fraction, span_hours=24, per_series=True).collect()
    for s in "abc":
        mine = sorted((r["ts"], r["holdout"]) for r in out if r["series_id"] == s)
        known = sorted(t for k, t, v in rows if k == s and v is not None)
        assert [t for t, _ in mine] == known
        n = max(1, int(len(known) * fraction))
        assert [h for _, h in mine] == [False] * (len(known) - n) + [True] * n


@pytest.mark.parametrize(("fraction", "span"), [(0.1, 24), (0.25, 7), (0.0, 1000), (1.0, 24)])
def test_one_cutoff_holds_for_all_series(frame, fraction, span):
    rng = random.Random(5)
    rows = [
        (s, t, None if rng.random() < 0.5 else 1.0)
        for s, n in (("a", 400), ("b", 300), ("c", 30))
        for t in hours("2018-01-01", n)
    ]
    df = frame(rows, VALUE)
    known = sorted(t for _, t, v in rows if v is not None)
    cut = known[-max(1, int(len(known) * fraction))]
    assert splits.tail_start(df, "x", fraction, span_hours=span) == cut
    out = splits.mark_holdout(df, "x", fraction, span_hours=span).collect()
    assert sorted(r["ts"] for r in out) == known and all(r["holdout"] == (r["ts"] >= cut) for r in out)
    assert splits.mark_holdout(df.where("false"), "x").collect() == []


def test_holdout_without_series_key(frame):
    rows = [(t, 1.0) for t in hours("2018-01-01", 50)]
    df = frame(rows, "ts timestamp_ntz, x double")
    out = splits.mark_holdout(df, "x", axis=Axis(keys=(), ts="ts"), span_hours=24)
    held = sorted(r["ts"] for r in out.where("holdout").collect())
    assert held == hours("2018-01-01", 50)[-5:]


@pytest.fixture(scope="module")
def ten(frame):
    stamps = hours("2018-01-01", 10)
    rows = [
        (m, "val", "a", t, float(i), i + off)
        for m, off in (("persistence", 0.5), ("near", 0.1), ("exact", 0.0))
        for i, t in enumerate(stamps)
    ]
    return frame(
        rows,
        "model string, split string, series_id string, ts timestamp_ntz, y_true double, pred double",
    )


def test_metrics_and_skill(ten):
    scores = {r["model"]: r for r in scoring.add_skill(scoring.score_predictions(ten)).collect()}
    assert (scores["exact"]["rmse"], scores["exact"]["mae"], scores["exact"]["n"]) == (0, 0, 10)
    assert scores["near"]["skill"] == pytest.approx(0.8)
    assert scores["persistence"]["skill"] == pytest.approx(0.0)
    degenerate = scoring.add_skill(scoring.score_predictions(ten), "exact")
    assert {r["skill"] for r in degenerate.collect()} == {None}


def test_scalar_metrics(ten, spark):
    near = scoring.evaluate(ten.where("model = 'near'"))
    base = scoring.evaluate(ten.where("model = 'persistence'"))
    exact = scoring.evaluate(ten.where("model = 'exact'"))
    assert near.rmse == pytest.approx(0.1) and near.n_samples == 10
    assert scoring.skill_score(near, base) == pytest.approx(0.8)
    assert scoring.skill_score(near, base, "mae") == pytest.approx(0.8)
    assert math.isnan(scoring.skill_score(near, exact))
    with pytest.raises(ValueError):
        scoring.skill_score(near, base, "r2")
    with pytest.raises(ValueError):
        scoring.add_skill(ten, metric="r2")
    with pytest.raises(ValueError):
        scoring.evaluate(ten.withColumn("pred", F.lit(None).cast("double")))


def test_group_without_predictions_raises(ten):
    blank = ten.withColumn("pred", F.when(F.col("model") != "near", F.col("pred")))
    with pytest.raises(Exception, match="no complete predictions for near/val"):
        scoring.score_predictions(blank).collect()


def test_truth_and_predictions_match_by_time(frame):
    first = datetime(2018, 1, 1)
    truth = frame(
        [("a", first + timedelta(hours=i), float(i) if i != 2 else None) for i in range(4)],
        "series_id string, ts timestamp_ntz, y_true double",
    )
    pred = frame(
        [("a", first + timedelta(hours=i), 1.0) for i in range(1, 6)],
        "series_id string, ts timestamp_ntz, pred double",
    )
    got = scoring.align_predictions(truth, pred).orderBy("ts").collect()
    assert [r["y_true"] for r in got] == [1.0, 3.0]
