from __future__ import annotations

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.models.base import Forecaster
from helioframe.models.linear import LinearPhysics, LinearWeather
from helioframe.models.simple import (
    DailySeasonalNaive,
    HourOfYearClimatology,
    Persistence,
    PurePhysics,
)
from helioframe.models.trees import BoostedTrees, best_prefix, exhausted
from helioframe.operators.physics import add_physics
from helioframe.operators.splits import add_split
from helioframe.plans.compare import baseline_models, compare_models, default_models, run_one
from helioframe.schema import PHYSICS_FEATURES, WIDE, Split
from helioframe.sources import run_store
from tests.conftest import column, hours

CF = "series_id string, ts timestamp_ntz, cf double"
TWO = Split(
    "2018-01-01 00:00:00", "2018-01-02 23:00:00", "2018-01-03 00:00:00", "2018-01-03 23:00:00",
    "2018-01-04 00:00:00", "2018-01-04 23:00:00",
)


@pytest.fixture(scope="module")
def ramp(frame):
    return frame([("a", t, i / 200) for i, t in enumerate(hours("2018-01-01", 96))], CF)


@pytest.mark.parametrize("model,k", [(Persistence, 1), (DailySeasonalNaive, 24)])
def test_lagged_forecasts_restart_with_each_split(ramp, model, k):
    whole = column(model().transform(ramp), "pred")
    assert whole == [None] * k + [i / 200 for i in range(96 - k)]
    restarted = column(model(split=TWO).transform(ramp), "pred")
    for i, (a, b) in enumerate(zip(whole, restarted, strict=True)):
        inside = i - (0 if i < 48 else 48 if i < 72 else 72)
        assert b == (a if inside >= k else None)


def test_climatology_keys_by_month_day_hour(frame):
    rows = [("a", datetime(y, 2, 28, 12), v) for y, v in ((2015, 0.2), (2016, 0.4), (2017, None))]
    model = HourOfYearClimatology()
    with pytest.raises(RuntimeError):
        model.transform(frame(rows, CF))
    model.fit(frame(rows, CF))
    asked = frame(
        [
            ("a", datetime(2018, 2, 28, 12), None),
            ("a", datetime(2016, 2, 29, 12), None),
            ("b", datetime(2018, 2, 28, 12), None),
        ],
        CF,
    )
    got = {(r["series_id"], r["ts"].day): r["pred"] for r in model.transform(asked).collect()}
    assert got[("a", 28)] == pytest.approx(0.3)
    assert got[("a", 29)] is None and got[("b", 28)] is None


@pytest.fixture(scope="module")
def weather_frame(frame):
    rng = random.Random(42)
    rows = []
    for i, t in enumerate(hours("2016-05-01", 24 * 40)):
        sun = max(0.0, math.sin((t.hour - 6) * math.pi / 12))
        direct, diffuse = 600 * sun * rng.uniform(0.2, 1), 150 * sun * rng.uniform(0.5, 1)
        temp = 10 + 8 * sun + rng.gauss(0, 2)
        cf = min(1.0, max(0.0, (direct + diffuse) / 900 + rng.gauss(0, 0.02)))
        rows.append(
            ("a", t, cf if i % 17 else None, temp if i % 23 else None, direct, diffuse, direct + diffuse)
        )
    df = frame(
        rows,
        "series_id string, ts timestamp_ntz, cf double, temperature double, direct double, "
        "diffuse double, ghi double",
    )
    return add_physics(df).cache()


@pytest.mark.parametrize("model", [LinearWeather, LinearPhysics])
def test_linear_equals_least_squares(weather_frame, model):
    fitted = model().fit(weather_frame)
    pdf = fitted.transform(weather_frame).toPandas()
    cols = list(fitted.feature_cols)
    clean = pdf.dropna(subset=["cf", *cols])
    x = np.column_stack([clean[cols].to_numpy(), np.ones(len(clean))])
    beta = np.linalg.lstsq(x, clean["cf"].to_numpy(), rcond=None)[0]
    np.testing.assert_allclose(clean["pred"], np.clip(x @ beta, 0, 1), atol=1e-9)
    assert pdf.loc[pdf[cols].isna().any(axis=1), "pred"].isna().all()
    assert pdf["pred"].dropna().between(0, 1).all()
    residual = ((clean["pred"] - clean["cf"]) ** 2).mean()
    assert residual < clean["cf"].var()


def test_linear_edges(weather_frame):
    with pytest.raises(RuntimeError):
        LinearWeather().transform(weather_frame)
    with pytest.raises(ValueError):
        LinearWeather().fit(weather_frame.where("cf IS NULL"))
    constant = weather_frame.withColumn("temperature", F.lit(1.0))
    fitted = LinearWeather().fit(constant)
    assert fitted.coefficients[1] == pytest.approx(0.0)


def test_pure_physics_is_bounded(weather_frame):
    out = PurePhysics().transform(weather_frame.withColumn("cf_theory", F.lit(1.7)))
    assert out.first()["pred"] == 1.0


def test_best_prefix():
    assert best_prefix([3, 2, 1, 1.5, 1.4], 50) == 3
    assert best_prefix([3, 2, 2.5, 2.6, 1.0], 2) == 2
    assert best_prefix([1.0], 5) == 1


@pytest.fixture(scope="module")
def tree_rows(frame):
    rng = random.Random(0)
    rows = []
    for t in hours("2018-01-01", 500):
        f1, f2 = rng.random(), rng.random()
        y = min(1.0, max(0.0, 0.5 * f1 + 0.3 * f2 + rng.gauss(0, 0.05)))
        rows.append(("a", t, f1 if rng.random() > 0.05 else None, f2, y))
    return frame(rows, "series_id string, ts timestamp_ntz, f1 double, f2 double, cf double").cache()


def test_boosted_trees(tree_rows):
    model = BoostedTrees(
        feature_cols=("f1", "f2"), n_estimators=8, max_depth=3, learning_rate=0.2,
        early_stopping_rounds=3,
    )
    assert model.feature_importance is None
    with pytest.raises(RuntimeError):
        model.transform(tree_rows)
    model.fit(tree_rows)
    assert 1 <= model.rounds <= 8 and model.model.getNumTrees == model.rounds
    pdf = model.transform(tree_rows).toPandas()
    assert len(pdf) == 500 and pdf["pred"].between(0, 1).all()
    assert ((pdf["pred"] - pdf["cf"]) ** 2).mean() < pdf["cf"].var()
    importance = model.feature_importance
    assert list(importance) == ["f1", "f2"] and importance["f1"] > importance["f2"]
    assert sum(importance.values()) == pytest.approx(1.0)


def test_boosted_trees_need_features(tree_rows):
    with pytest.raises(ValueError, match="feature_cols"):
        BoostedTrees().fit(tree_rows)


def test_early_stopping_keeps_the_leading_trees(tree_rows):
    full = BoostedTrees(
        feature_cols=("f1", "f2"), n_estimators=7, max_depth=2, early_stopping_rounds=99, block_rounds=3,
    )
    full.fit(tree_rows)
    assert len(full.errors) == 7 and full.rounds == full.errors.index(min(full.errors)) + 1
    one = BoostedTrees(
        feature_cols=("f1", "f2"), n_estimators=7, max_depth=2, early_stopping_rounds=99, block_rounds=7,
    ).fit(tree_rows)
    # The size of a block changes when errors are looked at, not what is grown.
    assert one.errors == pytest.approx(full.errors)
    assert [t.toDebugString.split("\n", 1)[1] for t in one.model.trees] == [t.toDebugString.split("\n", 1)[1] for t in full.model.trees]
    cut = full.model.first(2)
    assert cut.getNumTrees == 2 and cut.treeWeights == full.model.treeWeights[:2]


def test_growing_ends_when_the_error_stops_falling(tree_rows):
    noise = tree_rows.withColumn("cf", F.when(F.xxhash64("ts") % 2 == 0, 0.0).otherwise(1.0))
    model = BoostedTrees(
        feature_cols=("f1", "f2"), n_estimators=200, learning_rate=0.9, early_stopping_rounds=4, block_rounds=2,
    ).fit(noise)
    assert len(model.errors) < 40 and len(model.errors) - model.rounds <= 4 + 2
    assert exhausted([3, 2, 2, 2], 2) and not exhausted([3, 2, 2], 2) and not exhausted([], 2)


def test_one_split_equals_a_fit_by_hand(frame):
    """Stumps on a single two-valued feature: every round moves both sides by the rate towards their means."""
    rows = [("a", t, float(i % 2), 0.8 if i % 2 else 0.2) for i, t in enumerate(hours("2018-01-01", 100))]
    table = frame(rows, "series_id string, ts timestamp_ntz, f double, cf double")
    model = BoostedTrees(
        feature_cols=("f",), n_estimators=5, max_depth=1, learning_rate=0.5, subsample=1.0, feature_fraction=1.0,
    ).fit(table)
    out = {r["f"]: r["pred"] for r in model.transform(table).collect()}
    assert model.rounds == 5 and out[1.0] == pytest.approx(0.8 - 0.3 / 32) and out[0.0] == pytest.approx(0.2 + 0.3 / 32)
    assert model.errors == pytest.approx([(0.3 / 2**k) ** 2 for k in range(1, 6)])


class Half(Forecaster):
    """A forecaster from outside the package."""

    name = "half"

    def fit(self, df):
        return self

    def transform(self, df, output="pred"):
        return df.withColumn(output, F.lit(0.5))


@pytest.fixture(scope="module")
def labelled(weather_frame):
    split = Split(
        "2016-05-01 00:00:00", "2016-05-30 23:00:00", "2016-05-31 00:00:00", "2016-06-05 23:00:00",
        "2016-06-06 00:00:00", "2016-06-09 23:00:00",
    )
    return split, add_split(weather_frame, split)


def test_comparison_scores_and_results(labelled, spark, tmp_path):
    split, table = labelled
    models = [m for m in baseline_models(split) if m.name != "hour_of_year_climatology"]
    trees = BoostedTrees(feature_cols=PHYSICS_FEATURES, n_estimators=3, max_depth=2, name="boosted")
    run = compare_models(table, [*models, Half(), trees])
    rows = {(r["model"], r["split"]): r for r in run.scores.collect()}
    assert {s for _, s in rows} == {"train", "val"}
    assert rows[("persistence", "val")]["skill"] == pytest.approx(0.0)
    base = rows[("persistence", "val")]["rmse"]
    for (_, s), r in rows.items():
        if s == "val":
            assert r["skill"] == pytest.approx(1 - r["rmse"] / base)
    own = run_one(LinearWeather(), table.where("split='train'"), table.where("split='val'"))
    assert own[1].rmse == pytest.approx(rows[("linear_weather", "val")]["rmse"])
    assert own[0].n_samples == rows[("linear_weather", "train")]["n"]

    run.save(str(tmp_path), "r1")
    run_store.log_model_run(
        spark, str(tmp_path), "r2", "outside", {"depth": 3}, {"val_rmse": 0.1, "val_mae": 0.05, "n_val": 9.0},
        ["x"], {"x": 1.0},
    )
    saved = run_store.read_runs(spark, str(tmp_path))
    summary = run_store.results_summary(saved, "r1").collect()
    assert [r["model"] for r in summary] == [m.name for m in run.models]
    assert run_store.results_summary(saved, "r2").first()["n"] == 9
    boosted = saved.where("model = 'boosted'").first()
    assert boosted["params"]["n_estimators"] == "3" and boosted["n_features"] == len(PHYSICS_FEATURES)
    gains = [r["importance"] for r in run_store.read_importance(spark, str(tmp_path), "r1").collect()]
    assert gains == sorted(gains, reverse=True) and len(gains) == len(PHYSICS_FEATURES)
    run.release()


def test_results_store_keeps_every_metric_once(spark, tmp_path):
    folder, run = str(tmp_path), "2024-06-01"
    for bias in (0.5, 0.25):
        given = {"val_rmse": 0.1, "val_bias": bias, "fit_seconds": 3}
        run_store.log_model_run(spark, folder, run, "first", {}, given, ["x"], {"x": 1.0})
    run_store.log_model_run(spark, folder, run, "second", {}, {"val_mape": 2.0})
    run_store.log_model_run(spark, folder, run, "third", {}, {"train_rmse": 0.2, "skill_vs_persistence": 0.3})
    saved = {(r["model"], r["split"]): r for r in run_store.read_runs(spark, folder).collect()}
    assert len(saved) == run_store.read_runs(spark, folder).count() == 5
    assert {r["run_id"] for r in saved.values()} == {run}
    assert saved["first", "val"]["rmse"] == 0.1 and saved["first", "val"]["others"] is None
    assert saved["first", None]["others"] == {"val_bias": 0.25, "fit_seconds": 3.0}
    assert saved["second", None]["others"] == {"val_mape": 2.0}
    assert saved["third", "train"]["rmse"] == 0.2 and saved["third", None]["others"] == {"skill_vs_persistence": 0.3}
    assert [r["feature"] for r in run_store.read_importance(spark, folder, run).collect()] == ["x"]


def test_comparison_refuses_equal_names(labelled):
    with pytest.raises(ValueError, match="unique"):
        compare_models(labelled[1], [Half(), Half()])


def test_nine_models_in_order():
    assert [m.name for m in default_models()] == [
        "persistence", "daily_seasonal_naive", "hour_of_year_climatology", "linear_weather",
        "pure_physics", "linear_physics", "boosted_weather", "boosted_physics", "boosted_lag",
    ]


def test_model_ladder_on_a_wide_frame(spark):
    split = Split(
        "2018-06-01 00:00:00", "2018-06-02 23:00:00",
        "2019-06-01 00:00:00", "2019-06-02 23:00:00",
        "2020-06-01 00:00:00", "2020-06-02 23:00:00",
    )
    physics = [f"DE_{f}" for f in PHYSICS_FEATURES] + ["DE_cf_theory"]
    features = spark.range(96).selectExpr(
        "timestamp_ntz '2018-06-01 00:00:00' + make_dt_interval(0, int(if(id < 48, id, id - 48 + 8760))) AS utc_timestamp",
        "CASE WHEN id < 48 THEN 'train' ELSE 'val' END AS split",
        "abs(hash(id, 0) % 1000) / 1000.0D AS DE_solar_cf",
        *[f"double(abs(hash(id, {k + 1}) % 1000)) / 1000.0D AS {f}" for k, f in enumerate(dict.fromkeys(physics))],
        *[f"double(id % {h + 2}) / 200.0D AS DE_solar_cf_lag_{h}h" for h in (1, 24, 168)],
        *[f"double(id % 7) / 7.0D AS {c}" for c in ("hour_sin", "hour_cos", "doy_sin", "doy_cos")],
    )
    models = default_models(split, "DE_solar_cf", WIDE, "DE_", n_estimators=2, max_depth=2)
    run = compare_models(features, models, "DE_solar_cf", WIDE)
    assert {r.model for r in run.scores.collect()} == {m.name for m in models} and len(models) == 9
    run.release()
