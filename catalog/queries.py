"""Registered queries: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import stand_ins as si
from helioframe.functions import irradiance as irr
from helioframe.functions import sun
from helioframe.models.base import Forecaster
from helioframe.models.linear import LinearPhysics, LinearWeather
from helioframe.models.simple import (
    DailySeasonalNaive,
    HourOfYearClimatology,
    Persistence,
    PurePhysics,
)
from helioframe.models.trees import BoostedTrees
from helioframe.operators import clean, gaps, grid, lags, physics, quality, scoring, splits
from helioframe.plans import compare
from helioframe.plans.dataset import build_dataset, build_features, clean_readings
from helioframe.plans.profile import quality_profile
from helioframe.schema import CALENDAR_COLUMNS, LAG_FEATURES, PHYSICS_COLUMNS
from helioframe.session import shared_folder, stored
from helioframe.sources.integrity import file_digests, list_files, verify_files
from helioframe.sources.run_store import read_runs, results_summary

Query = Callable[[SparkSession, str], DataFrame]

START, END = si.JANUARY.overlap_start, si.JANUARY.overlap_end
# Short spans, so that the month of event data crosses several span borders.
SPAN = 240


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- quality profile ---------------------------------------------------------------------


def _raw(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"time_series": si.order_feed(spark, d), "weather": si.item_feed(spark, d)}


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(_raw(spark, d))


def usable_overlap(spark: SparkSession, d: str) -> DataFrame:
    return quality.usable_overlap(coverage(spark, d))


def column_completeness(spark: SparkSession, d: str) -> DataFrame:
    return quality.column_completeness(_raw(spark, d))


def column_completeness_by_series(spark: SparkSession, d: str) -> DataFrame:
    return quality.column_completeness(_raw(spark, d), by=("series_id",))


def coverage_by_series(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(_raw(spark, d), by=("series_id",))


def completeness_by_series_year(spark: SparkSession, d: str) -> DataFrame:
    return quality.completeness_by_year(si.order_feed(spark, d), by=("series_id",))


def missing_heatmap_by_series(spark: SparkSession, d: str) -> DataFrame:
    heat = quality.missing_heatmap(si.order_feed(spark, d), by=("series_id",))
    return _rounded(heat, 6, *[c for c in heat.columns if c.startswith("m")])


def anomaly_counts_by_series(spark: SparkSession, d: str) -> DataFrame:
    counts = quality.anomaly_counts(si.readings(spark, d), si.weather(spark, d), by=("series_id",))
    return _rounded(counts, 6, "negative_generation_pct")


def profile_completeness(spark: SparkSession, d: str) -> DataFrame:
    """The same as ``column_completeness_by_series``, rolled up from the monthly facts of the whole profile."""
    raw = _raw(spark, d)
    tables, _ = quality_profile(raw["time_series"], raw["weather"], by=("series_id",))
    return tables["column_completeness"]


def completeness_by_year(spark: SparkSession, d: str) -> DataFrame:
    return quality.completeness_by_year(si.order_feed(spark, d))


def missing_heatmap(spark: SparkSession, d: str) -> DataFrame:
    heat = quality.missing_heatmap(si.order_feed(spark, d))
    return _rounded(heat, 6, *[c for c in heat.columns if c != "year"])


def anomaly_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = quality.anomaly_counts(si.readings(spark, d), si.weather(spark, d))
    return _rounded(counts, 6, "negative_generation_pct")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return quality.paired_feeds(
        si.daily_orders(spark, d), si.daily_items(spark, d), axis=si.DAILY
    )


def corr_overall(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(quality.overall_correlation(_pairs(spark, d)), 6, "corr")


def corr_by_month(spark: SparkSession, d: str) -> DataFrame:
    return quality.correlation_by_month(_pairs(spark, d), axis=si.DAILY)


def capacity_by_year(spark: SparkSession, d: str) -> DataFrame:
    return quality.capacity_by_year(si.order_feed(spark, d))


def capacity_growth(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(quality.capacity_growth(capacity_by_year(spark, d)), 6, "growth_pct")


def capacity_growth_by_series(spark: SparkSession, d: str) -> DataFrame:
    by = ("series_id",)
    yearly = quality.capacity_by_year(si.order_feed(spark, d), by=by)
    return _rounded(quality.capacity_growth(yearly, by), 6, "growth_pct")


def capacity_by_series_year(spark: SparkSession, d: str) -> DataFrame:
    return quality.capacity_by_year(si.order_feed(spark, d), by=("series_id",))


def capacity_timeline(spark: SparkSession, d: str) -> DataFrame:
    return quality.capacity_timeline(si.order_feed(spark, d))


def one_year(spark: SparkSession, d: str) -> DataFrame:
    return quality.one_year(si.daily_orders(spark, d), si.daily_items(spark, d), 1998, axis=si.DAILY)


def target_completeness(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(quality.target_completeness(dataset_build(spark, d)), 6, "present_pct")


# --- cleaning ------------------------------------------------------------------------------


def night_clip_generation(spark: SparkSession, d: str) -> DataFrame:
    return clean.clip_nighttime_generation(si.readings(spark, d))


def night_clip_irradiance(spark: SparkSession, d: str) -> DataFrame:
    return clean.clip_nighttime_irradiance(si.weather(spark, d))


def capacity_factor(spark: SparkSession, d: str) -> DataFrame:
    return clean.normalize_to_capacity_factor(si.readings(spark, d))


def ghi(spark: SparkSession, d: str) -> DataFrame:
    return clean.add_ghi(si.weather(spark, d))


def cleaning_audit(spark: SparkSession, d: str) -> DataFrame:
    return clean.cleaning_audit(si.readings(spark, d), si.weather(spark, d))


# --- grid and gaps -------------------------------------------------------------------------


def hourly_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.hourly_grid(spark, START, END, si.sites(spark, d))


def hourly_align(spark: SparkSession, d: str) -> DataFrame:
    return grid.align_to_window(si.readings(spark, d), START, END, span_hours=SPAN)


def hourly_align_join(spark: SparkSession, d: str) -> DataFrame:
    return grid.align_by_join(si.readings(spark, d), hourly_grid(spark, d))


def duplicate_hours(spark: SparkSession, d: str) -> DataFrame:
    return grid.duplicate_hours(si.order_feed(spark, d))


def align_mean(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate hours averaged; values are whole numbers, so their mean is exact."""
    feed = si.order_feed(spark, d).select("series_id", "ts", "capacity")
    return grid.align_to_window(
        feed, "1995-01-01", "2001-12-31 23:00:00", on_duplicate="mean", span_hours=1344
    )


def feed_join(spark: SparkSession, d: str) -> DataFrame:
    return grid.align_feeds(
        [si.readings(spark, d), si.weather(spark, d)], START, END, span_hours=SPAN
    )


def _aligned_clean(spark: SparkSession, d: str) -> DataFrame:
    feed = clean_readings(si.readings(spark, d), si.JANUARY)
    return grid.align_to_window(feed, START, END, span_hours=SPAN)


def _filled(spark: SparkSession, d: str, span_hours: int) -> DataFrame:
    done = gaps.interpolate_short_gaps(
        _aligned_clean(spark, d), ["generation", "cf", "load"], 3, span_hours=span_hours
    )
    return _rounded(done, 9, "generation", "cf", "load")


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d, span_hours=SPAN)


def gap_fill_halo(spark: SparkSession, d: str) -> DataFrame:
    """The same fill with spans of two days, so that many gaps lie across a border."""
    return _filled(spark, d, span_hours=48)


def gap_runs(spark: SparkSession, d: str) -> DataFrame:
    return gaps.gap_runs(_aligned_clean(spark, d), "generation", 3, span_hours=48)


def fill_audit(spark: SparkSession, d: str) -> DataFrame:
    return gaps.filled_hours(_aligned_clean(spark, d), ["generation", "cf", "load"])


def dataset_build(spark: SparkSession, d: str) -> DataFrame:
    built = build_dataset(
        si.readings(spark, d),
        si.weather(spark, d),
        si.JANUARY,
        series=si.sites(spark, d),
        span_hours=SPAN,
    )
    return _rounded(built, 9, "generation", "cf", "load")


# --- features ------------------------------------------------------------------------------


def lag_window(spark: SparkSession, d: str) -> DataFrame:
    return lags.add_lag_features(_aligned_clean(spark, d), "cf", span_hours=SPAN)


def lag_join(spark: SparkSession, d: str) -> DataFrame:
    return lags.add_lag_features_by_join(_aligned_clean(spark, d), "cf")


def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    seen = si.observations(spark, d).select("l_orderkey", "l_linenumber", "ts")
    encoded = physics.add_calendar_parts(physics.add_calendar_features(seen))
    return _rounded(encoded, 9, "hour_sin", "hour_cos", "doy_sin", "doy_cos")


def _position(spark: SparkSession, d: str, mode: str = "as_coded") -> DataFrame:
    return physics.solar_position(
        si.observations(spark, d), "latitude_deg", "longitude_deg", azimuth_mode=mode, prefix="sun_"
    )


def _position_query(mode: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        # A bearing wraps at 0 = 360, so its sine and cosine are compared.
        bearing = F.radians("sun_azimuth_deg")
        return _position(spark, d, mode).select(
            "l_orderkey",
            "l_linenumber",
            F.round("sun_elevation_deg", 6).alias("elevation_deg"),
            F.round("sun_zenith_deg", 6).alias("zenith_deg"),
            F.round(F.sin(bearing), 6).alias("azimuth_sin"),
            F.round(F.cos(bearing), 6).alias("azimuth_cos"),
        )

    return query


def sun_angles(spark: SparkSession, d: str) -> DataFrame:
    seen = si.observations(spark, d).withColumns(
        {"day": sun.day_angle("ts"), "hour": sun.utc_hour("ts")}
    )
    eot = sun.equation_of_time(F.col("day"))
    ha = sun.hour_angle(F.col("hour"), F.col("longitude_deg"), eot)
    return seen.select(
        "l_orderkey",
        "l_linenumber",
        F.round("hour", 6).alias("utc_hour"),
        F.dayofyear("ts").alias("day_of_year"),
        F.round(eot, 6).alias("equation_of_time"),
        F.round(sun.declination(F.col("day")), 6).alias("declination_deg"),
        F.round(ha, 6).alias("hour_angle_deg"),
    )


def clear_sky(spark: SparkSession, d: str) -> DataFrame:
    clear = irr.clear_sky_ghi(F.col("sun_elevation_deg"))
    return _position(spark, d).select(
        "l_orderkey", "l_linenumber", F.round(clear, 6).alias("clear_sky_ghi")
    )


def clearness(spark: SparkSession, d: str) -> DataFrame:
    seen = _position(spark, d).withColumn(
        "clear", irr.clear_sky_ghi(F.col("sun_elevation_deg"))
    )
    index = irr.clearness_index(F.col("direct") + F.col("diffuse"), F.col("clear"))
    return seen.select("l_orderkey", "l_linenumber", F.round(index, 6).alias("clearness_index"))


def _on_panel(spark: SparkSession, d: str) -> DataFrame:
    """Incidence and panel irradiance against the true bearing of the sun."""
    geometry = [
        F.col(c) for c in ("sun_elevation_deg", "sun_azimuth_deg", "tilt_deg", "azimuth_deg")
    ]
    return _position(spark, d, "documented").withColumns(
        {
            "aoi_deg": irr.angle_of_incidence(*geometry),
            "g_poa": irr.plane_of_array(F.col("direct"), F.col("diffuse"), *geometry),
        }
    )


def aoi_poa(spark: SparkSession, d: str) -> DataFrame:
    return _on_panel(spark, d).select(
        "l_orderkey",
        "l_linenumber",
        F.round("aoi_deg", 4).alias("aoi_deg"),
        F.round("g_poa", 6).alias("g_poa"),
    )


def cell_temp_cf(spark: SparkSession, d: str) -> DataFrame:
    cell = irr.cell_temperature(F.col("temperature"), F.col("g_poa"))
    return (
        _on_panel(spark, d)
        .withColumn("t_cell_c", cell)
        .select(
            "l_orderkey",
            "l_linenumber",
            F.round("t_cell_c", 6).alias("t_cell_c"),
            F.round(
                irr.theoretical_capacity_factor(F.col("g_poa"), F.col("t_cell_c")), 6
            ).alias("cf_theory"),
        )
    )


def physics_features(spark: SparkSession, d: str) -> DataFrame:
    features = physics.add_physics(si.weather(spark, d), si.sites(spark, d))
    return _rounded(features, 6, *PHYSICS_COLUMNS).select("series_id", "ts", *PHYSICS_COLUMNS)


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Every located series is wanted, so each feed is read once."""
    sites = si.sites(spark, d)
    return build_features(
        si.readings(spark, d),
        si.weather(spark, d),
        sites,
        si.JANUARY,
        si.JANUARY_SPLIT,
        span_hours=SPAN,
        series=sites,
    )


def _year_features(spark: SparkSession, d: str) -> DataFrame:
    """Several years of three series at one location, for fitting and comparing forecasters."""
    return build_features(
        si.year_readings(spark, d),
        si.year_weather(spark, d),
        None,
        si.YEARS,
        si.YEARS_SPLIT,
    )


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    built = _features(spark, d).drop("capacity", "load", "generation")
    shares = [c for c in built.columns if c.startswith("cf") and c != "cf_theory"]
    derived = [*PHYSICS_COLUMNS, *CALENDAR_COLUMNS]
    return _rounded(_rounded(built, 9, *shares), 6, *derived)


# --- splits --------------------------------------------------------------------------------


def split_label(spark: SparkSession, d: str) -> DataFrame:
    orders = si.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return splits.add_split(orders, si.YEARS_SPLIT)


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = splits.split_dataset(si.order_feed(spark, d), si.YEARS_SPLIT)
    counted = [
        part.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("split", F.lit(name))
        for name, part in zip(("train", "val", "test"), parts, strict=True)
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def holdout_tail(spark: SparkSession, d: str) -> DataFrame:
    feed = si.readings(spark, d).select("series_id", "ts", "generation")
    return splits.mark_holdout(feed, "generation", span_hours=SPAN)


def holdout_tail_by_series(spark: SparkSession, d: str) -> DataFrame:
    feed = si.readings(spark, d).select("series_id", "ts", "generation")
    return splits.mark_holdout(feed, "generation", span_hours=SPAN, per_series=True)


# --- forecasters ---------------------------------------------------------------------------


def _lagged(model: type, spark: SparkSession, d: str) -> DataFrame:
    labelled = splits.add_split(_aligned_clean(spark, d), si.JANUARY_SPLIT)
    predicted = model("cf", split=si.JANUARY_SPLIT).transform(labelled)
    return predicted.select("series_id", "ts", "split", "cf", "pred")


def persistence(spark: SparkSession, d: str) -> DataFrame:
    return _lagged(Persistence, spark, d)


def seasonal_naive(spark: SparkSession, d: str) -> DataFrame:
    return _lagged(DailySeasonalNaive, spark, d)


def climatology(spark: SparkSession, d: str) -> DataFrame:
    labelled = splits.add_split(si.item_series(spark, d), si.YEARS_SPLIT)
    model = HourOfYearClimatology().fit(labelled.where("split = 'train'"))
    return _rounded(model.transform(labelled), 9, "cf", "pred")


def _fitted(model: Forecaster, spark: SparkSession, d: str) -> DataFrame:
    table = stored(_year_features(spark, d))
    model.fit(table.where("split = 'train'"))
    return model.transform(table).select(
        "series_id", "ts", "split", F.round("pred", 6).alias("pred")
    )


def linear_weather(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(LinearWeather(), spark, d)


def linear_physics(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(LinearPhysics(), spark, d)


def pure_physics(spark: SparkSession, d: str) -> DataFrame:
    return PurePhysics().transform(_year_features(spark, d)).select(
        "series_id", "ts", "split", F.round("pred", 6).alias("pred")
    )


def boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(BoostedTrees(feature_cols=LAG_FEATURES), spark, d)


def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    model = BoostedTrees(feature_cols=LAG_FEATURES)
    model.fit(_year_features(spark, d).where("split = 'train'"))
    rows = list(model.feature_importance.items())
    ranked = spark.createDataFrame(rows, "feature string, importance double")
    return ranked.orderBy(F.desc("importance"))


def _naive_predictions(spark: SparkSession, d: str) -> DataFrame:
    labelled = splits.add_split(
        lags.add_lag_features(_aligned_clean(spark, d), "cf", span_hours=SPAN), si.JANUARY_SPLIT
    ).where("split IS NOT NULL")
    models = [Persistence(split=si.JANUARY_SPLIT), DailySeasonalNaive(split=si.JANUARY_SPLIT)]
    return compare.predict_all(labelled, models)


def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.score_predictions(_naive_predictions(spark, d)), 6, "rmse", "mae")


def skill_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = scoring.add_skill(scoring.score_predictions(_naive_predictions(spark, d)))
    return _rounded(scores, 6, "rmse", "mae", "skill")


def aligned_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Truth and predictions held in separate tables, matched by series and time."""
    truth = _aligned_clean(spark, d).select("series_id", "ts", F.col("cf").alias("y_true"))
    predicted = persistence(spark, d).select("series_id", "ts", "pred")
    return scoring.align_predictions(truth, predicted)


def _compared(models: Sequence[Forecaster], spark: SparkSession, d: str) -> compare.Comparison:
    return compare.compare_models(_year_features(spark, d), models)


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the six forecasters without trees."""
    run = _compared(compare.baseline_models(si.YEARS_SPLIT), spark, d)
    return _rounded(run.scores, 6, "rmse", "mae", "skill")


def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Summary of a stored run of the six forecasters without trees, read back from the run store."""
    run = _compared(compare.baseline_models(si.YEARS_SPLIT), spark, d)
    folder = shared_folder(spark, "runs")
    run.save(folder, "run")
    summary = results_summary(read_runs(spark, folder), "run")
    return _rounded(summary, 6, "val_rmse", "val_mae", "skill")


def model_comparison_trees(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all nine forecasters."""
    return _compared(compare.default_models(si.YEARS_SPLIT), spark, d).scores


# --- files ---------------------------------------------------------------------------------


def file_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Every table file against a manifest written beforehand; one digest is spoiled, one file has none."""
    paths = f"{d}/*.parquet"
    files = list_files(spark, paths).select("path", "file")
    name = F.col("file")
    algo = F.when(name.isin("orders.parquet", "supplier.parquet"), "md5").when(name == "lineitem.parquet", "sha1").otherwise("sha256")
    digests = file_digests(spark, paths, files.select("path", algo.alias("algo")).where(name != "nation.parquet"))
    # By path: tables may be folders, with files of the same names.
    manifest = files.join(digests, "path", "left").select(
        "path",
        F.when(name == "orders.parquet", F.upper("actual"))
        .when(name == "supplier.parquet", F.reverse("actual"))
        .otherwise(F.coalesce("actual", F.lit("")))
        .alias("expected"),
    )
    checked = verify_files(spark, paths, stored(manifest))
    return checked.select(F.element_at(F.split("path", "/"), -1).alias("file"), "algo", "status")


REGISTRY: dict[str, Query] = {
    "coverage": coverage,
    "usable_overlap": usable_overlap,
    "column_completeness": column_completeness,
    "column_completeness_by_series": column_completeness_by_series,
    "coverage_by_series": coverage_by_series,
    "completeness_by_series_year": completeness_by_series_year,
    "missing_heatmap_by_series": missing_heatmap_by_series,
    "anomaly_counts_by_series": anomaly_counts_by_series,
    "profile_completeness": profile_completeness,
    "completeness_by_year": completeness_by_year,
    "missing_heatmap": missing_heatmap,
    "anomaly_counts": anomaly_counts,
    "corr_overall": corr_overall,
    "corr_by_month": corr_by_month,
    "capacity_by_year": capacity_by_year,
    "capacity_growth": capacity_growth,
    "capacity_by_series_year": capacity_by_series_year,
    "capacity_growth_by_series": capacity_growth_by_series,
    "capacity_timeline": capacity_timeline,
    "one_year": one_year,
    "target_completeness": target_completeness,
    "night_clip_generation": night_clip_generation,
    "night_clip_irradiance": night_clip_irradiance,
    "capacity_factor": capacity_factor,
    "ghi": ghi,
    "cleaning_audit": cleaning_audit,
    "hourly_grid": hourly_grid,
    "hourly_align": hourly_align,
    "hourly_align_join": hourly_align_join,
    "duplicate_hours": duplicate_hours,
    "align_mean": align_mean,
    "feed_join": feed_join,
    "gap_fill": gap_fill,
    "gap_fill_halo": gap_fill_halo,
    "gap_runs": gap_runs,
    "fill_audit": fill_audit,
    "dataset_build": dataset_build,
    "lag_window": lag_window,
    "lag_join": lag_join,
    "calendar_features": calendar_features,
    "sun_angles": sun_angles,
    "solar_position_as_coded": _position_query("as_coded"),
    "solar_position_documented": _position_query("documented"),
    "clear_sky": clear_sky,
    "clearness": clearness,
    "aoi_poa": aoi_poa,
    "cell_temp_cf": cell_temp_cf,
    "physics_features": physics_features,
    "feature_table": feature_table,
    "split_label": split_label,
    "split_counts": split_counts,
    "holdout_tail": holdout_tail,
    "holdout_tail_by_series": holdout_tail_by_series,
    "persistence": persistence,
    "seasonal_naive": seasonal_naive,
    "climatology": climatology,
    "linear_weather": linear_weather,
    "linear_physics": linear_physics,
    "pure_physics": pure_physics,
    "boosted_trees": boosted_trees,
    "feature_importance": feature_importance,
    "forecast_metrics": forecast_metrics,
    "skill_scores": skill_scores,
    "aligned_predictions": aligned_predictions,
    "model_comparison": model_comparison,
    "model_comparison_trees": model_comparison_trees,
    "run_results": run_results,
    "file_integrity": file_integrity,
}
