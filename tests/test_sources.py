from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalog.queries import file_integrity
from helioframe.operators import grid
from helioframe.operators.lags import add_lag_features
from helioframe.operators.physics import SITE_PARAMETERS, add_physics, add_physics_features
from helioframe.plans.dataset import build_dataset, build_features, build_wide_dataset
from helioframe.plans.profile import OPERATORS, write_wide_profile
from helioframe.schema import (
    PHYSICS_COLUMNS,
    PROFILE_TIME_SERIES_COLUMNS,
    WEATHER_COLUMNS,
    WIDE,
    PreprocessConfig,
)
from helioframe.sources import raw_feeds
from helioframe.sources.dataset_store import build_and_cache, dataset_path, load_dataset
from helioframe.sources.integrity import read_manifest, verify_files
from helioframe.streaming.feeds import clean_readings_stream, weather_features_stream

CONFIG = PreprocessConfig("2018-06-20", "2018-06-21 23:00:00")
START = datetime(2018, 6, 20)


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    """Two days of both files, columns shuffled and unrelated ones added."""
    folder = tmp_path_factory.mktemp("raw")
    ts_cols = ["extra", *reversed(PROFILE_TIME_SERIES_COLUMNS)]
    lines = [",".join(ts_cols)]
    for i in range(48):
        if i == 30:
            continue  # an absent hour
        t = START + timedelta(hours=i)
        values = {
            "extra": "n/a",
            "utc_timestamp": t.strftime("%Y-%m-%dT%H:%M:%SZ"),
            "DE_load_actual_entsoe_transparency": 100 + i,
            "DE_solar_generation_actual": "" if i in (12, 13) else 10 * i,
            "DE_solar_capacity": 1000,
            "DE_tennet_solar_generation_actual": i,
            "IT_solar_generation_actual": "" if i == 11 else 5,
        }
        lines.append(",".join(str(values.get(c, "")) for c in ts_cols))
    (folder / "time_series_60min_singleindex.csv").write_text("\n".join(lines) + "\n")
    lines = [",".join(WEATHER_COLUMNS)]
    for i in range(48):
        t = START + timedelta(hours=i)
        lines.append(f"{t:%Y-%m-%dT%H:%M:%SZ},20,{100 + i},50,25,{200 + i},60")
    (folder / "weather_data.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_scan_reads_contract_columns_by_name(spark, raw_dir):
    ts, wx = raw_feeds.load_raw(spark, raw_dir)
    first = ts.orderBy("utc_timestamp").first()
    assert ts.columns == [
        "utc_timestamp", "DE_load_actual_entsoe_transparency", "DE_solar_generation_actual",
        "DE_solar_capacity", "IT_solar_generation_actual",
    ]
    assert dict(ts.dtypes)["utc_timestamp"] == "timestamp_ntz"
    assert first["utc_timestamp"] == START and first["DE_load_actual_entsoe_transparency"] == 100.0
    assert ts.count() == 47 and wx.count() == 48
    plan = ts._jdf.queryExecution().executedPlan().toString()
    assert "DE_tennet" not in plan and "extra" not in plan
    profile, _ = raw_feeds.load_profile_feeds(spark, raw_dir)
    assert profile.columns == list(PROFILE_TIME_SERIES_COLUMNS)


def test_scan_does_not_depend_on_the_session_zone(spark, raw_dir):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ts, _ = raw_feeds.load_raw(spark, raw_dir)
        assert ts.agg(F.min("utc_timestamp")).first()[0] == START
        aligned = build_wide_dataset(*raw_feeds.load_raw(spark, raw_dir), CONFIG)
        assert aligned.where("DE_solar_capacity IS NOT NULL").count() == 47
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_zone_is_honoured_and_required(spark):
    from helioframe.functions.timeaxis import utc_from_text

    df = spark.createDataFrame([("2018-06-20T02:00:00+02:00",), (None,)], "t string")
    assert [r[0] for r in df.select(utc_from_text("t")).collect()] == [START, None]
    for text in ("2018-06-20 02:00:00", "2018-06-20"):
        with pytest.raises(Exception, match="without a zone"):
            spark.createDataFrame([(text,)], "t string").select(utc_from_text("t")).collect()


def test_plan_of_the_feature_build(spark, raw_dir, tmp_path):
    """One exchange of each feed, bounds pushed to the scan, nothing in a single partition."""
    ts, wx = raw_feeds.load_raw(spark, raw_dir)
    raw_feeds.tall_readings(ts).write.parquet(str(tmp_path / "readings"))
    raw_feeds.tall_weather(wx).write.parquet(str(tmp_path / "weather"))
    listed = spark.createDataFrame([("DE",), ("IT",)], "series_id string")
    built = build_dataset(
        spark.read.parquet(str(tmp_path / "readings")),
        spark.read.parquet(str(tmp_path / "weather")),
        CONFIG,
        series=listed,
    )
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(ts,") == 2
    assert plan.count("REPARTITION_BY_COL") == 1
    # The other exchange finds the distinct series of the small list.
    assert plan.count("Exchange ") == 2
    assert "Join" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan


def test_feature_build_joins_no_row_to_its_site(spark, raw_dir, tmp_path):
    """With the sites as list of series, each feed is read once and nothing but that list is joined or grouped by series."""
    ts, wx = raw_feeds.load_raw(spark, raw_dir)
    raw_feeds.tall_readings(ts).write.parquet(str(tmp_path / "readings"))
    raw_feeds.tall_weather(wx).write.parquet(str(tmp_path / "weather"))
    rows = [("DE", 52.0, 10.0, 30.0, 180.0), ("IT", 42.0, 12.0, 20.0, 170.0), ("IT", 41.0, 12.0, 20.0, 170.0)]
    sites = spark.createDataFrame(rows, "series_id string, " + ", ".join(f"{c} double" for c in SITE_PARAMETERS))
    feeds = [spark.read.parquet(str(tmp_path / n)) for n in ("readings", "weather")]
    built = build_features(*feeds, sites, CONFIG, lags=(1, 24), span_hours=30, series=sites)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Join" not in plan
    assert plan.count("hashpartitioning(series_id") == 2
    # A series without a site keeps its rows, and of two sites of a series one is taken.
    only = sites.where("series_id = 'DE'")
    part = build_features(*feeds, only, CONFIG, lags=(1, 24), span_hours=30)
    by_join = add_physics(
        part.drop(*PHYSICS_COLUMNS, "split", "hour_sin", "hour_cos", "doy_sin", "doy_cos"), only
    )
    names = ["series_id", "ts", *PHYSICS_COLUMNS]
    a, b = part.select(names).orderBy("series_id", "ts").collect(), by_join.select(names).orderBy("series_id", "ts").collect()
    assert a == b and len(a) == 96 and all(r.g_poa is None for r in a if r.series_id == "IT")
    assert built.count() == 96


def test_missing_file_and_renamed_column(spark, raw_dir):
    with pytest.raises(FileNotFoundError):
        raw_feeds.load_raw(spark, raw_dir + "/none")
    with pytest.raises(Exception, match="UNRESOLVED"):
        raw_feeds.read_feed(spark, f"{raw_dir}/weather_data.csv", ["utc_timestamp", "DE_temp"])


def test_wide_dataset_matches_by_hand(spark, raw_dir):
    built = build_wide_dataset(*raw_feeds.load_raw(spark, raw_dir), CONFIG)
    rows = built.orderBy("utc_timestamp").collect()
    assert len(rows) == 48 and rows[0]["utc_timestamp"] == START
    assert [rows[i]["DE_solar_generation_actual"] for i in (1, 12, 13, 30)] == [0.0, 120.0, 130.0, 300.0]
    assert rows[12]["DE_solar_cf"] == pytest.approx(0.12)
    assert rows[30]["DE_load_actual_entsoe_transparency"] == 130.0
    assert rows[30]["DE_solar_capacity"] is None
    assert rows[11]["IT_solar_generation_actual"] is None and rows[30]["IT_solar_generation_actual"] is None
    assert rows[2]["IT_solar_generation_actual"] == 0.0
    assert rows[12]["DE_ghi"] == 162.0 and rows[12]["IT_ghi"] == 272.0 and rows[2]["DE_ghi"] == 0.0
    featured = add_lag_features(add_physics_features(built), "DE_solar_cf", [1], axis=WIDE)
    assert featured.count() == 48 and "DE_g_poa" in featured.columns


def test_tall_dataset_agrees_with_wide(spark, raw_dir):
    ts, wx = raw_feeds.load_raw(spark, raw_dir)
    tall = build_dataset(raw_feeds.tall_readings(ts), raw_feeds.tall_weather(wx), CONFIG, span_hours=24)
    wide = build_wide_dataset(ts, wx, CONFIG).orderBy("utc_timestamp").collect()
    de = tall.where("series_id = 'DE'").orderBy("ts").collect()
    assert [r["cf"] for r in de] == [r["DE_solar_cf"] for r in wide]
    assert [r["ghi"] for r in de] == [r["DE_ghi"] for r in wide]
    it = tall.where("series_id = 'IT'")
    assert it.count() == 48 and it.where("cf IS NOT NULL").isEmpty()
    tso = raw_feeds.tall_readings(raw_feeds.load_profile_feeds(spark, raw_dir)[0], ["DE_tennet"])
    assert tso.agg(F.max("generation")).first()[0] == 47.0


def test_features_in_one_pass_equal_step_by_step(spark, raw_dir):
    ts, wx = raw_feeds.load_raw(spark, raw_dir)
    feeds = raw_feeds.tall_readings(ts), raw_feeds.tall_weather(wx)
    fused = build_features(*feeds, config=CONFIG, lags=(1, 24), span_hours=30)
    steps = add_lag_features(build_dataset(*feeds, CONFIG), "cf", (1, 24))
    names = ["series_id", "ts", "cf", "ghi", "cf_lag_1h", "cf_lag_24h"]
    a, b = fused.select(names), steps.select(names)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 96


def test_a_task_of_the_feature_build_writes_out_a_bounded_grid(spark, frame, monkeypatch):
    monkeypatch.setattr(grid, "GRID_ROWS", 2000)
    reading = frame(
        [(f"s{k}", "2020-01-01 00:00:00", 1.0, 2.0, 3.0) for k in range(40)],
        "series_id string, ts timestamp_ntz, generation double, capacity double, load double",
    )
    weather = reading.selectExpr("series_id", "ts", "1.0D temperature", "2.0D direct", "3.0D diffuse")
    config = PreprocessConfig(overlap_start="2020-01-01", overlap_end="2020-02-09 23:00:00")
    built = build_features(reading, weather, None, config, lags=(1, 24), span_hours=48)
    sizes = [r["count"] for r in built.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40 * 960
    # All of it comes from a few bytes of readings; of 29 partitions none holds much more than its share.
    assert len(sizes) > 20 and max(sizes) < 4000


def test_dataset_store(spark, raw_dir, tmp_path):
    calls = []

    def build(config):
        calls.append(config)
        ts, wx = raw_feeds.load_raw(spark, raw_dir)
        return build_dataset(raw_feeds.tall_readings(ts), raw_feeds.tall_weather(wx), config)

    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path), CONFIG)
    path = build_and_cache(spark, str(tmp_path), build, CONFIG)
    assert build_and_cache(spark, str(tmp_path), build, CONFIG) == path and len(calls) == 1
    assert load_dataset(spark, str(tmp_path), CONFIG).count() == 96
    other = PreprocessConfig("2018-06-20", "2018-06-21 23:00:00", max_interpolation_gap_hours=0)
    assert dataset_path(str(tmp_path), other) != path
    build_and_cache(spark, str(tmp_path), build, other)
    missing = load_dataset(spark, str(tmp_path), other).where("series_id = 'DE' AND cf IS NULL")
    assert missing.count() == 3
    build_and_cache(spark, str(tmp_path), build, CONFIG, force=True)
    assert len(calls) == 3


def test_file_integrity(spark, tmp_path):
    content = b"hourly values"
    for name in ("a.csv", "b.csv", "c.csv", "d.csv", "e.csv", "f.csv"):
        (tmp_path / name).write_bytes(content)
    manifest = tmp_path / "datapackage.json"
    resources = [
        {"path": "https://host/x/a.csv", "hash": hashlib.md5(content).hexdigest().upper()},
        {"path": "b.csv", "hash": hashlib.sha1(content).hexdigest()},
        {"path": "c.csv", "hash": hashlib.sha256(content).hexdigest()},
        {"path": "d.csv", "hash": hashlib.md5(b"other").hexdigest()},
        {"path": "e.csv", "hash": "abc"},
    ]
    manifest.write_text(json.dumps({"name": "p", "resources": resources}, indent=1))
    checked = verify_files(
        spark, [str(tmp_path / f"{n}.csv") for n in "abcdef"], read_manifest(spark, str(manifest))
    )
    got = {r["path"][-5:]: (r["algo"], r["status"]) for r in checked.collect()}
    assert got == {
        "a.csv": ("md5", "verified"),
        "b.csv": ("sha1", "verified"),
        "c.csv": ("sha256", "verified"),
        "d.csv": ("md5", "mismatch"),
        "e.csv": (None, "skipped"),
        "f.csv": (None, "skipped"),
    }
    # The same files as ones too large for a row, read in pieces; and some of either kind.
    for limit in (0, len(content) - 1):
        pieces = verify_files(
            spark,
            [str(tmp_path / f"{n}.csv") for n in "abcdef"],
            read_manifest(spark, str(manifest)),
            whole_limit=limit,
            piece=5,
        )
        assert sorted(pieces.collect()) == sorted(checked.collect())
    (tmp_path / "a.csv").write_bytes(content * 3)
    mixed = verify_files(
        spark,
        [str(tmp_path / f"{n}.csv") for n in "ab"],
        read_manifest(spark, str(manifest)),
        whole_limit=len(content),
        piece=7,
    )
    assert {r["path"][-5:]: r["status"] for r in mixed.collect()} == {"a.csv": "mismatch", "b.csv": "verified"}


def test_file_integrity_of_folders_and_of_a_file_too_large_for_a_row(spark, tmp_path):
    for table in ("pages", "labels"):
        (tmp_path / f"{table}.parquet").mkdir()
        for part in ("part-0.parquet", "part-1.parquet"):
            (tmp_path / f"{table}.parquet" / part).write_bytes(f"{table} {part}".encode())
    for name in ("orders", "supplier", "nation", "region"):
        (tmp_path / f"{name}.parquet").write_bytes(name.encode())
    with open(tmp_path / "lineitem.parquet", "wb") as file:  # takes no space
        file.truncate((1 << 31) + 5)
    got = sorted(map(tuple, file_integrity(spark, str(tmp_path)).collect()))
    parts = [(f"part-{i}.parquet", "sha256", "verified") for i in (0, 0, 1, 1)]
    assert got == [
        ("lineitem.parquet", "sha1", "verified"),
        ("nation.parquet", None, "skipped"),
        ("orders.parquet", "md5", "verified"),
        *parts,
        ("region.parquet", "sha256", "verified"),
        ("supplier.parquet", "md5", "mismatch"),
    ]


def test_profile_of_the_wide_feeds(spark, raw_dir, tmp_path):
    ts, wx = raw_feeds.load_profile_feeds(spark, raw_dir)
    write_wide_profile(ts, wx, str(tmp_path), year=2018)
    done = spark.read.parquet(str(tmp_path / "column_completeness"))
    got = {(r.source, r.series_id, r.column): r.present_pct for r in done.collect()}
    assert len(got) == 6 * 3 + 2 * 3
    for name in ("DE", *OPERATORS):
        known = ts.agg(100.0 * F.count(f"{name}_solar_generation_actual") / F.count(F.lit(1))).first()[0]
        assert got["time_series", name, "generation"] == pytest.approx(known, abs=0.01)
    assert got["time_series", "DE_tennet", "capacity"] == 0.0
    covered = spark.read.parquet(str(tmp_path / "coverage"))
    assert covered.groupBy("source").count().orderBy("source").collect() == [("time_series", 6), ("weather", 2)]


def test_row_local_steps_run_on_streams(spark, frame, tmp_path):
    readings = frame(
        [("a", "2018-06-21 02:00:00", 50.0, 100.0), ("a", "2018-06-21 12:00:00", 50.0, 100.0)],
        "series_id string, ts timestamp_ntz, generation double, capacity double",
    )
    weather = frame(
        [("a", "2018-06-21 12:00:00", 20.0, 500.0, 100.0)],
        "series_id string, ts timestamp_ntz, temperature double, direct double, diffuse double",
    )
    for name, table, apply in (
        ("readings", readings, clean_readings_stream),
        ("weather", weather, weather_features_stream),
    ):
        folder = str(tmp_path / name)
        table.write.parquet(folder)
        stream = apply(spark.readStream.schema(table.schema).parquet(folder))
        query = (
            stream.writeStream.format("memory").queryName(f"out_{name}")
            .option("checkpointLocation", str(tmp_path / f"{name}_checkpoint"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination(60)
    assert sorted(r["cf"] for r in spark.table("out_readings").collect()) == [0.0, 0.5]
    assert spark.table("out_weather").first()["ghi"] == 600.0
