"""The given tables read as photovoltaic feeds.

Plain projections and aggregations over whole tables; ``oracle.py`` holds the same
definitions in SQL. Money-like sums go through DECIMAL so that their order cannot matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.functions.timeaxis import floor_hour
from helioframe.schema import Axis, PreprocessConfig, Split

JANUARY = PreprocessConfig(overlap_start="2024-01-01", overlap_end="2024-01-30 23:00:00")
YEARS = PreprocessConfig(overlap_start="1995-01-01", overlap_end="2001-12-31 23:00:00")
JANUARY_SPLIT = Split(
    "2024-01-01 00:00:00",
    "2024-01-20 23:00:00",
    "2024-01-21 00:00:00",
    "2024-01-25 23:00:00",
    "2024-01-26 00:00:00",
    "2024-01-30 23:00:00",
)
YEARS_SPLIT = Split(
    "1995-01-01 00:00:00",
    "1998-12-31 23:00:00",
    "1999-01-01 00:00:00",
    "1999-12-31 23:00:00",
    "2000-01-01 00:00:00",
    "2001-12-31 23:00:00",
)
DAILY = Axis(keys=(), ts="ts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(col: Column | str) -> Column:
    return F.col(col).cast("decimal(18,2)") if isinstance(col, str) else col


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plant readings: a series per user, ``error`` events as failed meters."""
    user = F.col("user_id")
    fleet = F.pmod(user, F.lit(15))
    capacity = F.when(fleet == 0, F.lit(0.0)).when(
        fleet > 1, (80 + 10 * F.pmod(user, F.lit(12))).cast("double")
    )
    value = _money("value")
    return (
        table(spark, sf_dir, "events")
        .groupBy(user.alias("user_id"), floor_hour("ts").alias("ts"))
        .agg(
            F.sum(F.when(F.col("event_type") != "error", value - 5)).cast("double").alias(
                "generation"
            ),
            (F.sum(value) + 100).cast("double").alias("load"),
        )
        .select(
            user.cast("string").alias("series_id"),
            "ts",
            "generation",
            capacity.alias("capacity"),
            "load",
        )
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as weather reports, stamped to the nearest hour."""
    kind = F.col("event_type")
    value = _money("value")
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").cast("string").alias("series_id"),
            floor_hour(F.timestamp_add("MINUTE", F.lit(30), F.col("ts"))).alias("ts"),
        )
        .agg(
            (F.sum(value).cast("double") / F.count("*") - 40.0).alias("temperature"),
            (F.sum(F.when(kind.isin("view", "click", "purchase"), value)).cast("double") * 2.0)
            .alias("direct"),
            F.sum(F.when(kind != "click", value)).cast("double").alias("diffuse"),
        )
    )


def _site_columns(number: Column) -> list[Column]:
    return [
        (F.pmod(number * 37, F.lit(121)) - 60).cast("double").alias("latitude_deg"),
        (F.pmod(number * 53, F.lit(360)) - 180).cast("double").alias("longitude_deg"),
        (F.pmod(number * 7, F.lit(91)) + 0.25).cast("double").alias("tilt_deg"),
        F.pmod(number * 11, F.lit(360)).cast("double").alias("azimuth_deg"),
    ]


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location per event series."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.col("user_id").cast("string").alias("series_id"), *_site_columns(F.col("user_id"))
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as irradiance observations over all seasons, sited at their supplier."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").alias("s_suppkey"),
        F.timestamp_add("HOUR", F.pmod("l_orderkey", F.lit(24)), F.col("l_shipdate")).alias("ts"),
        (F.col("l_quantity") * 16.0).alias("direct"),
        (F.col("l_discount") * 3000.0).alias("diffuse"),
        (F.col("l_tax") * 500.0 - 10.0).alias("temperature"),
    )
    located = table(spark, sf_dir, "supplier").select(
        "s_suppkey", *_site_columns(F.col("s_suppkey"))
    )
    return items.join(located, "s_suppkey").drop("s_suppkey")


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw multi-year reading feed with missing values in two columns."""
    date = F.col("o_orderdate")
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.timestamp_add("HOUR", F.pmod("o_custkey", F.lit(24)), date).alias("ts"),
        F.when(status != "P", F.col("o_totalprice")).alias("generation"),
        F.when(
            F.col("o_orderpriority") != "1-URGENT",
            (F.pmod("o_custkey", F.lit(500)) + 10 * F.year(date)).cast("double"),
        ).alias("capacity"),
        F.col("o_totalprice").alias("load"),
    )


def item_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a raw multi-year weather feed with missing values in two columns."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"),
        F.timestamp_add("HOUR", F.pmod("l_orderkey", F.lit(24)), F.col("l_shipdate")).alias("ts"),
        F.when(F.col("l_linestatus") != "F", F.col("l_tax") * 500.0 - 10.0).alias("temperature"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 16.0).alias("direct"),
        (F.col("l_discount") * 3000.0).alias("diffuse"),
    )


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading a day: total order value."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").alias("ts"))
        .agg(F.sum(_money("o_totalprice")).cast("double").alias("generation"))
    )


def daily_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weather report a day: summed measures of the line items shipped."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").alias("ts"))
        .agg(
            F.sum(_money("l_quantity")).cast("double").alias("direct"),
            F.sum(_money("l_discount")).cast("double").alias("diffuse"),
            F.sum(_money("l_tax")).cast("double").alias("temperature"),
        )
    )


def item_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as unique hourly readings over seven years, a series per return flag."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("series_id"),
            F.timestamp_add("HOUR", F.col("l_linenumber"), F.col("l_shipdate")).alias("ts"),
        )
        .agg((F.sum(_money("l_quantity")).cast("double") / 1000.0).alias("cf"))
    )


def year_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daytime readings of three plants over six years."""
    date = F.col("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.translate("o_orderstatus", "FOP", "ANR").alias("series_id"),
            F.timestamp_add("HOUR", F.pmod("o_custkey", F.lit(6)) + 8, date).alias("ts"),
        )
        .agg(F.sum(_money("o_totalprice")).cast("double").alias("load"))
        .select(
            "series_id",
            "ts",
            (F.col("load") / 1000.0).alias("generation"),
            (400 + 20 * (F.year("ts") - 1995)).cast("double").alias("capacity"),
            "load",
        )
    )


def year_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as daytime weather of the same three plants."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("series_id"),
            F.timestamp_add("HOUR", F.pmod("l_orderkey", F.lit(6)) + 8, F.col("l_shipdate")).alias(
                "ts"
            ),
        )
        .agg(
            (F.sum(_money("l_tax")).cast("double") / F.count("*") * 400.0 - 5.0).alias(
                "temperature"
            ),
            (F.sum(_money("l_quantity")).cast("double") * 8.0).alias("direct"),
            (F.sum(_money("l_discount")).cast("double") * 1500.0).alias("diffuse"),
        )
    )
