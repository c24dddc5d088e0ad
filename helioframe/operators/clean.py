"""Row-local cleaning. Every operator is a projection and applies to streams unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from helioframe.functions.exprs import capacity_factor, is_night
from helioframe.schema import TALL, Axis


def night_generation(ts: Column | str, generation: str, threshold: float) -> Column:
    return is_night(ts) & (F.col(generation) > threshold)


def night_irradiance(ts: Column | str, direct: str, diffuse: str, threshold: float) -> Column:
    return is_night(ts) & (F.col(direct) + F.col(diffuse) > threshold)


def _observed(df: DataFrame, observation: Observation | None, name: str, cond: Column) -> DataFrame:
    return df if observation is None else df.observe(observation, F.count_if(cond).alias(name))


def clip_nighttime_generation(
    df: DataFrame,
    generation: str = "generation",
    threshold: float = 1.0,
    axis: Axis = TALL,
    observation: Observation | None = None,
) -> DataFrame:
    """Night output above ``threshold`` becomes 0.0; missing values stay missing.

    ``observation`` receives ``night_clips``, the number of rows changed in the next action.
    (An action that reads its input twice, such as a sort, counts twice; ``cleaning_audit``
    does not depend on the action.)
    """
    wrong = night_generation(axis.ts, generation, threshold)
    df = _observed(df, observation, "night_clips", wrong)
    return df.withColumn(generation, F.when(wrong, F.lit(0.0)).otherwise(F.col(generation)))


def clip_nighttime_irradiance(
    df: DataFrame,
    direct: str = "direct",
    diffuse: str = "diffuse",
    threshold: float = 1.0,
    axis: Axis = TALL,
    observation: Observation | None = None,
) -> DataFrame:
    """Both components become 0.0 where their night-time sum exceeds ``threshold``.

    A missing component makes the sum unknown and leaves the row as it is.
    """
    wrong = night_irradiance(axis.ts, direct, diffuse, threshold)
    df = _observed(df, observation, "irradiance_clips", wrong)
    return df.withColumns(
        {c: F.when(wrong, F.lit(0.0)).otherwise(F.col(c)) for c in (direct, diffuse)}
    )


def normalize_to_capacity_factor(
    df: DataFrame,
    generation: str = "generation",
    capacity: str = "capacity",
    output: str = "cf",
    observation: Observation | None = None,
) -> DataFrame:
    """Add ``output`` = generation / capacity in [0, 1]; NULL where capacity is unknown."""
    over = F.col(generation) > F.col(capacity)
    df = _observed(df, observation, "over_capacity", over)
    return df.withColumn(output, capacity_factor(F.col(generation), F.col(capacity)))


def add_ghi(
    df: DataFrame, direct: str = "direct", diffuse: str = "diffuse", output: str = "ghi"
) -> DataFrame:
    """Global horizontal irradiance; NULL if either component is."""
    return df.withColumn(output, F.col(direct) + F.col(diffuse))


def cleaning_audit(
    readings: DataFrame,
    weather: DataFrame,
    night_solar_threshold: float = 1.0,
    night_ghi_threshold: float = 1.0,
    axis: Axis = TALL,
) -> DataFrame:
    """How many raw rows each cleaning rule would change, one row per rule."""
    counted = readings.agg(
        F.count_if(night_generation(axis.ts, "generation", night_solar_threshold)).alias(
            "night_clips"
        ),
        F.count_if(F.col("generation") > F.col("capacity")).alias("over_capacity"),
    ).unpivot([], ["night_clips", "over_capacity"], "rule", "rows_changed")
    irradiance = weather.agg(
        F.count_if(night_irradiance(axis.ts, "direct", "diffuse", night_ghi_threshold)).alias(
            "irradiance_clips"
        )
    ).unpivot([], ["irradiance_clips"], "rule", "rows_changed")
    return counted.unionByName(irradiance)


def fill_audit(before: DataFrame, after: DataFrame, columns: list[str], axis: Axis = TALL) -> DataFrame:
    """How many missing hours were really filled, one row per column."""
    present = [F.count(c).alias(c) for c in columns]
    counts = (
        before.agg(*present)
        .unpivot([], columns, "column", "present_before")
        .join(after.agg(*present).unpivot([], columns, "column", "present_after"), "column")
    )
    return counts.select(
        "column", (F.col("present_after") - F.col("present_before")).alias("filled_hours")
    )
