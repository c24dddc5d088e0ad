"""helioframe: photovoltaic time-series analytics as Spark DataFrame operators."""

from helioframe.schema import TALL, WIDE, Axis, PreprocessConfig, SiteConfig, Split

__all__ = ["TALL", "WIDE", "Axis", "PreprocessConfig", "SiteConfig", "Split"]
