"""Timestamps as UTC wall-clock time (TIMESTAMP_NTZ) and hour arithmetic on them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.functions.exprs import as_column

EPOCH = datetime(1970, 1, 1)

# How an ISO text ends if it has a time and names its zone.
_ZONE = r"\d:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)$"

# Text length of a bound and the period a bound of that length stands for.
_RESOLUTION = {
    10: timedelta(days=1),
    13: timedelta(hours=1),
    16: timedelta(minutes=1),
    19: timedelta(seconds=1),
}


def parse_instant(text: str | datetime) -> datetime:
    """An exact UTC instant; a bare date means midnight."""
    moment = text if isinstance(text, datetime) else datetime.fromisoformat(text)
    if moment.tzinfo is not None:
        moment = (moment - moment.utcoffset()).replace(tzinfo=None)
    return moment


def end_of_period(text: str) -> datetime:
    """First instant after the period ``text`` names, e.g. the next second or the next day."""
    return parse_instant(text) + _RESOLUTION.get(len(text), timedelta(microseconds=1))


def instant(moment: str | datetime) -> Column:
    stamp = parse_instant(moment).isoformat(sep=" ")
    return F.lit(stamp).cast("timestamp_ntz")


def between(ts: Column | str, start: str | datetime, end: str | datetime) -> Column:
    """Inclusive window, written as plain comparisons so that it reaches the file scan."""
    col = as_column(ts)
    return (col >= instant(start)) & (col <= instant(end))


def utc_from_instant(moment: Column) -> Column:
    """TIMESTAMP -> UTC wall-clock time, whatever the session time zone is."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(moment), instant(EPOCH))


def utc_from_text(text: Column | str) -> Column:
    """ISO text with a zone -> UTC wall-clock time; text without a zone raises."""
    col = as_column(text)
    zoned = F.when(col.rlike(_ZONE), col).when(
        col.isNotNull(), F.raise_error(F.concat(F.lit("timestamp without a zone: "), col))
    )
    return utc_from_instant(zoned.cast("timestamp"))


def require_utc(df: DataFrame, ts: str) -> DataFrame:
    """``ts`` as TIMESTAMP_NTZ; a column that is no point in time is refused."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampNTZType):
        return df
    if isinstance(kind, T.TimestampType):
        return df.withColumn(ts, utc_from_instant(F.col(ts)))
    raise ValueError(f"{ts} must be a UTC timestamp, got {kind.simpleString()}")


def _epoch_hour(ts: Column) -> Column:
    # Date and hour parts depend on no session time zone; timestampdiff would cast to one.
    return F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)


def hours_since(ts: Column | str, origin: str | datetime = EPOCH) -> Column:
    """Whole hours from ``origin`` to ``ts``, rounded down."""
    moment = parse_instant(origin)
    whole = moment.replace(minute=0, second=0, microsecond=0)
    late = int((moment - whole).total_seconds() * 1_000_000)
    col = as_column(ts)
    if late:
        col = F.timestamp_add("MICROSECOND", F.lit(-late), col)
    return _epoch_hour(col) - (whole - EPOCH) // timedelta(hours=1)


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours from one TIMESTAMP_NTZ to another."""
    elapsed = end - start
    days = F.extract(F.lit("DAY"), elapsed).cast("bigint")
    return days * 24 + F.extract(F.lit("HOUR"), elapsed)


def plus_hours(ts: Column | str, hours: Column | int) -> Column:
    step = hours if isinstance(hours, Column) else F.lit(hours)
    return F.timestamp_add("HOUR", step, as_column(ts))


def floor_hour(ts: Column | str) -> Column:
    # date_trunc would answer with a session-zone TIMESTAMP.
    return plus_hours(instant(EPOCH), hours_since(ts))


def grid_hours(start: str | datetime, end: str | datetime) -> int:
    """Number of hourly points from ``start`` up to ``end``, both included."""
    return int((parse_instant(end) - parse_instant(start)) // timedelta(hours=1)) + 1
