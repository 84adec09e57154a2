"""Timestamps without time zone: parsing, and seconds for bucketing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted layouts, yyyy-MM-dd[ HH:mm[:ss[.SSS]]].
DATE_LAYOUT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
MINUTE_LAYOUT = DATE_LAYOUT + r" [0-9]{2}:[0-9]{2}"
SECOND_LAYOUT = MINUTE_LAYOUT + r":[0-9]{2}"
MILLI_LAYOUT = SECOND_LAYOUT + r"\.[0-9]{3}"


def _as_ntz(c: Column, *layouts: str) -> Column:
    shape = "^(" + "|".join(layouts) + r")\z"
    return F.when(c.rlike(shape), c.try_cast("timestamp_ntz"))


def parse_ts(c: Column) -> Column:
    """Timestamp in one of the four layouts, null when it is in none of them."""
    return _as_ntz(c, DATE_LAYOUT, MINUTE_LAYOUT, SECOND_LAYOUT, MILLI_LAYOUT)


def created_at_ts(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` as a timestamp, null when bad."""
    return _as_ntz(c, SECOND_LAYOUT)


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970 of a timestamp column, growing with the time.

    A timestamp without zone is counted on its own calendar, so the session time
    zone and its clock changes play no part.
    """
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        days = F.datediff(F.to_date(c), F.to_date(F.lit("1970-01-01"))).cast("bigint")
        return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.unix_seconds(c)


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, on its own calendar if it has no zone."""
    c = F.col(name)
    return F.unix_micros(as_instant(c) if isinstance(df.schema[name].dataType, T.TimestampNTZType) else c)


def as_instant(ts: Column) -> Column:
    """A timestamp without zone as the instant it names in UTC, for watermarks."""
    days = F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01"))).cast("bigint")
    whole = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.timestamp_micros(whole * 1_000_000 + micros)


def as_calendar(instant: Column) -> Column:
    """The UTC calendar time, without zone, of an instant; undoes ``as_instant``."""
    secs = (F.unix_micros(instant) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=secs)


def seconds(n) -> Column:
    """Day-time interval of ``n`` seconds (a number or a column)."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def span(n: float) -> str:
    """A number of seconds as window functions take it, in whole microseconds."""
    return f"{round(n * 1_000_000)} microseconds"
