"""Time arithmetic on microseconds since the epoch.

All comparisons of gaps use ``long`` microseconds, never fractional seconds, so a gap of exactly
the threshold falls on the right side. Nothing here depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MINUTE_US = 60 * 1_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def minutes(n: float) -> int:
    """A length in minutes as whole microseconds."""
    return round(n * MINUTE_US)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def slot(ts_us: Column | str, width_us: int) -> Column:
    """Number of the fixed-width time slot a moment falls in (exact, also before 1970)."""
    value, width = _col(ts_us), F.lit(width_us).cast("long")
    return F.call_function("div", value - F.pmod(value, width), width)


def ntz_to_us(ts: Column | str) -> Column:
    """Wall-clock timestamp without zone, read as UTC, as microseconds."""
    t = _col(ts)
    whole = (F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60) * 1_000_000
    return whole + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def us_to_ts_string(ts_us: Column | str) -> Column:
    """Microseconds to the ``seconds.micros`` form, six decimals."""
    return (_col(ts_us).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(20,6)").cast("string")


def ts_string_to_us(ts: Column | str) -> Column:
    """``seconds.micros`` text to microseconds; null when it is not a number."""
    return (_col(ts).try_cast("decimal(20,6)") * 1_000_000).cast("long")


def local_time(ts_us: Column | str, tz: Column | str) -> Column:
    """Wall clock (timestamp without zone) of a moment in zone ``tz``."""
    zone = F.lit(tz) if isinstance(tz, str) else tz
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                              (_col(ts_us).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), zone, F.expr(EPOCH) + span)


def local_day(ts_us: Column | str, tz: Column | str = "UTC") -> Column:
    """Calendar day of a moment in zone ``tz`` as a date."""
    if isinstance(tz, str) and tz == "UTC":
        return F.date_from_unix_date(slot(ts_us, DAY_US).cast("int"))
    return local_time(ts_us, tz).cast("date")


def day_bucket(ts_us: Column | str, tz: Column | str = "UTC") -> Column:
    """``yyyy-MM-dd`` of a moment in zone ``tz``."""
    return local_day(ts_us, tz).cast("string")


def day_start_us(day: Column | str, tz: Column | str = "UTC") -> Column:
    """Microseconds of the first moment of a calendar day in zone ``tz``."""
    zone = F.lit(tz) if isinstance(tz, str) else tz
    midnight = F.to_timestamp_ntz(_col(day).cast("string"), F.lit("yyyy-MM-dd"))
    return ntz_to_us(F.convert_timezone(zone, F.lit("UTC"), midnight))


def signed_gap_us(end_first: Column | str, start_second: Column | str) -> Column:
    """Start of the second minus end of the first; negative when they overlap."""
    return _col(start_second) - _col(end_first)


def minutes_between(first: Column | str, second: Column | str) -> Column:
    """Absolute fractional minutes."""
    return F.abs(_col(second) - _col(first)) / F.lit(float(MINUTE_US))
