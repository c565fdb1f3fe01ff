"""Time expressions on zone-less timestamps, independent of the session time zone."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 as BIGINT."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    whole = (
        F.extract(F.lit("DAY"), since).cast("bigint") * F.lit(86_400)
        + F.extract(F.lit("HOUR"), since).cast("bigint") * F.lit(3_600)
        + F.extract(F.lit("MINUTE"), since).cast("bigint") * F.lit(60)
    )
    seconds = (F.extract(F.lit("SECOND"), since) * F.lit(MICROS)).cast("bigint")
    return whole * F.lit(MICROS) + seconds


def at_micros(us: int) -> Column:
    """The time of ``micros`` as a constant, so that rows are compared by their time as it is."""
    seconds = F.lit(Decimal(us).scaleb(-6)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def cell(us: Column, width: Column | int) -> Column:
    """Number of the fixed-width time cell holding ``us`` (floor, also before 1970)."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.call_function("div", us - F.pmod(us, width), width)


def _part(ts: Column, start: int, length: int) -> Column:
    # as text, because the date formatting functions go through the session zone
    return F.substr(ts.cast("string"), F.lit(start), F.lit(length))


def hour_label(ts: Column) -> Column:
    """``2024-01-31T13:00:00``"""
    return F.concat(_part(ts, 1, 10), F.lit("T"), _part(ts, 12, 2), F.lit(":00:00"))


def iso_utc(ts: Column) -> Column:
    """``2024-01-31T13:59:59.000001+00:00``"""
    fraction = F.rpad(_part(ts, 21, 6), 6, "0")
    return F.concat(_part(ts, 1, 10), F.lit("T"), _part(ts, 12, 8), F.lit("."), fraction, F.lit("+00:00"))


def utc_now() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
