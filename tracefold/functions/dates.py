"""Dates: local days, strict checks, ranges, epoch parsing, back-off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold import fixed_values as fv


def parse_iso(value: Column) -> Column:
    return F.try_to_timestamp(value)


def local_date(value: Column, tz: str = "UTC") -> Column:
    """Local day of an ISO text; the first ten characters where it does not parse."""
    day = F.date_format(F.from_utc_timestamp(parse_iso(value), tz), "yyyy-MM-dd")
    return F.coalesce(day, F.substring(value, 1, 10))


def local_day(instant: Column, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(instant, tz))


def is_calendar_date(value: Column) -> Column:
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.coalesce(shaped & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit(False))


def in_range(day: Column, start, end) -> Column:
    return day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def week_end(day: Column) -> Column:
    return F.date_add(week_start(day), 6)


def month_grid_start(day: Column) -> Column:
    return week_start(F.trunc(day, "month"))


def month_grid_end(day: Column) -> Column:
    return week_end(F.last_day(day))


def shift_range(day: Column, mode: str, direction: int) -> Column:
    return F.date_add(day, direction * (7 if mode == "week" else 1))


def shift_month(day: Column, direction: int) -> Column:
    return F.add_months(day, direction)


def parse_epoch_or_iso(value: Column) -> Column:
    """Numbers below ten thousand million are seconds, larger ones milliseconds, anything else ISO."""
    text = value.cast("string")
    number = text.try_cast("double")
    millis = F.when(number < 10_000_000_000, number * 1000).otherwise(number)
    return F.when(number > 0, F.timestamp_millis(millis.cast("long"))).otherwise(parse_iso(text))


def backoff_until(now: Column, attempts: Column, retry_after_ms: Column, base_ms=60_000, cap_ms=86_400_000) -> Column:
    step = F.least(F.lit(cap_ms).cast("double"), F.lit(base_ms) * F.pow(F.lit(2.0), F.least(F.lit(8), attempts - 1)))
    delay = F.when(F.coalesce(retry_after_ms, F.lit(0)) > 0, retry_after_ms.cast("double")).otherwise(step)
    return F.timestamp_millis((F.unix_millis(now) + delay).cast("long"))


def is_stale(last: Column, now: Column, hours: float = fv.STALE_HOURS) -> Column:
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last) > F.lit(int(hours * 3_600_000_000)), F.lit(True))


def hours_after(instant: Column, hours: Column | float) -> Column:
    span = hours if isinstance(hours, Column) else F.lit(float(hours))
    return F.timestamp_micros((F.unix_micros(instant) + span * 3_600_000_000).cast("long"))
