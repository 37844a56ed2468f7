"""Dates in Japan time. Timestamps are zone-free UTC; Japan is a fixed nine hours ahead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = "interval 9 hours"


def jst_day_start(day: str | Column) -> Column:
    """The UTC instant at which a Japan day starts."""
    day = F.lit(day).cast("timestamp_ntz") if isinstance(day, str) else day.cast("timestamp_ntz")
    return day - F.expr(OFFSET)


def to_jst(ts: Column) -> Column:
    return ts + F.expr(OFFSET)


def jst_date(ts: Column) -> Column:
    return to_jst(ts).cast("date")


def between_days(ts: Column, day: str, first: int, last: int) -> Column:
    """ts is in the Japan days [day + first, day + last)."""
    start = jst_day_start(day)
    return (ts >= start + F.expr(f"interval {first} days")) & (ts < start + F.expr(f"interval {last} days"))


def within_hours(ts: Column, opens: str = "09:00", closes: str = "18:00", days: tuple = (0, 1, 2, 3, 4)) -> Column:
    """Business hours in Japan time, the last minute included; days: 0 is Monday."""
    local = to_jst(ts)
    minute = F.hour(local) * 60 + F.minute(local)
    low, high = (int(x[:2]) * 60 + int(x[3:]) for x in (opens, closes))
    return F.weekday(local).isin(*days) & minute.between(low, high)


def next_business_day(day: Column, holidays: list[str]) -> Column:
    """The first day from ``day`` on that is neither a weekend day nor a holiday."""
    closed = F.array(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.array().cast("array<date>")
    ahead = F.transform(F.sequence(F.lit(0), F.lit(7 + 3 * len(holidays))), lambda k: F.date_add(day, k))
    return F.element_at(F.filter(ahead, lambda d: (F.weekday(d) < 5) & ~F.array_contains(closed, d)), 1)


def parse_clock(c: Column) -> Column:
    """Minutes after midnight of HH:MM, or null."""
    hour, minute = (F.regexp_extract(c, r"^([01]?\d|2[0-3]):([0-5]\d)$", k) for k in (1, 2))
    return F.when(hour != "", hour.cast("int") * 60 + minute.cast("int"))


def parse_days(c: Column) -> Column:
    """Week days 0 to 6 of a JSON list; Monday to Friday if there are none."""
    days = F.filter(F.from_json(c, "array<bigint>"), lambda d: d.between(0, 6))
    return F.when(F.size(F.coalesce(days, F.array().cast("array<bigint>"))) > 0, days).otherwise(F.array(*[F.lit(k).cast("bigint") for k in range(5)]))


def deadline(day: Column, closes: str = "18:00", grace_minutes: int = 2) -> Column:
    """The UTC instant at which a Japan day's sending ends."""
    minutes = int(closes[:2]) * 60 + int(closes[3:]) + grace_minutes
    return jst_day_start(day) + F.expr(f"interval {minutes} minutes")


def session_hours(own: Column, shared: Column, default: float = 8.0) -> Column:
    """The first of the row's own hours, those of the environment and the default that is a positive number."""
    hours = lambda c: F.nullif(F.greatest(F.trim(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(hours(own), hours(shared), F.lit(default))
