"""Dates: parsing, months and due dates. Today is always a parameter."""

from __future__ import annotations

from pyspark.sql import functions as F


def iso_date(c):
    """A date from the first 10 characters; null where they are none."""
    return F.substring(c, 1, 10).try_cast("date")


def any_date(c):
    """d.m.Y, Y-m-d or d/m/Y; else null."""
    forms = ("d.M.yyyy", "yyyy-M-d", "d/M/yyyy")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in forms))


def months_between_dates(start, end):
    """Array of (month start, clipped start, clipped end) for the calendar months that a closed interval touches."""
    first = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.transform(first, lambda m: F.struct(m.alias("month"), F.greatest(m, start).alias("start"), F.least(F.last_day(m), end).alias("end")))


def chunks(start, end, days: int = 31):
    """Array of (start, end) of at most `days` days each."""
    return F.transform(F.sequence(start, end, F.expr(f"interval {days} days")), lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, days - 1), end).alias("end")))


def net_date(c):
    """/Date(ms)/ or the first 10 characters as a date."""
    ms = F.regexp_extract(c, r"/Date\((-?[0-9]+)", 1)
    return F.coalesce(F.when(ms != "", F.to_date(F.timestamp_millis(ms.cast("long")))), iso_date(c))


WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def due_date(text, today):
    """The first of: an ISO date, tomorrow / homme, `by <weekday>` (the same weekday is a week ahead)."""
    low = F.lower(text)
    weekday = F.lit(None).cast("date")
    for d in reversed(WEEKDAYS):
        weekday = F.when(low.rlike(rf"\bby {d}\b"), F.next_day(today, d[:3])).otherwise(weekday)
    iso = F.regexp_extract(text, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1).try_cast("date")
    return F.coalesce(iso, F.when(low.rlike(r"\b(tomorrow|homme)\b"), F.date_add(today, 1)), weekday)


def rolling_cutoff(today, months: int):
    return F.add_months(F.trunc(today, "MM"), -(months - 1))


def month_bounds(c):
    return F.to_date(F.trunc(c, "MM")), F.last_day(c)


def is_partial_month(c):
    return F.dayofmonth(c) < F.dayofmonth(F.last_day(c))


def quarters(start, end):
    """Array of (start, end) of the calendar quarters from the first of the start's year to the end, the last one clipped."""
    first = F.sequence(F.to_date(F.trunc(start, "YYYY")), end, F.expr("interval 3 months"))
    return F.transform(first, lambda q: F.struct(q.alias("start"), F.least(F.date_sub(F.add_months(q, 3), 1), end).alias("end")))


def later(a, b):
    """The later of two ISO dates; the one that is valid, or nothing."""
    x, y = iso_date(a), iso_date(b)
    return F.coalesce(F.greatest(x, y).cast("string"), F.lit(""))
