"""Filters and small projections over rows of mail, candidates, alerts and bills, and the pages they are shown on."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def either_in_range(a: str, b: str, start=None, end=None) -> Column:
    """One of two timestamps on or after the start, and one, not always the same, on or before the end."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & F.coalesce((F.to_date(a) >= F.lit(start).cast("date")) | (F.to_date(b) >= F.lit(start).cast("date")), F.lit(False))
    if end is not None:
        ok = ok & F.coalesce((F.to_date(a) <= F.lit(end).cast("date")) | (F.to_date(b) <= F.lit(end).cast("date")), F.lit(False))
    return ok


def search(needle: str, columns: list[str], id_: str | None = None) -> Column:
    """Any column holds the needle, whatever the case; a needle of digits is an id too."""
    low = needle.strip().lower()
    ok = F.lit(False)
    for c in columns:
        ok = ok | F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False))
    return ok | (F.col(id_) == int(low)) if id_ and low.isdigit() else ok


def one_of(value, allowed: list[str], default: str) -> Column:
    """A parameter, as a column, if it is allowed, else the default; so is a null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isin(allowed), value).otherwise(default)


def either(rows: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that one condition or another lets through, each once: a null is no yes."""
    return rows.where(reduce(or_, (F.coalesce(c, F.lit(False)) for c in conditions)))


def overlaps(start: str, end: str, first, last) -> Column:
    return (F.col(start) <= F.lit(last).cast("date")) & (F.col(end) >= F.lit(first).cast("date"))


def awake(until: str, now) -> Column:
    """Not snoozed, or no more at `now`."""
    return F.col(until).isNull() | (F.col(until) <= F.lit(now).cast("timestamp"))


def due(kind: str, suggested: str, reviewed: str, today) -> Column:
    """has_due_date, no_due_date or overdue, over the suggested and the reviewed date."""
    day = F.lit(today).cast("date")
    return {
        "has_due_date": F.col(suggested).isNotNull() | F.col(reviewed).isNotNull(),
        "no_due_date": F.col(suggested).isNull() & F.col(reviewed).isNull(),
        "overdue": F.coalesce(F.col(suggested) < day, F.lit(False)) | F.coalesce(F.col(reviewed) < day, F.lit(False)),
    }[kind]


def effective(reviewed: str, original: str) -> Column:
    """What a reviewer set, unless empty, else the original."""
    return F.coalesce(F.nullif(F.col(reviewed), F.lit("")), F.col(original))


def own_sale(subject: str, email: str, issuer: str, names: list[str], senders: list[str]) -> Column:
    """Bills of one's own: the subject starts with an own name and arve, or sender or issuer are own."""
    s, ok = F.lower(F.coalesce(subject, F.lit(""))), F.lower(F.coalesce(email, F.lit(""))).isin(senders)
    for n in names:
        ok = ok | s.startswith(f"{n} arve")
    return ok | F.lower(F.coalesce(issuer, F.lit(""))).isin(names)


def period(key: str, today: dt.date) -> tuple[dt.date | None, dt.date | None]:
    """all, previous, current, year, and else the last three months, as closed ranges."""
    first = today.replace(day=1)
    if key == "all":
        return None, None
    if key == "previous":
        end = first - dt.timedelta(1)
        return end.replace(day=1), end
    if key == "current":
        return first, today
    if key == "year":
        return today.replace(month=1, day=1), today
    back = (first.year * 12 + first.month - 1) - 2
    return dt.date(back // 12, back % 12 + 1, 1), today


def in_period(c: Column, start, end) -> Column:
    """The first ten characters are a date within a range; what is no date is outside, without limits too."""
    day = F.substring(c, 1, 10).try_cast("date")
    return day.isNotNull() & (F.lit(True) if start is None else day >= F.lit(start)) & (F.lit(True) if end is None else day <= F.lit(end))


def safe_metadata(c: Column, keys: list[str]) -> Column:
    """A JSON object as a map of the listed keys alone."""
    return F.map_filter(F.from_json(c, "map<string,string>"), lambda k, v: k.isin(keys))


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """A page of rows with their position from 1; only the rows up to the page's end are brought together."""
    top = rows.orderBy(*order).limit(offset + size)
    return top.withColumn("position", F.row_number().over(W.orderBy(*order))).where(F.col("position") > offset)


def rank(c: Column, values: list[str]) -> Column:
    """The place of a value in a list; others come last."""
    at = F.array_position(F.array(*map(F.lit, values)), c)
    return F.when(at > 0, at).otherwise(len(values) + 1)


def samples(rows: DataFrame, flag: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows with the flag and the first n without."""
    marked = rows.withColumn("flag", flag)
    return marked.where("flag").orderBy(*order).limit(n).unionByName(marked.where("not flag").orderBy(*order).limit(n))


def chart_scale(rows: DataFrame, value: str, order: list[Column], n: int = 10) -> DataFrame:
    """Bars of the first n rows: offset and width in percent of the range from the least to the largest value and 0."""
    top = rows.orderBy(*order).limit(n)
    low, high = F.least(F.min(value).over(W.partitionBy()), F.lit(0)), F.greatest(F.max(value).over(W.partitionBy()), F.lit(0))
    span = high - low
    share = lambda x: F.when(span == 0, 0.0).otherwise(F.bround(x.cast("double") / span.cast("double") * 100, 2))
    return top.select("*", share(F.least(F.col(value), F.lit(0)) - low).alias("offset"), share(F.abs(F.col(value))).alias("width"))


def nice_interval(basis: Column, ticks: int = 5) -> Column:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that cuts a range into at most so many parts; 0 for none."""
    target = basis.cast("double") / ticks
    scale = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    share = target / scale
    factor = F.when(share <= 1, 1.0).when(share <= 2, 2.0).when(share <= 2.5, 2.5).when(share <= 5, 5.0).otherwise(10.0)
    return F.when(target > 0, factor * scale).otherwise(0.0)


def axis(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(*keys, low, high, interval, n_ticks): the axis of each chart's values, from 0 or a multiple of the interval below the
    least to 0 or one above the largest; the range counts where both signs are there, else the larger side."""
    g = rows.groupBy(*keys).agg(F.greatest(F.max(value), F.lit(0)).cast("double").alias("_high"), F.least(F.min(value), F.lit(0)).cast("double").alias("_low"))
    g = g.withColumn("interval", nice_interval(F.col("_high") - F.col("_low")))
    up = lambda c: F.when(F.col("interval") > 0, F.ceil(c / F.col("interval")) * F.col("interval")).otherwise(0.0)
    g = g.withColumn("high", up(F.col("_high"))).withColumn("low", 0 - up(-F.col("_low")))
    n = F.when(F.col("interval") > 0, F.round((F.col("high") - F.col("low")) / F.col("interval")) + 1).otherwise(0).cast("long")
    return g.select(*keys, "low", "high", "interval", n.alias("n_ticks"))
