"""Amounts: parsing, comparing, rounding and display."""

from __future__ import annotations

from pyspark.sql import functions as F


def let(c, f):
    """f of c's value: c is computed once, however often f names it, inside of lambdas too."""
    return F.get(F.transform(F.array(c), f), 0)


def parse_decimal(c):
    """Comma for the point; what is no number is 0."""
    return F.coalesce(F.regexp_replace(c, ",", ".").try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))


def normalize_amount(c):
    """Text without spaces; with both marks dots are thousands; the comma is the decimal mark."""
    dots = lambda c: F.when(c.contains(",") & c.contains("."), F.regexp_replace(c, r"\.", "")).otherwise(c)
    return F.regexp_replace(let(F.regexp_replace(c, "[  ]", ""), dots), ",", ".")


def amounts_equal(a, b, cents: float = 0.01):
    """Within a cent; an invoice amount b of 0 equals nothing."""
    return (F.abs(a - b) <= F.lit(cents).cast("decimal(20,6)")) & (b != 0)


def same_cent(a, b):
    return F.bround(a, 2) == F.bround(b, 2)


def payment_status(total, paid, tolerance: float = 0.005):
    """paid, partially_paid or unpaid of two texts, blank as 0; unknown where either is no number."""
    t, p = (F.when(F.trim(F.coalesce(c, F.lit(""))) == "", 0.0).otherwise(c.try_cast("double")) for c in (total, paid))
    return F.when(t.isNull() | p.isNull(), "unknown").when(p <= 0, "unpaid").when(p + tolerance >= t, "paid").otherwise("partially_paid")


def margin(result, revenue):
    """Percent of revenue, half-even to 2 places; null without revenue."""
    return F.when(revenue != 0, F.bround(result.cast("double") / revenue.cast("double") * 100, 2))


def display_amount(c, grouping: bool = True):
    """1 234,56: half up to 2 places, spaces for thousands unless grouping is off."""
    shown = F.round(c, 2)
    return F.translate(F.format_number(shown, 2) if grouping else shown.cast("decimal(38,2)").cast("string"), ",.", " ,")


def row_status(flag_text, total, paid):
    """paid by a flag or by the amount, partially_paid or unpaid of a ledger row."""
    is_paid = F.coalesce(F.lower(F.trim(flag_text)).isin("true", "1", "yes", "paid"), F.lit(False)) | ((total != 0) & (paid >= total))
    return F.when(is_paid, "paid").when((paid > 0) & (paid < total), "partially_paid").otherwise("unpaid")


def display_percent(c, grouping: bool = True):
    """12,50%, or - for null."""
    return F.coalesce(F.concat(display_amount(c, grouping), F.lit("%")), F.lit("-"))


def flag(c):
    """true, 1, yes as true and false, 0, no as false; else null."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
