"""Partial dates: never invent a day or a month."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sentinelweave.functions.text import strip_text

FULL_DATE = r"^\d{4}-\d{2}-\d{2}$"


def iso_date(c: Column) -> Column:
    """Full ISO date or null.  A bare year or month is not a date."""
    return F.when(c.rlike(FULL_DATE), F.try_to_date(c, "yyyy-MM-dd"))


def partial_date(
    date: Column, year: Column, month: Column, precision: Column, verbatim: Column, keep_zero: bool = True
) -> Column:
    """Normalise one date point into ``struct<date,year,month,precision,verbatim,note>``.

    ``note`` names what was preserved: ``year``, ``month`` or ``verbatim``; null when the
    point was already complete or empty.
    """
    value = strip_text(date)
    full = iso_date(value).isNotNull()
    only_year = value.rlike(r"^\d{4}$")
    month_number = F.try_element_at(F.split(value, "-"), F.lit(2)).try_cast("int")
    only_month = value.rlike(r"^\d{4}-\d{2}$") & month_number.between(1, 12)
    head = F.substring(value, 1, 4).try_cast("int")
    kept = F.when(F.length(verbatim) > 0, verbatim).otherwise(value)
    present = (lambda c: c) if keep_zero else (lambda c: F.nullif(c, F.lit(0)))
    absent = date.isNull()
    return F.struct(
        F.when(absent | full, date).alias("date"),
        F.when(absent, year)
        .when(full, F.coalesce(present(year), head))
        .when(only_year | only_month, head)
        .otherwise(year)
        .alias("year"),
        F.when(absent, month)
        .when(full, F.coalesce(present(month), F.substring(value, 6, 2).try_cast("int")))
        .when(only_year, F.lit(None).cast("int"))
        .when(only_month, month_number)
        .otherwise(month)
        .alias("month"),
        F.when(absent, F.coalesce(precision, F.lit("unknown")))
        .when(full, "day")
        .when(only_year, "year")
        .when(only_month, "month")
        .otherwise("unknown")
        .alias("precision"),
        F.when(absent | full, verbatim).otherwise(kept).alias("verbatim"),
        F.when(absent | full, F.lit(None).cast("string"))
        .when(only_year, "year")
        .when(only_month, "month")
        .otherwise("verbatim")
        .alias("note"),
    )


def first_day(point: Column) -> Column:
    """First day a partial date can mean."""
    year, month = point["year"], point["month"]
    opening = F.when(year.isNotNull(), F.make_date(year, F.when(month.between(1, 12), month).otherwise(F.lit(1)), F.lit(1)))
    return F.coalesce(iso_date(point["date"]), opening)


def last_day(point: Column) -> Column:
    """Last day a partial date can mean."""
    year, month = point["year"], point["month"]
    closing = F.when(
        year.isNotNull(), F.last_day(F.make_date(year, F.when(month.between(1, 12), month).otherwise(F.lit(12)), F.lit(1)))
    )
    return F.coalesce(iso_date(point["date"]), closing)


def date_bounds(point: Column) -> Column:
    """``struct<lo,hi>`` of a partial date; both null when unknown."""
    return F.struct(first_day(point).alias("lo"), last_day(point).alias("hi"))


def signal_interval(event_date: Column, reference_period: Column) -> Column:
    """Interval a signal covers: its event date, else its reference period."""
    start = iso_date(event_date["start"].cast("string"))
    end = iso_date(event_date["end"].cast("string"))
    opens, closes = reference_period["start"], reference_period["end"]
    low = F.coalesce(start, first_day(opens), first_day(closes))
    high = F.when(start.isNotNull(), F.coalesce(end, start)).otherwise(F.coalesce(last_day(closes), last_day(opens)))
    return F.struct(low.alias("lo"), high.alias("hi"))
