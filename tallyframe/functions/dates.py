"""Date expressions. Inputs are DATE or TIMESTAMP columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday order for reports, and accepted day-first formats.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-MM-dd", "d/M/yyyy HH:mm", "d/M/yyyy HH:mm:ss")


def year_month(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def weekday_name(column: Column) -> Column:
    return F.date_format(column, "EEEE")


def quarter_label(column: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(column).cast("string"))


def sunday_week(column: Column) -> Column:
    """Week 0-53 with Sunday as first day; week 1 holds the year's first Sunday."""
    first_day = F.trunc(column, "year")
    days_before_sunday = F.pmod(F.lit(8) - F.dayofweek(first_day), F.lit(7))
    return F.floor((F.dayofyear(column) + F.lit(6) - days_before_sunday) / F.lit(7)).cast("int")


def sunday_year_week(column: Column) -> Column:
    """yyyyww on the same rule; days before the first Sunday count on from last year."""
    week = sunday_week(column)
    last_year_end = F.make_date(F.year(column) - 1, F.lit(12), F.lit(31))
    return F.when(week > 0, F.year(column) * 100 + week).otherwise(
        (F.year(column) - 1) * 100 + sunday_week(last_year_end)
    )


def days_left_in_year(as_of: Column) -> Column:
    return F.datediff(F.make_date(F.year(as_of), F.lit(12), F.lit(31)), as_of)


def whole_months(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MONTH", start, end)


def age_years(start: Column, end: Column) -> Column:
    return F.floor(whole_months(start, end) / 12).cast("int")


def age_months(start: Column, end: Column) -> Column:
    return (whole_months(start, end) % 12).cast("int")


def age_days(start: Column, end: Column) -> Column:
    return F.datediff(end, F.add_months(start, whole_months(start, end).cast("int")))


def age_text(start: Column, end: Column) -> Column:
    """``Y years, M months, D days``."""
    return F.format_string(
        "%d years, %d months, %d days", age_years(start, end), age_months(start, end), age_days(start, end)
    )


def parse_day_first(column: Column, formats: Sequence[str] = DAY_FIRST_FORMATS) -> Column:
    """Timestamp from day-first text; text that fits no format gives NULL."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(column), F.lit(f)) for f in formats])
