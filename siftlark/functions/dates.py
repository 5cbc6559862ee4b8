"""Dates of varying precision (D1-D8). Precision is never invented and uncertainty stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR, MONTH, DAY = r"^\d{4}$", r"^\d{4}-\d{2}$", r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"
STALE_DAYS = 365


def _valid_day(text: Column) -> Column:
    return F.when(text.rlike(DAY), F.try_to_date(text, "yyyy-MM-dd"))


def _instant(text: Column) -> Column:
    zoned = text.rlike(DATETIME) & text.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def partial_date(text: Column) -> Column:
    """Struct source_value, precision, normalized_date, normalized_at; null if the text is no valid date."""
    first_of_month = F.try_to_date(F.concat(F.substring(text, 1, 7), F.lit("-01")), "yyyy-MM-dd")
    moment = F.when(text.rlike(DATETIME), F.try_to_timestamp(text))
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")

    def built(precision: str, date: Column, at: Column) -> Column:
        return F.struct(text.alias("source_value"), F.lit(precision).alias("precision"), date.cast("date").alias("normalized_date"), at.cast("timestamp").alias("normalized_at"))

    none = F.lit(None)
    return (
        F.when(text.rlike(YEAR) & (text > "0000"), built("year", none, none))
        .when(text.rlike(MONTH) & first_of_month.isNotNull(), built("month", none, none))
        .when(_valid_day(text).isNotNull(), built("day", _valid_day(text), none))
        .when(moment.isNotNull() & day.isNotNull(), built("datetime", day, _instant(text)))
    )


def age_years(born: Column, on: Column) -> Column:
    """Completed years; the day of a leap-year birthday counts from its own month and day."""
    before = F.struct(F.month(on).alias("m"), F.dayofmonth(on).alias("d")) < F.struct(F.month(born).alias("m"), F.dayofmonth(born).alias("d"))
    return F.year(on) - F.year(born) - before.cast("int")


def birth_range(text: Column) -> Column:
    """Struct earliest, latest of a birth date given by year, month or day; null if it is none of them."""
    year = F.when(text.rlike(YEAR) & (text > "0000"), F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd"))
    month = F.when(text.rlike(MONTH), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))
    pair = lambda a, b: F.struct(a.alias("earliest"), b.alias("latest"))
    return (
        F.when(year.isNotNull(), pair(year, F.make_date(F.year(year), F.lit(12), F.lit(31))))
        .when(month.isNotNull(), pair(month, F.last_day(month)))
        .when(_valid_day(text).isNotNull(), pair(_valid_day(text), _valid_day(text)))
    )


def is_stale(date: Column, evaluated_on: Column) -> Column:
    return date <= F.date_sub(evaluated_on, STALE_DAYS)


def lag_seconds(retrieved: Column, updated: Column) -> Column:
    return (F.unix_timestamp(retrieved) - F.unix_timestamp(updated)).cast("long")
