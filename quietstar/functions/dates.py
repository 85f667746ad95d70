"""Date and time expressions (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def epoch_to_timestamp(value: Column) -> Column:
    """Milliseconds above 1e12, seconds above 1e9, otherwise a date-time text or a sentence that holds a date."""
    text = value.cast("string")
    number = text.try_cast("double")
    whole = number.cast("bigint")
    return (
        F.when(number > 1e12, F.timestamp_millis(whole))
        .when(number > 1e9, F.timestamp_seconds(whole))
        .otherwise(F.coalesce(F.try_to_timestamp(text), embedded_date(text).cast("timestamp")))
    )


def embedded_date(text: Column) -> Column:
    """The date inside a sentence such as "… on June 3, 2019"; null when there is none."""
    found = F.regexp_extract(text, fixed.EMBEDDED_DATE, 1)
    return F.try_to_date(F.nullif(found, F.lit("")), "MMMM d, yyyy")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def iso_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")
