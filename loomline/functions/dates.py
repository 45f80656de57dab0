"""Document dates: five accepted forms, zone-free, with an explicit ``as_of`` instead of a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_date(text: Column) -> Column:
    """TIMESTAMP_NTZ of a date string, cut at the first + and then Z; null if no form fits."""
    cut = F.split_part(F.split_part(text, F.lit("+"), F.lit(1)), F.lit("Z"), F.lit(1))
    iso = r"^\d{4}-\d{1,2}-\d{1,2}(?:T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?)?$"
    day_first = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$"
    form = F.when(cut.rlike(iso), F.replace(cut, F.lit("T"), F.lit(" "))).when(cut.rlike(day_first), F.regexp_replace(cut, day_first, "$4-$3-$1"))
    return form.try_cast("timestamp_ntz")


def display_date(text: Column) -> Column:
    """Day, month name and year; what cannot be read stays as it is."""
    return F.coalesce(F.date_format(document_date(text), "dd MMMM yyyy"), text)


def elapsed_days(moment: Column, as_of: Column) -> Column:
    """Whole days of elapsed time, rounded down."""
    return F.floor(F.timestamp_diff("SECOND", moment, as_of) / 86400).cast("int")


def is_recent(text: Column, as_of: Column, most_days: int) -> Column:
    """True without a readable date, else whether it is at most so many days old."""
    age = elapsed_days(document_date(text), as_of)
    return age.isNull() | (age <= most_days)


def is_outdated(text: Column, as_of: Column, days: int = 365) -> Column:
    return F.coalesce(elapsed_days(document_date(text), as_of) > days, F.lit(False))


def as_of_text(as_of: Column, pattern: str = "dd.MM.yyyy") -> Column:
    return F.date_format(as_of, pattern)


def next_weekly(moment: Column, weekday: str = "SUN", hour: int = 2) -> Column:
    """The first such hour of the week after a moment: when a weekly run is due that last ran then."""
    day = F.to_date(moment)
    today = (F.date_format(day, "EEE") == weekday.capitalize()) & (F.hour(moment) < hour)
    return (F.when(today, day).otherwise(F.next_day(day, weekday)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))).cast("timestamp_ntz")
