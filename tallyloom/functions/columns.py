"""Column functions used by more than one subject."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_12(ts: Column | str) -> Column:
    """12-hour clock with a trailing blank, such as ``01:05 PM ``."""
    return F.date_format(ts, "hh:mm a ")


def clock_24(ts: Column | str) -> Column:
    return F.date_format(ts, "HH:mm:ss")


# Written forms of a day besides ISO: slashes put the year or the month first, dashes and dots the day.
DAY_FORMS = (
    "yyyy/M/d",
    "M/d/yyyy",
    "d-M-yyyy",
    "d.M.yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
)


def day_of(text: str) -> Column:
    """The day a date text names; unreadable text gives NULL, which matches no row.

    The text is a parameter, so all of this folds to one date before the plan is made.
    """
    given = F.lit(text.strip())
    forms = [F.try_to_date(given, form) for form in DAY_FORMS]
    return F.coalesce(F.try_to_date(given), F.to_date(F.try_to_timestamp(given)), *forms)


def url_decoded(text: str) -> Column:
    """Decoded text; text that is not valid percent-encoding stays as it is."""
    return F.coalesce(F.try_url_decode(F.lit(text)), F.lit(text))


def or_blank(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
