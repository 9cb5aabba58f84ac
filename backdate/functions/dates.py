"""Date columns: literals, windows of calendar days, own-offset ISO dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from backdate.schemas import OPEN_END


def as_date(value: dt.date | str | Column) -> Column:
    """A date column from a date, an ISO string or a column."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def open_end() -> Column:
    return as_date(OPEN_END)


def day_bucket(date: Column, days: int) -> Column:
    """Number of the ``days``-wide calendar bucket; monotone in the date."""
    return F.floor(F.unix_date(date) / F.lit(days)).cast("int")


def published_date(iso_text: Column) -> Column:
    """Calendar date in the text's own offset; NULL when empty or not a date."""
    return F.try_to_date(F.substring(iso_text, 1, 10), "yyyy-MM-dd")
