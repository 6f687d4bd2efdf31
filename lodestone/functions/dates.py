"""Dates of year, month or day precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parsed(text: Column, month: str, day: str) -> Column:
    full = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit(f"-{month}-{day}"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit(f"-{day}"))).otherwise(text)
    return F.to_date(F.try_to_timestamp(full, F.lit("yyyy-MM-dd")))


def date_mid(text: Column) -> Column:
    """The period's middle: July 1st of a year, the 15th of a month."""
    return F.when(text.rlike(r"^\d{4}$"), F.to_date(F.try_to_timestamp(F.concat(text, F.lit("-07-01")), F.lit("yyyy-MM-dd")))).otherwise(_parsed(text, "07", "15"))


def date_start(text: Column) -> Column:
    """The period's first day."""
    return _parsed(text, "01", "01")


def date_strict(text: Column) -> Column:
    """Whole dates alone."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def span_years(first: Column, last: Column) -> Column:
    """Years from first to last, a month at least."""
    return F.greatest(F.datediff(last, first) / 30.0, F.lit(1.0)) / 12
