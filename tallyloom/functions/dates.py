"""Dates from the notations that statements use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Notation of the first ten characters -> pattern; the shape is checked, as Spark alone also takes single digits.
_SHAPES = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))


def flexible_date(text: Column) -> Column:
    """A date from ISO, compact, day-first or slashed notation, cut to ten characters (so no time zone applies); null if it is none of them."""
    s = F.substring(F.trim(text.cast("string")), 1, 10)
    found = None
    for shape, pattern in _SHAPES:
        parsed = F.to_date(F.try_to_timestamp(F.when(s.rlike(shape), s), F.lit(pattern)))
        found = parsed if found is None else F.coalesce(found, parsed)
    return found


def iso_date(text: Column) -> Column:
    """A date from yyyy-MM-dd alone."""
    return F.to_date(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), F.lit("yyyy-MM-dd")))


def short_year_date(text: Column) -> Column:
    """A date from yyMMdd, in this century."""
    return F.to_date(F.try_to_timestamp(F.when(text.rlike(r"^\d{6}$"), F.concat(F.lit("20"), text)), F.lit("yyyyMMdd")))
