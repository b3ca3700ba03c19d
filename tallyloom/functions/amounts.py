"""Amounts: exact decimals from text in several conventions, and their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ten decimals are more than any currency has; a text with more is refused, not rounded.
MONEY_SQL = "decimal(38,10)"
_TOO_FINE = r"\.\d{10}\d*[1-9]"


def plain_amount(text: Column, money: str = MONEY_SQL) -> Column:
    """A decimal from ISO notation; null if it isn't one (NaN and infinities aren't)."""
    s = F.trim(text.cast("string"))
    return F.when(~s.rlike(_TOO_FINE), s.try_cast(money))


def locale_amount(text: Column, money: str = MONEY_SQL) -> Column:
    """A decimal from local notation; null where it makes none, 0 from blank text.

    Where both separators occur the right one is the decimal point; a comma
    alone always is.  Spaces, also hard ones, don't count.
    """
    s = F.regexp_replace(text.cast("string"), "[\\s  ']", "")
    last_comma, last_dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
    both = (last_comma > 0) & (last_dot > 0)
    european = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.when(both & (last_comma < last_dot), european).when(both, F.replace(s, F.lit(","), F.lit(""))).when(last_comma > 0, F.replace(s, F.lit(","), F.lit("."))).otherwise(s)
    return F.when(s == "", F.lit(0).cast(money)).when(~plain.rlike(_TOO_FINE), plain.try_cast(money))


def required(value: Column, text: Column, what: str) -> Column:
    """``value``, or an error that names the text where it is null."""
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"{what}: not an amount: "), F.coalesce(text.cast("string"), F.lit("nothing")))).cast(MONEY_SQL))


def unreadable(value: Column, text: Column, what: str) -> Column:
    """Why a row can't be used, where it has a text and no value; null elsewhere."""
    raw = F.nullif(F.trim(text.cast("string")), F.lit(""))
    return F.when(value.isNull() & raw.isNotNull(), F.concat(F.lit(f"{what}: not an amount: "), raw))


def signed_by_indicator(amount: Column, indicator: Column, debit: str = "DBIT") -> Column:
    """Negative for the debit indicator, as it is for anything else."""
    return F.when(indicator == debit, -amount).otherwise(amount)


def signed_difference(credit: Column, debit: Column) -> Column:
    """Credit less debit, either of which may be missing."""
    return F.coalesce(credit, F.lit(0)) - F.coalesce(debit, F.lit(0))


def amount_key(amount: Column) -> Column:
    """Plain notation without trailing zeros, the same for all scales of a number."""
    s = amount.cast("string")
    trimmed = F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))
    return F.when(F.instr(s, ".") > 0, F.when(trimmed.isin("", "-", "-0"), "0").otherwise(trimmed)).otherwise(s)
