"""Masks over whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MASK, mask

KEYWORDS = ("address", "iban", "account", "name", "bic")
#: Party columns whose names have none of the words.
PARTIES = ("DbtrNm", "CdtrNm", "InitgPty", "Debtor", "Creditor")
PAYMENT_COLUMNS = ("DbtrNm", "CdtrNm", "DbtrIBAN", "InitgPty")
ADDRESS_COLUMNS = ("DebtorAddress", "CreditorAddress")


def private_columns(df: DataFrame, parties: bool = False) -> list[str]:
    return [c for c in df.columns if any(k in c.lower() for k in KEYWORDS) or (parties and c in PARTIES)]


def mask_by_name(df: DataFrame, parties: bool = False) -> DataFrame:
    """The mask in every row of the columns whose names tell of persons."""
    return df.withColumns({c: F.lit(MASK) for c in private_columns(df, parties)}) if private_columns(df, parties) else df


def mask_filled(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The mask in place of the filled values of these columns, as far as they are there."""
    own = {c: mask(F.col(c)) for c in columns if c in df.columns}
    return df.withColumns(own) if own else df
