"""Hashes by which transactions are told apart."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .amounts import amount_key


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def primary_hash(account_id: Column, currency: Column, amount: Column, booking_date: Column) -> Column:
    """SHA-256 of account, currency, amount and booking date."""
    return F.sha2(F.concat_ws("|", _text(account_id), _text(currency), amount_key(amount), _text(booking_date)), 256)


def transaction_hash(booking_date: Column, value_date: Column, normalized: Column, amount: Column, transaction_id: Column, reference: Column, account_id: Column | None = None, currency: Column | None = None) -> Column:
    """MD5 of date, normalized description, amount and id or reference.

    Without account and currency, transactions of different accounts can
    collide; giving them scopes the hash to the account.
    """
    named = F.coalesce(F.nullif(transaction_id, F.lit("")), F.nullif(reference, F.lit("")), F.lit(""))
    parts = [_text(F.coalesce(booking_date, value_date)), F.coalesce(normalized, F.lit("")), amount_key(amount), named]
    parts += [_text(c) for c in (account_id, currency) if c is not None]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def occurrence_key(batch: list[Column], digest: Column, order: list[Column]) -> Column:
    """hash:n, where n counts the hash's earlier occurrences in its batch, so that equal transactions of one file stay apart and a second run finds them again."""
    n = F.row_number().over(Window.partitionBy(*batch, digest).orderBy(*order)) - 1
    return F.concat_ws(":", digest, n.cast("string"))
