"""Records of any format into the silver model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flexible_date, normalize_description, transaction_hash
from ..functions.amounts import MONEY_SQL, plain_amount
from ..schema import CANDIDATES, SILVER, exact_column, first_filled

REJECT = "_reject"


def with_source_index(df: DataFrame, by: list[str], order: list[str | Column], name: str = "source_index") -> DataFrame:
    """0-based positions within each source, where the column is missing or null."""
    n = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int")
    return df.withColumn(name, F.coalesce(F.col(name), n) if name in df.columns else n)


def normalize(records: DataFrame, source: str | None = None, strict: bool = True, account_scoped: bool = False) -> DataFrame:
    """The silver columns, then any column of ``records`` whose name begins with an underscore.

    ``strict`` raises where an amount is missing or unreadable; otherwise such
    rows stay, with a null amount and the reason in ``_reject``, for
    ``split_rejects`` to part.
    """
    text = {k: first_filled(records, names) for k, names in CANDIDATES.items()}
    amount = plain_amount(text["amount"])
    missing = F.when(text["amount"].isNull(), F.lit("amount is missing")).otherwise(F.concat(F.lit("amount is not a number: "), text["amount"]))
    if strict:
        amount = F.coalesce(amount, F.raise_error(missing).cast(MONEY_SQL))
    own = lambda n, kind: c.cast(kind) if (c := exact_column(records, n)) is not None else F.lit(None).cast(kind)
    dates = {k: flexible_date(text[k]) for k in ("booking_date", "value_date")}
    normalized = normalize_description(text["description"])
    currency = F.upper(text["currency"])
    digest = transaction_hash(dates["booking_date"], dates["value_date"], normalized, amount, text["transaction_id"], text["reference"], *((text["account_id"], currency) if account_scoped else ()))
    values = text | dates | {
        "amount": amount, "currency": currency, "normalized_description": normalized, "transaction_hash": digest,
        "source": F.lit(source) if source is not None else own("source", "string"), "source_method": F.coalesce(own("source_method", "string"), F.lit("deterministic")),
    }
    columns = [(values[f.name] if f.name in values else own(f.name, f.dataType)).alias(f.name) for f in SILVER]
    rest = [records[f"`{c}`"] for c in records.columns if c.startswith("_") and c != REJECT]
    extra = [] if strict else [F.when(amount.isNull(), missing).alias(REJECT)]
    return records.select(*columns, *rest, *extra)


def split_rejects(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reason)."""
    return normalized.where(F.col(REJECT).isNull()).drop(REJECT), normalized.where(F.col(REJECT).isNotNull())


def with_identity(tx: DataFrame, account_scoped: bool = False) -> DataFrame:
    """``tx`` with description and hash made again, as after an edit."""
    out = tx.withColumn("normalized_description", normalize_description(F.col("description")))
    scope = ("account_id", "currency") if account_scoped else ()
    return out.withColumn("transaction_hash", transaction_hash(*(F.col(c) for c in ("booking_date", "value_date", "normalized_description", "amount", "transaction_id", "reference", *scope))))
