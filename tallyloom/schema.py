"""The silver transaction model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(38, 10)

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")] + [T.StructField("page_index", T.IntegerType())])

#: Column -> type, in order.
SILVER = T.StructType(
    [
        T.StructField("account_id", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("amount", MONEY, False),
        T.StructField("booking_date", T.DateType()),
        T.StructField("value_date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("normalized_description", T.StringType(), False),
        T.StructField("reference", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("counterparty", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_index", T.IntegerType()),
        T.StructField("source_method", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("raw_source_text", T.StringType()),
        T.StructField("source_bbox", BBOX),
        T.StructField("source_page", T.IntegerType()),
        T.StructField("transaction_hash", T.StringType()),
    ]
)

SOURCE_METHODS = ("deterministic", "llm", "vision")

#: Records carry these names in the various formats; the first that is neither null nor empty counts.
CANDIDATES: dict[str, tuple[str, ...]] = {
    "description": ("description", "Description", "RmtInf", "Reference", "reference", "Memo", "memo", "Name", "CdtrNm"),
    "reference": ("Reference", "reference", "RmtInf", "transaction_id", "transactionId", "EndToEndId", "FITID"),
    "counterparty": ("Creditor", "Debtor", "CdtrNm", "Name", "payee", "counterparty"),
    "amount": ("Amount", "amount", "InstdAmt"),
    "account_id": ("AccountId", "account_id", "DbtrIBAN", "CreditorAccount"),
    "currency": ("Currency", "currency"),
    "booking_date": ("BookgDt", "booking_date", "date"),
    "value_date": ("ValDt", "value_date", "date"),
    "transaction_id": ("transaction_id", "TransactionId", "FITID", "EndToEndId"),
}


def exact_column(df: DataFrame, name: str) -> Column | None:
    """A column by its case-sensitive name; Spark alone would take ``Name`` for ``name``."""
    return df[f"`{name}`"] if name in df.columns else None


def first_filled(df: DataFrame, names: tuple[str, ...]) -> Column:
    present = [F.nullif(c.cast("string"), F.lit("")) for n in names if (c := exact_column(df, n)) is not None]
    return F.coalesce(*present) if present else F.lit(None).cast("string")
