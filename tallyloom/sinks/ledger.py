"""Plain-text ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amount_key, ledger_text, quoted_text

ACCOUNT, CONTRA, CURRENCY = "Assets:Bank:Checking", "Expenses:Uncategorized", "EUR"


def contra_account(category: Column, default: str = CONTRA) -> Column:
    return F.when(F.coalesce(category, F.lit("")) != "", F.concat(F.lit("Expenses:"), F.translate(category, " /", "::"))).otherwise(F.lit(default))


def _filled(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _date() -> Column:
    return F.coalesce(F.col("booking_date").cast("string"), F.lit("1970-01-01"))


def hledger_entry(account: str = ACCOUNT, contra: str = CONTRA, currency: str = CURRENCY) -> Column:
    """A transaction's four lines, the last of them empty."""
    c = F.col
    return F.concat_ws(
        "\n", F.concat(_date(), F.lit(" "), ledger_text(_filled(c("description"), "Unknown"))),
        F.concat(F.lit(f"    {account}    "), _filled(c("currency"), currency), F.lit(" "), amount_key(c("amount"))),
        F.concat(F.lit("    "), contra_account(c("category"), contra)), F.lit(""),
    )


def beancount_entry(account: str = ACCOUNT, contra: str = CONTRA, currency: str = CURRENCY) -> Column:
    c = F.col
    unit = _filled(c("currency"), currency)
    return F.concat_ws(
        "\n", F.concat(_date(), F.lit(' txn "'), quoted_text(F.coalesce(c("counterparty"), F.lit(""))), F.lit('" "'), quoted_text(_filled(c("description"), "Unknown")), F.lit('"')),
        F.concat(F.lit(f"  {account}  "), amount_key(c("amount")), F.lit(" "), unit), F.concat(F.lit("  "), contra_account(c("category"), contra), F.lit("  "), amount_key(-c("amount")), F.lit(" "), unit), F.lit(""),
    )


def write_journal(tx: DataFrame, path: str, order: list[str], entry: Column | None = None) -> None:
    """Journal files in order; a reader that takes them by name reads one journal."""
    tx.orderBy(*order).select((hledger_entry() if entry is None else entry).alias("value")).write.text(path)


def journal(tx: DataFrame, order: list[str], entry: Column | None = None) -> DataFrame:
    """The whole journal as one text: for what fits one row; ``write_journal`` is for the rest."""
    rows = tx.select(F.struct(*order, (hledger_entry() if entry is None else entry).alias("__entry")).alias("r"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["__entry"]), "\n").alias("journal"))
