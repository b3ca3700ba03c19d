"""Delimited text, JSON and workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..exceptions import PayloadError

SCHEMA_VERSION = 1
MAX_PAYLOAD = 50 << 20
INGEST_COLUMNS = ("transaction_hash", "source_method", "source_page", "booking_date", "description", "amount", "currency", "reference", "confidence")


def exact_text(df: DataFrame) -> list[Column]:
    """Columns with decimals and dates as plain text, so that no reader rounds them."""
    plain = (T.DecimalType, T.DateType, T.TimestampType)
    return [df[f"`{f.name}`"].cast("string").alias(f.name) if isinstance(f.dataType, plain) else df[f"`{f.name}`"] for f in df.schema]


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; the commit protocol makes it appear whole.  ``single`` for one file, of what one task can write."""
    (df.coalesce(1) if single else df).write.option("header", True).option("escape", '"').csv(path)


def summary_json(summary: DataFrame, tx: DataFrame, order: list[str]) -> DataFrame:
    """One row of JSON: summary and transactions, of what fits a row; ``write_json`` is for the rest."""
    rows = tx.select(F.struct(*order, F.struct(*exact_text(tx)).alias("__t")).alias("r")).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["__t"]).alias("transactions"))
    head = summary.select(F.struct(*exact_text(summary)).alias("summary"))
    return head.crossJoin(rows).select(F.to_json(F.struct("summary", "transactions"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.select(*exact_text(df)).write.option("ignoreNullFields", False).json(path)


def ingest_projection(tx: DataFrame) -> DataFrame:
    """The nine columns of an ingest report, '' for nulls."""
    return tx.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in INGEST_COLUMNS))


def result_json(method: Column, fmt: Column, transactions: Column, verification: Column, warnings: Column, audit_trail: Column) -> Column:
    """An ingest result as JSON of schema version 1."""
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), method.alias("source_method"), fmt.alias("source_format"), transactions.alias("transactions"), verification.alias("verification"), warnings.alias("warnings"), audit_trail.alias("audit_trail")), {"ignoreNullFields": "false"})


def paged(tx: DataFrame, order: list[str], size: int = 50_000) -> DataFrame:
    """``tx`` with ``page``: rows that follow each other in ``order``, ``size`` at most, so that a result of any length is written as several that each fit a row and a payload."""
    ranged = tx.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn("page", F.floor(F.monotonically_increasing_id() / size))


def load_result(texts: DataFrame, schema: str, text: str = "json") -> DataFrame:
    """Stored results again: version absent or 1, 50 MiB at most, and JSON, or an error."""
    parsed = F.from_json(F.col(text), f"schema_version int, source_method string, source_format string, {schema}", {"mode": "FAILFAST"})
    fault = F.when(F.octet_length(text) > MAX_PAYLOAD, "the result is too large").when(F.coalesce(F.get_json_object(text, "$.schema_version"), F.lit("1")) != str(SCHEMA_VERSION), "unsupported schema_version")
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast(texts.select(parsed.alias("p")).schema["p"].dataType)).otherwise(parsed)
    return texts.select(checked.alias("r")).select("r.*")


def rest_body(result: Column) -> Column:
    """A result for the web: with a count, without the trail and the deltas."""
    return F.to_json(F.struct(result["source_method"].alias("source_method"), result["source_format"].alias("source_format"), F.size(result["transactions"]).alias("transaction_count"), result["transactions"].alias("transactions"), result["verification"].dropFields("expected_delta", "actual_delta").alias("verification"), result["warnings"].alias("warnings")))


def write_workbook(path: str, **sheets: DataFrame) -> None:
    """Sheets of a workbook, on the driver and so for small frames; needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise PayloadError("a workbook needs openpyxl") from e
    with pd.ExcelWriter(path, engine="openpyxl") as writer:
        for name, df in sheets.items():
            df.select(*exact_text(df)).toPandas().to_excel(writer, sheet_name=name, index=False)


def to_polars(df: DataFrame, lazy: bool = False):
    """A polars frame, by Arrow; needs polars."""
    try:
        import polars
    except ImportError as e:
        raise PayloadError("polars isn't installed") from e
    out = polars.from_arrow(df.toArrow())
    return out.lazy() if lazy else out
