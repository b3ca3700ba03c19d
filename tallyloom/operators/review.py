"""Review of extracted rows: what to look at, edits, and their trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalize import with_identity


def needs_review(tx: DataFrame, below: float, status: str | None = None) -> DataFrame:
    """Rows of low confidence; all rows where the statement isn't verified.  A row without confidence isn't low."""
    if status is not None and status != "verified":
        return tx
    return tx.where(F.col("confidence") < below)


def apply_edits(tx: DataFrame, edits: DataFrame, key: str = "source_index") -> tuple[DataFrame, DataFrame]:
    """(rows after the edits, their trail).

    ``edits`` has (key, action, description, amount); actions are accept, skip,
    edit and delete, and of an edit's fields null ones stay.  A row keeps all
    its other columns, its page included.
    """
    e = edits.select(F.col(key).alias("__key"), "action", F.col("description").alias("__description"), F.col("amount").cast("decimal(38,10)").alias("__amount"))
    joined = tx.join(e, tx[key] == e["__key"], "left").withColumn("__before", F.col("transaction_hash"))
    edited = F.coalesce(F.col("action") == "edit", F.lit(False))
    changed = joined.withColumns({"description": F.when(edited, F.coalesce("__description", "description")).otherwise(F.col("description")), "amount": F.when(edited, F.coalesce("__amount", "amount")).otherwise(F.col("amount"))})
    again = with_identity(changed)
    after = again.withColumn("transaction_hash", F.when(edited, F.col("transaction_hash")).otherwise(F.col("__before")))
    trail = after.where("action is not null").select(F.col(key).alias("row_index"), "action", F.when(edited, F.col("__before")).alias("before_hash"), F.when(edited, F.col("transaction_hash")).alias("after_hash"), F.when(F.col("action") == "delete", F.col("__before")).alias("deleted_hash"))
    return after.where(F.coalesce(F.col("action") != "delete", F.lit(True))).select(*tx.columns), trail
