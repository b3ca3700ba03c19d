"""Statement files as streams, and idempotent ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.dedup import with_occurrence
from ..sources import camt, pain001


def _documents(spark: SparkSession, folder: str, row_tag: str, schema: str, per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").option("mode", "FAILFAST").schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).withColumn("_file", F.col("_metadata.file_path"))


def camt_stream(spark: SparkSession, folder: str, redact_pii: bool = False, statement_currency: bool = True, per_trigger: int | None = None) -> DataFrame:
    """Transactions of the CAMT files that come into a folder: the same rows as the batch reader's, but an entry without amount or currency raises."""
    docs = _documents(spark, folder, "BkToCstmrStmt", camt.DOCUMENT, per_trigger)
    return camt.transactions(docs.select("_file", F.posexplode("Stmt").alias("stmt_index", "stmt")), redact_pii, statement_currency, incomplete="raise")


def pain_stream(spark: SparkSession, folder: str, redact_pii: bool = False, per_trigger: int | None = None) -> DataFrame:
    """Payments of the PAIN files that come into a folder."""
    return pain001.payments(_documents(spark, folder, "CstmrCdtTrfInitn", pain001.DOCUMENT, per_trigger), redact_pii)


def to_csv(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows appended as CSV of a fixed header, exactly once; ends with what is there now."""
    return stream.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SeenKeys:
    """Keys of ingested rows in a table that only grows.

    Exact idempotence forgets nothing, so no watermark fits; a table of keys
    costs disk instead of state-store memory.  Each batch writes its keys into
    a folder of its own, so a repeated batch replaces what it had written, and
    isn't held against itself.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def frame(self, but_batch: int | None = None) -> DataFrame:
        schema = "dedup_key string, batch long"
        try:
            keys = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException:  # nothing is written yet
            keys = self.spark.createDataFrame([], schema)
        return keys.select("dedup_key") if but_batch is None else keys.where(F.col("batch") != but_batch).select("dedup_key")

    def add(self, rows: DataFrame, batch: int) -> None:
        rows.select("dedup_key").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def deduplicated(stream: DataFrame, seen: SeenKeys, sink: Callable[[DataFrame, int], None], by: list[str], order: list[str], checkpoint: str) -> DataStreamWriter:
    """A writer that hands ``sink`` each batch's new rows (with dedup_key) and then marks them as seen.

    ``sink`` must write under the batch's number, as a batch may come again.
    """

    def handle(batch: DataFrame, number: int) -> None:
        keyed = with_occurrence(batch, by, order)
        fresh = keyed.join(seen.frame(number), "dedup_key", "left_anti").dropDuplicates(["dedup_key"]).persist()
        try:
            sink(fresh, number)
            seen.add(fresh, number)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
