"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on;
``run`` writes each stage's result as Parquet into the folder that the cluster
shares and reads it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, mixing, near_dedup, suffix_dedup, toxicity
from tallyloom.llm.common import shared_dir, table


#: Rows of texts at a time, where they are read and where they go to Python; as many as Spark has by default are some 20 MB, held several times by each task.
BATCH_ROWS = 1000
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to ``BATCH_ROWS``; what a stage returns is run after it, so this stays set."""
    for name in _BATCHES:
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have a toxic token."""
    bound_batches(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bound_batches(spark)
    return near_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that an earlier document has."""
    bound_batches(spark)
    return suffix_dedup.remove(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and dropped towards the sources' target weights, shuffled."""
    bound_batches(spark)
    return mixing.replicate(docs).drop("copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, verified by decoding."""
    bound_batches(spark)
    return bpe.encode(docs, verify=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL has no conditional random field, so the rows are tested against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name) for name in _BATCHES}
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        for name, rows in before.items():
            spark.conf.set(name, rows)
    return docs
