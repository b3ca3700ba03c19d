"""Shared pieces: table reads, the cut of lineage, and word hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CACHE = 250_000
_STRIP = ".,;:!?\"'()[]{}<>|*_-#`~"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many tasks as there are cores, where it is read by fewer: small files would keep most of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, of ``spark.checkpoint.dir``; one of our own only where the session names none and runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df``, written to the shared folder and read again: later steps neither repeat it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage, for operators of many queries.

    Every stage, scan and broadcast join leaves arrays of 4 MB with the driver.
    Spark frees broadcast tables and shuffle files of ended queries only when
    they are collected, and until then the heap grows to its bound.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in what is executed within: for rows that hold several texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of least hash of ``key``.

    Rows whose hash can't be among them are dropped where they are read, so
    each partition sends the driver a few candidates and not ``most`` of them.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = min(1.0, (3 * most + 100) / max(df.count(), 1))
    return df.where(place < int(share * (1 << 30))).orderBy(place, *df.columns).limit(most)


class WordHashes(dict):
    """Word -> 64-bit hash of its lower-cased form without outer punctuation; 0 if nothing is left."""

    def __missing__(self, word: str) -> int:
        core = word.strip(_STRIP).lower()
        value = (xxhash.xxh64_intdigest(core.encode("utf-8", "surrogatepass")) or 1) if core else 0
        if len(self) > _CACHE:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class RawHashes(WordHashes):
    """Word -> 64-bit hash of the word as it is."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole, if there are fewer."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for j in range(k):
        out = mix(out + hashes[j : len(hashes) - k + 1 + j] + np.uint64(j + 1))
    return out
