"""Duplicate transactions: exact, probable and shifted in time; and incremental ingestion."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import amount_key, occurrence_key, primary_hash

WINDOW_DAYS = 3
SIMILARITY = 0.9


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two normalized descriptions; 0 where one is empty."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype="float64")


def with_primary_hash(tx: DataFrame) -> DataFrame:
    return tx.withColumn("primary_hash", primary_hash(*(F.col(c) for c in ("account_id", "currency", "amount", "booking_date"))))


def member_key(index: str = "source_index") -> list:
    """Order of a group's members: by position (0 and none come first), then reference."""
    return [F.coalesce(F.nullif(F.col(index), F.lit(0)), F.lit(-1)), F.coalesce(F.col("reference"), F.lit(""))]


def exact_groups(tx: DataFrame, member: str = "source_index") -> DataFrame:
    """(primary_hash, n, members): groups of two at least with equal account, currency, amount and booking date."""
    k, r = member_key(member)
    grouped = with_primary_hash(tx).groupBy("primary_hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(k.alias("k"), r.alias("r"), F.col(member).alias("m")))).alias("sorted"))
    return grouped.where("n >= 2").select("primary_hash", "n", F.col("sorted.m").alias("members"))


def probable_pairs(tx: DataFrame, index: str = "idx", threshold: float = SIMILARITY) -> DataFrame:
    """(primary_hash, left_idx, right_idx, similarity) of transactions in one hash bucket whose descriptions differ but are alike.

    Equal descriptions are folded before pairs are made, so a bucket of n
    repeats of few texts costs the square of the texts, not of n.
    """
    base = with_primary_hash(tx).groupBy("primary_hash", "normalized_description").agg(F.min(index).alias("first"), F.max(index).alias("last"))
    a = base.select("primary_hash", F.col("normalized_description").alias("left_text"), F.col("first").alias("left_first"), F.col("last").alias("left_last"))
    b = base.select("primary_hash", F.col("normalized_description").alias("right_text"), F.col("first").alias("right_first"), F.col("last").alias("right_last"))
    # the ratio isn't symmetric: the earlier transaction's text comes first, and texts may come first either way
    pairs = a.join(b, (a["primary_hash"] == b["primary_hash"]) & (a["left_text"] != b["right_text"]) & (a["left_first"] < b["right_last"])).drop(b["primary_hash"])
    scored = pairs.withColumn("similarity", similarity("left_text", "right_text")).where(F.col("similarity") >= threshold)
    return scored.select("primary_hash", F.col("left_first").alias("left_idx"), F.col("right_last").alias("right_idx"), "similarity")


def probable_groups(tx: DataFrame, index: str = "idx", threshold: float = SIMILARITY) -> DataFrame:
    """(primary_hash, members, reason, confidence, tier): whole hash buckets in which some pair is alike."""
    best = probable_pairs(tx, index, threshold).groupBy("primary_hash").agg(F.max("similarity").alias("similarity"))
    k, r = member_key("source_index" if "source_index" in tx.columns else index)
    members = with_primary_hash(tx).groupBy("primary_hash").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), r.alias("r"), F.col(index).alias("m")))).alias("sorted"))
    reason = F.format_string("Primary hash collision with description similarity %.2f", "similarity")
    confidence = F.least(F.lit(0.99), F.col("similarity") + 0.05)
    return members.join(best, "primary_hash").select("primary_hash", F.col("sorted.m").alias("members"), reason.alias("reason"), confidence.alias("confidence"), F.lit("probable").alias("tier"))


def temporal_islands(tx: DataFrame, index: str = "idx", days: int = WINDOW_DAYS) -> DataFrame:
    """``tx`` with primary_hash, key, island and day_gap: runs within an account, currency and amount whose neighbours are at most ``days`` apart in value date and differ in primary hash."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    keyed = with_primary_hash(tx).withColumn("key", F.concat_ws("|", text("account_id"), text("currency"), amount_key(F.col("amount"))))
    w = Window.partitionBy("key").orderBy(F.coalesce("value_date", F.lit("0001-01-01").cast("date")), index)
    gap = F.datediff("value_date", F.lag("value_date").over(w))
    follows = F.coalesce((gap <= days) & (F.col("primary_hash") != F.lag("primary_hash").over(w)), F.lit(False))
    return keyed.withColumn("day_gap", gap).withColumn("__new", F.when(follows, 0).otherwise(1)).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def temporal_groups(tx: DataFrame, index: str = "idx", days: int = WINDOW_DAYS, with_similarity: bool = True) -> DataFrame:
    """(key, island, n, members, max_delta, max_similarity, reason, confidence, tier) of the islands of two at least."""
    w = Window.partitionBy("key", "island").orderBy(F.coalesce("value_date", F.lit("0001-01-01").cast("date")), index)
    islands = temporal_islands(tx, index, days).withColumn("__n", F.count("*").over(Window.partitionBy("key", "island"))).where("__n > 1")
    islands = islands.withColumn("__before", F.lag("normalized_description").over(w))
    sim = F.when(F.col("__before").isNotNull(), similarity("__before", "normalized_description")) if with_similarity else F.lit(None).cast("double")
    grouped = islands.withColumn("__sim", sim).groupBy("key", "island").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.col(index))).alias("members"),
        F.coalesce(F.datediff(F.max("value_date"), F.min("value_date")), F.lit(0)).alias("max_delta"), F.coalesce(F.max("__sim"), F.lit(0.0)).alias("max_similarity"),
    )
    reason = F.concat(F.format_string("Value date shift within %d day window", "max_delta"), F.when(F.col("max_similarity") > 0, F.format_string("; description similarity %.2f", "max_similarity")).otherwise(""))
    return grouped.withColumns({"reason": reason, "confidence": F.least(F.lit(0.95), 0.75 + F.col("max_similarity") * 0.2), "tier": F.lit("suspected")})


@dataclass(frozen=True)
class Deduplicated:
    """``unique``: rows in no group; ``exact`` and ``suspected``: the groups."""

    unique: DataFrame
    exact: DataFrame
    suspected: DataFrame


def deduplicate(tx: DataFrame, index: str = "idx", days: int = WINDOW_DAYS, threshold: float = SIMILARITY) -> Deduplicated:
    """All three kinds; time shifts are looked for among the rows of neither other kind.

    Rows of a group of equal primary hash are marked by a window, and probable
    groups are such groups too, so uniqueness needs no join with them.
    """
    size = F.count("*").over(Window.partitionBy("primary_hash"))
    rest = with_primary_hash(tx).withColumn("__n", size).where("__n = 1").drop("__n", "primary_hash")
    temporal = temporal_groups(rest, index, days)
    probable = probable_groups(tx, index, threshold)
    suspected = probable.select(F.col("primary_hash").alias("key"), "members", "reason", "confidence", "tier").unionByName(temporal.select("key", "members", "reason", "confidence", "tier"))
    islands = temporal_islands(rest, index, days)
    unique = islands.withColumn("__n", F.count("*").over(Window.partitionBy("key", "island"))).where("__n = 1").select(*tx.columns)
    return Deduplicated(unique, exact_groups(tx, index), suspected)


def with_occurrence(tx: DataFrame, batch: list[str], order: list[str]) -> DataFrame:
    return tx.withColumn("dedup_key", occurrence_key([F.col(c) for c in batch], F.col("transaction_hash"), [F.col(c) for c in order]))


def new_rows(batch: DataFrame, seen: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of ``batch`` whose hash:n is not in ``seen`` (dedup_key)."""
    return with_occurrence(batch, by or [], order or ["source_index"]).join(seen.select("dedup_key"), "dedup_key", "left_anti")


def skipped_rows(batch: DataFrame, seen: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    return with_occurrence(batch, by or [], order or ["source_index"]).join(seen.select("dedup_key"), "dedup_key", "left_semi")


def first_file_wins(tx: DataFrame, file: str = "_file", order: list[str] | None = None) -> DataFrame:
    """``tx`` with dedup_key and is_new: what a scan file after file would keep, in one pass."""
    keyed = with_occurrence(tx, [file], order or ["source_index"])
    return keyed.withColumn("is_new", F.row_number().over(Window.partitionBy("dedup_key").orderBy(file)) == 1)


def union_seen(seen: DataFrame, batch: DataFrame) -> DataFrame:
    return seen.select("dedup_key").unionByName(batch.select("dedup_key")).distinct()


def merge_strips(tx: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row of each hash, the first in order: overlapping page strips show rows twice."""
    w = Window.partitionBy(*by, "transaction_hash").orderBy(*order)
    return tx.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
