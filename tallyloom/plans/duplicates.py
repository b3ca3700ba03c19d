"""Hashes, duplicates and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import COARSE_SQL, TX_SQL, load, transactions
from ..functions import amount_key as key_of
from ..functions import normalize_description as normal_form
from ..functions import primary_hash as hash_of
from ..functions import transaction_hash as tx_hash_of
from ..operators import dedup


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir, coarse=True)
    return tx.withColumns({"source_index": F.col("idx"), "normalized_description": normal_form(F.col("description"))})


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash for many rows: of account, amount and month alone."""
    tx = transactions(spark, sf_dir, coarse=True)
    return tx.withColumn("transaction_hash", F.md5(F.concat_ws("|", "account_id", "currency", key_of(F.col("amount")), F.date_format("booking_date", "yyyy-MM")).cast("binary")))


def amount_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("idx", key_of((F.col("amount") * F.when(F.col("idx") % 5 == 0, 100).otherwise(1)).cast("decimal(38,10)")).alias("amount_key"))


def primary_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("idx", hash_of(*(F.col(c) for c in ("account_id", "currency", "amount", "booking_date"))).alias("primary_hash"))


def transaction_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    return tx.select("idx", tx_hash_of(F.col("booking_date"), F.col("value_date"), normal_form(F.col("description")), F.col("amount"), F.lit(None).cast("string"), F.col("reference")).alias("transaction_hash"))


def normalize_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", normal_form(F.col("text")).alias("normalized"))


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.exact_groups(_coarse(spark, sf_dir), "idx")
    return out.select("primary_hash", "n", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def temporal_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.temporal_islands(_coarse(spark, sf_dir)).select("idx", "key", "day_gap", F.col("island").cast("bigint").alias("island"))


def temporal_match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.temporal_groups(_coarse(spark, sf_dir), with_similarity=False)
    return out.select("key", F.col("island").cast("bigint").alias("island"), "n", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "max_delta", "reason")


def probable_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.probable_pairs(_coarse(spark, sf_dir), threshold=0.5)


def suspected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(_coarse(spark, sf_dir)).suspected


def dedup_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(_coarse(spark, sf_dir)).unique.select("idx")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tx = _hashed(spark, sf_dir)
    return tx.where("file < 2"), dedup.with_occurrence(tx.where("file >= 2"), [], ["idx"])


def dedupe_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, seen = _split(spark, sf_dir)
    return dedup.new_rows(batch, seen, order=["idx"]).select("idx", "dedup_key")


def dedupe_skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, seen = _split(spark, sf_dir)
    return dedup.skipped_rows(batch, seen, order=["idx"]).select("idx", "dedup_key")


def seen_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, seen = _split(spark, sf_dir)
    return dedup.union_seen(seen, dedup.with_occurrence(batch, [], ["idx"]))


def scan_first_file_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_file_wins(_hashed(spark, sf_dir), "file", ["idx"]).select("idx", "file", "dedup_key", "is_new")


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.first_file_wins(_hashed(spark, sf_dir), "file", ["idx"])
    return rows.agg(F.count_distinct("file").alias("file_count"), F.count(F.when(F.col("is_new"), 1)).alias("total_unique"), F.count(F.when(~F.col("is_new"), 1)).alias("total_skipped"))


def strip_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.merge_strips(_hashed(spark, sf_dir), ["account_id"], ["file", "idx"]).select("idx", "account_id", "file")


def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.normalize import with_source_index

    return with_source_index(transactions(spark, sf_dir), ["file"], ["booking_date", "idx"]).select("idx", "file", "source_index")


_KEY = "case when instr(amount::varchar, '.') > 0 then rtrim(rtrim(amount::varchar, '0'), '.') else amount::varchar end"
_N = """trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\b\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}\\b', ' ', 'g'), '\\b\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}}\\b', ' ', 'g'), '\\b\\d{{1,2}}[-/]\\d{{1,2}}\\b', ' ', 'g'), '\\b\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?\\b', ' ', 'g'),
  '\\s+', ' ', 'g'))), '\\b[a-z0-9]*\\d[a-z0-9]*\\b', ' ', 'g'), '[^a-z ]+', ' ', 'g'), '\\s+', ' ', 'g'))"""
_PH = f", h as (select *, {_KEY} as amount_key, sha256(account_id || '|' || currency || '|' || {_KEY} || '|' || booking_date::varchar) as primary_hash from tx)"
_ISLANDS = _PH + """, g as (select *, account_id || '|' || currency || '|' || amount_key as key from h),
  l as (select *, date_diff('day', lag(value_date) over w, value_date) as day_gap, lag(primary_hash) over w as before from g window w as (partition by account_id, currency, amount_key order by value_date, idx)),
  i as (select *, sum(case when day_gap <= 3 and primary_hash <> before then 0 else 1 end) over (partition by key order by value_date, idx rows unbounded preceding)::bigint as island from l)"""
_KEYED = COARSE_SQL + f", hh as (select *, md5(account_id || '|' || currency || '|' || {_KEY} || '|' || strftime(booking_date, '%Y-%m')) as h from tx)"
_BATCHES = _KEYED + """, b as (select idx, h || ':' || (row_number() over (partition by h order by idx) - 1) as dedup_key from hh where file < 2),
  s as (select h || ':' || (row_number() over (partition by h order by idx) - 1) as dedup_key from hh where file >= 2)"""
_FILES = _KEYED + ", k as (select *, h || ':' || (row_number() over (partition by file, h order by idx) - 1) as dedup_key from hh), f as (select *, row_number() over (partition by dedup_key order by file) = 1 as is_new from k)"

SQL = {
    "amount_key": TX_SQL + ", a as (select idx, (amount * case when idx % 5 = 0 then 100 else 1 end)::decimal(38,10)::varchar as amount from tx) select idx, " + _KEY + " as amount_key from a",
    "primary_hash": TX_SQL + _PH + " select idx, primary_hash from h",
    "transaction_hash": TX_SQL + f", n as (select *, {_N.format(c='description')} as nd from tx) select idx, md5(booking_date::varchar || '|' || nd || '|' || {_KEY} || '|' || reference) as transaction_hash from n",
    "normalize_description": f"select doc_id, {_N.format(c='text')} as normalized from documents",
    "exact_duplicate_groups": COARSE_SQL + _PH + " select primary_hash, count(*) as n, string_agg(idx::varchar, ',' order by case when idx = 0 then -1 else idx end, reference) as members from h group by 1 having count(*) >= 2",
    "temporal_islands": COARSE_SQL + _ISLANDS + " select idx, key, day_gap::int as day_gap, island from i",
    "temporal_match_groups": COARSE_SQL + _ISLANDS + " select key, island, count(*) as n, string_agg(idx::varchar, ',' order by idx) as members, date_diff('day', min(value_date), max(value_date))::int as max_delta, 'Value date shift within ' || date_diff('day', min(value_date), max(value_date)) || ' day window' as reason from i group by 1, 2 having count(*) > 1",
    "dedup_unique": COARSE_SQL.rstrip().rstrip(")") + """), tx0 as (select * from tx)""" + _PH.replace("from tx)", "from tx0), h2 as (select * from h qualify count(*) over (partition by primary_hash) = 1)") + _ISLANDS.removeprefix(_PH).replace("from h)", "from h2)") + " select idx from i qualify count(*) over (partition by key, island) = 1",
    "dedupe_new_rows": _BATCHES + " select idx, dedup_key from b where dedup_key not in (select dedup_key from s)",
    "dedupe_skipped_rows": _BATCHES + " select idx, dedup_key from b where dedup_key in (select dedup_key from s)",
    "seen_union": _BATCHES + " select dedup_key from s union select dedup_key from b",
    "scan_first_file_wins": _FILES + " select idx, file, dedup_key, is_new from f",
    "scan_totals": _FILES + " select count(distinct file) as file_count, count(*) filter (is_new) as total_unique, count(*) filter (not is_new) as total_skipped from f",
    "strip_merge": _KEYED + " select idx, account_id, file from hh qualify row_number() over (partition by account_id, h order by file, idx) = 1",
    "source_index": TX_SQL + " select idx, file, (row_number() over (partition by file order by booking_date, idx) - 1)::int as source_index from tx",
}

QUERIES = {f.__name__: f for f in (amount_key, primary_hash, transaction_hash, normalize_description, exact_duplicate_groups, temporal_islands, temporal_match_groups, probable_match_pairs, suspected_groups, dedup_unique, dedupe_new_rows, dedupe_skipped_rows, seen_union, scan_first_file_wins, scan_totals, strip_merge, source_index)}
