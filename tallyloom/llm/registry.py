"""Queries of this subpackage, with the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, media, mixing, near_dedup, sharding, suffix_dedup, token_counts, token_output, toxicity
from .common import cut, table

#: A text that has a word: a character that is neither white space nor stripped off.
WORD = r"[^\s.,;:!?\"'()\[\]{}<>|*_\-#`~]"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with score and offending offsets."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, chain).where(F.col("score") >= toxicity.THRESHOLD)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits to each."""
    docs = table(spark, sf_dir, "documents")
    n = F.length("text")
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(n, F.lit(1)).cast("bigint")).cast("int")
    replacement = F.concat_ws(" ", F.lit("edited"), "source", "lang")
    edits = F.array(
        F.struct(at.alias("start"), (at + 20).alias("end"), replacement.alias("replacement")),
        F.struct((n / 2).cast("int").alias("start"), (n / 2).cast("int").alias("end"), F.lit(" inserted words").alias("replacement")),
        F.struct((n - 5).alias("start"), n.alias("end"), F.lit("").alias("replacement")),
    )
    return token_counts.count_edited(docs, edits)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot, and its shard in the first, the rebalanced and the grown map."""
    docs = table(spark, sf_dir, "documents")
    slot_map = sharding.balanced(docs)
    return sharding.assign(docs.select("doc_id"), slot_map, versions={"shard_1": 1, "shard_2": 2, "shard_3": 3})


def slot_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.slot_bytes(table(spark, sf_dir, "documents"))


def slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot, and its shard in the first map."""
    docs = table(spark, sf_dir, "documents")
    return sharding.assign(docs.select("doc_id"), sharding.SlotMap(), versions={"shard": 1})


def exact_copy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text one of lesser id has, and whether op3 has both in one class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null")
    found = cut(near_dedup.duplicates(docs).select("doc_id", F.col("kept_doc_id").alias("kept")))
    first = docs.groupBy("text").agg(F.min("doc_id").alias("first_doc_id"))
    copies = docs.where(F.col("text").rlike(WORD)).join(first, "text").where("doc_id <> first_doc_id").select("doc_id", "first_doc_id")
    kept = copies.join(found, "doc_id", "left").join(found.select(F.col("doc_id").alias("first_doc_id"), F.col("kept").alias("of")), "first_doc_id", "left")
    return kept.select("doc_id", "first_doc_id", (F.coalesce("kept", "doc_id") == F.coalesce("of", "first_doc_id")).alias("same_class"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours, among all rows, of every row whose id is divisible by 50."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), every=50)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), verify=True)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(table(spark, sf_dir, "documents"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of op8, one a row."""
    found = suffix_dedup.passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "first_doc_id", F.explode("spans").alias("s"), "removed").select("doc_id", "first_doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), "removed")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.write_blocks(table(spark, sf_dir, "documents"))


def token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, decoded from op9's blocks."""
    back = bpe.decode(token_output.read_documents(token_output.write_blocks(table(spark, sf_dir, "documents"))))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def media_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of op10's payloads."""
    return op10_media_chunks(spark, sf_dir).select("page_id", F.md5("payload").alias("digest"), "verified")


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages rebuilt from the store of their distinct chunks, and verified."""
    pages = table(spark, sf_dir, "pages")
    dictionary = media.train_dictionary(pages)
    return media.rebuild(media.manifest(pages), media.store(pages, dictionary=dictionary), dictionary=dictionary)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_token_counts, op3_near_dedup, op4_sharding, op5_mixing, op6_ann, op7_bpe, op8_suffix_dedup, op9_token_output, op10_media_chunks, slot_bytes, slot_shards, exact_copy_classes, repeated_passages, token_round_trip, media_round_trip]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": mixing.ORACLE.format(docs="documents"),
        "slot_bytes": """
            select (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % 4096)::int as slot,
                   count(*) as n_docs, sum(coalesce(strlen(text), 0))::bigint as n_bytes
            from documents group by 1""",
        "slot_shards": """
            with s as (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % 4096)::int as slot from documents)
            select doc_id, slot, (slot * 64 // 4096)::int as shard from s""",
        "exact_copy_classes": r"""
            with f as (select doc_id, text, min(doc_id) over (partition by text) as first_doc_id from documents where doc_id is not null and regexp_matches(text, '[^\s.,;:!?"''()\[\]{}<>|*_\-#`~]'))
            select doc_id, first_doc_id, true as same_class from f where doc_id <> first_doc_id""",
        "token_round_trip": "select doc_id, md5(text) as digest from documents where text is not null",
        "media_round_trip": "select page_id, md5(html) as digest, true as verified from pages where html is not null",
        "repeated_passages": r"""
            with w as (select doc_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') as ws from documents),
            g as (select doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) as h from w, lateral (select unnest(range(0, len(ws) - 49)) as i)),
            c as (select h, min(doc_id) as k from g group by h having count(distinct doc_id) > 1),
            p as (select distinct doc_id, k, i from g join c using (h)),
            n as (select *, case when i <= lag(i) over (partition by doc_id, k order by i) + 50 then 0 else 1 end as new from p),
            s as (select *, sum(new) over (partition by doc_id, k order by i rows unbounded preceding) as island from n)
            select doc_id, k as first_doc_id, min(i)::int as start_word, (max(i) + 50)::int as end_word, doc_id <> k as removed
            from s group by doc_id, k, island""",
    }
