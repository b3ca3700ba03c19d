"""Streaming plans; each stream runs to its end into a table and is held against SQL over the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import load
from ..streaming import windows


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; where the session names none, one of this machine's, if that is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows a stream gives for what is there now, written to the shared folder."""
    folder = shared_folder(spark)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(load(spark, sf_dir, "events").schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and kinds, from a stream that keeps its keys."""
    return drain(spark, event_stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


def stream_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir)
    return drain(spark, e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.col("value").cast("decimal(18,4)").alias("value")).where("k is not null"))


def closed(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The stream and one row of a far later day: the watermark follows it, and so every window before it ends."""
    folder = shared_folder(spark)
    last = spark.range(1).select(*(F.lit("2200-01-01").cast("timestamp").cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))
    last.write.parquet(folder)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(spark, windows.tumbling(closed(spark, event_stream(spark, sf_dir)), "1 hour", keys=["event_type"]))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(spark, windows.tumbling(closed(spark, event_stream(spark, sf_dir)), "2 hours", slide="1 hour"))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(spark, windows.sessions(closed(spark, event_stream(spark, sf_dir))))


SQL = {
    "stream_dedupe": "select distinct user_id, event_type from events",
    "stream_projection": "select event_id, (props->>'$.k')::int as k, value::decimal(18,4) as value from events where props->>'$.k' is not null",
    "stream_tumbling": "select event_type, time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, count(*) as n, sum(value::decimal(18,4))::decimal(38,4) as total from events group by 1, 2, 3",
    "stream_sliding": "with w as (select time_bucket(interval '1 hour', ts) - to_hours(k) as window_start, value from events, (values (0), (1)) as t(k)) select window_start, window_start + interval '2 hours' as window_end, count(*) as n, sum(value::decimal(18,4))::decimal(38,4) as total from w group by 1, 2",
    "stream_session": """with l as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 0 else 1 end as new from events),
        s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from l)
        select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, s""",
}

QUERIES = {f.__name__: f for f in (stream_dedupe, stream_projection, stream_tumbling, stream_sliding, stream_session)}
