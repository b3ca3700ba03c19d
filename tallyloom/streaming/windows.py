"""Windows in event time, over batch rows and streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """A stream with its watermark, and what gives times back in the type of ``ts``; batch rows stay as they are.

    Watermarks take instants only.  Times without a zone become the instants that
    have their readings in UTC, so the session's zone and its changes of the clock
    move no event to another window.  Spark's watermark starts at 1970: a stream's
    events whose window ends before that come too late.
    """
    if not events.isStreaming:
        return events, lambda c: c
    if events.schema["ts"].dataType.typeName() != "timestamp_ntz":
        return events.withWatermark("ts", late), lambda c: c
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    since = F.col("ts") - epoch
    seconds = (F.extract(F.lit("DAY"), since).cast("long") * 86400 + F.extract(F.lit("HOUR"), since) * 3600 + F.extract(F.lit("MINUTE"), since) * 60).cast("long")
    micros = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")
    back = lambda c: epoch + F.make_dt_interval(secs=(F.unix_micros(c).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    return events.withColumn("ts", F.timestamp_micros(micros)).withWatermark("ts", late), back


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", keys: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """(keys, window_start, window_end, n, total): counts and sums by windows of ``ts``; ``slide`` makes them overlap."""
    marked, back = _marked(events, late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = marked.groupBy(window.alias("w"), *(keys or [])).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(38,4)").alias("total"))
    return out.select(*(keys or []), back(F.col("w.start")).alias("window_start"), back(F.col("w.end")).alias("window_end"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's events closer than ``gap``."""
    marked, back = _marked(events, late)
    out = marked.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, back(F.col("w.start")).alias("session_start"), back(F.col("w.end")).alias("session_end"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark's time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
