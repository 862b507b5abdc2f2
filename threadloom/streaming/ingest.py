"""Streaming intake: messages are merged into the message table; a day is final once the watermark has passed it."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from threadloom.functions.clock import day_bucket
from threadloom.sources.tables import MESSAGE_KEY, message_rows, upsert


def first_seen(messages: DataFrame, delay: str = "1 day", version: Sequence[str] = ()) -> DataFrame:
    """Messages without repeats inside the watermark delay.

    For counts the key is enough. Ahead of a table that keeps the newest version name the columns an edit changes, such as
    ``["text"]``: then only equal versions are dropped and an edited message goes on.
    """
    return messages.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["channel", "ts_us", *version])


def final_days(messages: DataFrame, delay: str | None = "1 day", tz: str = "UTC") -> DataFrame:
    """Message counts per channel and day of the zone ``tz``; a day appears once it can no longer change.

    Pass ``delay=None`` for a stream that has a watermark already, such as the result of :func:`first_seen`; its days are UTC days.
    In another zone the windows, and the watermark with them, run on the local clock.
    """
    if tz != "UTC" and delay is None:
        raise ValueError("days of another zone need a watermark of their own: pass delay")
    if tz == "UTC":
        timed, clock = (messages.withWatermark("event_time", delay) if delay else messages), "event_time"
    else:
        timed, clock = messages.withColumn("_local", F.from_utc_timestamp("event_time", tz)).withWatermark("_local", delay), "_local"
    # All messages of a window lie in one local day, which the first of them names, whatever the zone of the session.
    return timed.groupBy("channel", F.window(clock, "1 day").alias("_w")).agg(
        F.count(F.lit(1)).alias("message_count"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")).select(
        "channel", day_bucket("first_us", tz).alias("day"), "message_count", "first_us", "last_us")


def message_sink(messages: DataFrame, path: str, checkpoint: str, tz: str = "UTC") -> DataStreamWriter:
    """Upsert every micro-batch into the message table. The merge is idempotent, so a replayed batch changes nothing.

    The version of a row is the time its batch was taken in, in microseconds, which goes on growing when a stream starts anew and can
    be compared with batch loads.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = message_rows(batch, F.lit(time.time_ns() // 1000).cast("long"), tz)
        upsert(batch.sparkSession, path, rows, MESSAGE_KEY, ["fetched_at", "msg_id"], "day_bucket")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
