"""Direct queries on message and channel tables; each returns a lazy table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.clock import DAY_US, local_day
from threadloom.functions.predicates import channel_type, mentions_user

SEARCH_LIMIT = 50
HISTORY_LIMIT = 100
ORDER = ("ts_us", "msg_id")


def search(messages: DataFrame, terms: Sequence[str], user: str | None = None, channel: str | None = None,
           from_date: str | None = None, to_date: str | None = None, limit: int | None = SEARCH_LIMIT, tz: str = "UTC") -> DataFrame:
    """Messages that hold every term, letter case aside, oldest first. Days count only when both are given."""
    hit: Column = F.lit(True)
    for term in terms:
        hit = hit & F.lower("text").contains(term.lower())
    if user:
        hit = hit & (F.col("user_id") == user)
    if channel:
        hit = hit & (F.col("channel") == channel)
    if from_date and to_date:
        hit = hit & local_day("ts_us", tz).between(F.lit(from_date).cast("date"), F.lit(to_date).cast("date"))
        first, last = (int((date.fromisoformat(d) - date(1970, 1, 1)).days) * DAY_US for d in (from_date, to_date))
        messages = _days_around(messages, first, last)
    found = messages.filter(hit).orderBy(*ORDER)
    return found.limit(limit) if limit else found


def _days_around(messages: DataFrame, start_us: int, end_us: int) -> DataFrame:
    if "day_bucket" not in messages.columns:
        return messages
    day = lambda us, more: str(date(1970, 1, 1) + timedelta(days=us // DAY_US + more))
    return messages.filter(F.col("day_bucket").between(day(start_us, -1), day(end_us, 1)))


def read_range(messages: DataFrame, channel: str | None, start_us: int, end_us: int, user: str | None = None) -> DataFrame:
    """Messages of a channel in a closed range of time.

    A stored table has ``day_bucket``, its partition column: the range of days, a day wider on both sides for any zone, then prunes
    the folders that are read.
    """
    rows = _days_around(messages, start_us, end_us).filter(F.col("ts_us").between(start_us, end_us))
    if channel:
        rows = rows.filter(F.col("channel") == channel)
    return rows.filter(F.col("user_id") == user) if user else rows


def thread(messages: DataFrame, channel: str, thread_us: int) -> DataFrame:
    """Parent and replies of one thread."""
    return messages.filter((F.col("channel") == channel) & (F.coalesce("thread_us", "ts_us") == thread_us))


def search_mentions(messages: DataFrame, user: str, start_us: int, end_us: int) -> DataFrame:
    return read_range(messages, None, start_us, end_us).filter(mentions_user(user))


def get_message(messages: DataFrame, channel: str, ts_us: int) -> DataFrame:
    """One message or an empty table."""
    return messages.filter((F.col("channel") == channel) & (F.col("ts_us") == ts_us))


def history(messages: DataFrame, people: DataFrame, channel: str, start_us: int, end_us: int, limit: int = HISTORY_LIMIT) -> DataFrame:
    """First messages of a channel in a range, with user objects."""
    rows = read_range(messages, channel, start_us, end_us).orderBy(*ORDER).limit(limit)
    return with_user_objects(rows, people)


def with_user_objects(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Add ``user`` as ``(id, name)``: null without a user, the name null when unknown."""
    named = rows.join(people.select("user_id", F.col("shown_name").alias("_name")), "user_id", "left")
    return named.withColumn("user", F.when(F.col("user_id").isNotNull(), F.struct(F.col("user_id").alias("id"), F.col("_name").alias("name")))).drop("_name")


def channel_directory(channels: DataFrame, types: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Channel records with their type; the type filter is applied, unlike in the original."""
    rows = channels.withColumn("type", channel_type())
    if types:
        rows = rows.filter(F.col("type").isin(*types))
    return rows.orderBy("id").limit(limit) if limit else rows
