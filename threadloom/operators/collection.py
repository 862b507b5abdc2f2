"""What each user did in their period, for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.functions.clock import DAY_US, day_start_us, local_day
from threadloom.functions.predicates import mentioned_users

LOOKBACK_US = DAY_US


def in_period(rows: DataFrame, periods: DataFrame, owner: str = "owner_id", ts: str = "ts_us") -> DataFrame:
    """Rows of an owner inside that owner's period; the period joins on the owner, never on time alone."""
    return rows.join(periods.select(owner, "period_no", "start_us", "end_us"), owner).filter(
        F.col(ts).between(F.col("start_us"), F.col("end_us")))


def own_messages(messages: DataFrame, periods: DataFrame) -> DataFrame:
    """Messages a user sent in the period."""
    return in_period(messages.filter(F.col("user_id").isNotNull()).withColumn("owner_id", F.col("user_id")), periods).drop("start_us", "end_us")


def context_window(periods: DataFrame, tz: str | None = None) -> DataFrame:
    """Periods widened by 24 hours at the start and then to whole days in the zone of the request (column ``tz``), or in ``tz``."""
    tz = tz or (F.col("tz") if "tz" in periods.columns else "UTC")
    first = day_start_us(local_day(F.col("start_us") - LOOKBACK_US, tz), tz)
    last = day_start_us(F.date_add(local_day("end_us", tz), 1), tz) - 1000
    return periods.withColumn("start_us", first).withColumn("end_us", last)


def active_channels(messages: DataFrame, periods: DataFrame) -> DataFrame:
    """Channels in which a user wrote at least once in the period."""
    return own_messages(messages, periods).select("owner_id", "period_no", "channel").distinct()


def participated_threads(messages: DataFrame, periods: DataFrame) -> DataFrame:
    """Threads a user took part in: an own message with a thread stamp in the widened window, in an active channel."""
    wide = context_window(periods)
    own = own_messages(messages.filter(F.col("thread_us").isNotNull()), wide).select("owner_id", "period_no", "channel", "thread_us").distinct()
    return own.join(active_channels(messages, periods), ["owner_id", "period_no", "channel"], "left_semi")


def thread_sizes(threads: DataFrame, thread_msgs: DataFrame, periods: DataFrame) -> DataFrame:
    """Messages of each participated thread inside the owner's period; threads without any are left out.

    Thread messages are first counted per (thread, period), so a thread is read once per distinct period and not once per
    participant.
    """
    spans = periods.select("period_no", "start_us", "end_us").distinct()
    wanted = threads.select("channel", "thread_us", "period_no").distinct().join(spans, "period_no")
    counted = (thread_msgs.select("channel", "thread_us", "ts_us").join(wanted, ["channel", "thread_us"])
               .filter(F.col("ts_us").between(F.col("start_us"), F.col("end_us")))
               .groupBy("channel", "thread_us", "period_no").agg(F.count(F.lit(1)).alias("message_count")))
    return threads.join(counted, ["channel", "thread_us", "period_no"])


def mentions(messages: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Messages that mention a user, one row per (message, mentioned user)."""
    rows = messages.withColumn("owner_id", F.explode(F.array_distinct(mentioned_users())))
    return rows if periods is None else in_period(rows, periods).drop("start_us", "end_us")


def reactions_given(messages: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Reactions by user; they carry the time of the message, not of the reaction."""
    each = messages.select("channel", "msg_id", "ts_us", F.explode("reactions").alias("_r"))
    rows = each.select("channel", "msg_id", "ts_us", F.col("_r.name").alias("reaction"), F.explode(F.array_distinct("_r.users")).alias("owner_id"))
    return rows if periods is None else in_period(rows, periods).drop("start_us", "end_us")


def channel_activity(sent: DataFrame, mentioned: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages sent, mentions received and threads per user and channel: one tagged union, one group-by."""
    keys = ["owner_id", "period_no", "channel"]
    tagged = (sent.select(*keys, F.lit("s").alias("what")).unionByName(mentioned.select(*keys, F.lit("m").alias("what")))
              .unionByName(threads.select(*keys, F.lit("t").alias("what"))))
    return tagged.groupBy(*keys).agg(F.count_if(F.col("what") == "s").alias("messages_sent"), F.count_if(F.col("what") == "m").alias("mentions_received"),
                                     F.count_if(F.col("what") == "t").alias("threads"))


def kept_channels(activity: DataFrame) -> DataFrame:
    """Channels the user took part in; a mention alone does not count."""
    return activity.filter((F.col("messages_sent") > 0) | (F.col("threads") > 0))


def totals(activity: DataFrame, reactions: DataFrame) -> DataFrame:
    """Totals per user: all mentions count, but only the kept channels."""
    keys = ["owner_id", "period_no"]
    kept = (F.col("messages_sent") > 0) | (F.col("threads") > 0)
    sums = activity.groupBy(*keys).agg(
        F.count_if(kept).alias("total_channels"), F.sum("messages_sent").alias("total_messages"),
        F.sum("mentions_received").alias("mentions_received"), F.sum("threads").alias("threads_participated"))
    reacted = reactions.groupBy(*keys).agg(F.count(F.lit(1)).alias("reactions_given"))
    return sums.join(reacted, keys, "full").na.fill(0)
