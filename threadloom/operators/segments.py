"""Cutting messages into conversations: time gaps, threads, boundaries, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.clock import HOUR_US, minutes, slot
from threadloom.functions.predicates import has_work_indicator, is_bot_message
from threadloom.operators.ordered import HOT_ROWS, ordered

GAP_MINUTES = 60.0
BOUNDARY_CONFIDENCE = 0.6
MIN_MESSAGES_FOR_BOUNDARIES = 3


def is_thread_reply(thread_us: str = "thread_us", ts_us: str = "ts_us") -> Column:
    return F.coalesce(F.col(thread_us) != F.col(ts_us), F.lit(False))


def main_messages(messages: DataFrame) -> DataFrame:
    """Channel messages without thread replies; thread parents stay."""
    return messages.filter(~is_thread_reply())


def thread_replies(messages: DataFrame) -> DataFrame:
    return messages.filter(is_thread_reply())


def gap_slots(messages: DataFrame, keys: Sequence[str], gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """One row per key and non-empty time slot with the segment the slot belongs to.

    A slot no wider than the gap cannot contain a boundary, so segments can be decided on slot minima and
    maxima alone. Messages are reduced by a partial aggregate and never sorted.
    """
    gap = minutes(gap_minutes)
    edges = messages.groupBy(*keys, slot("ts_us", gap).alias("_slot")).agg(
        F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*keys).orderBy("_slot")
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) >= gap, F.lit(True))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        edges.withColumn("_opens", opens)
        .withColumn("seg_no", F.sum(F.col("_opens").cast("long")).over(running))
        .withColumn("seg_start_us", F.max(F.when(F.col("_opens"), F.col("_lo"))).over(running)))


def gap_segments(messages: DataFrame, keys: Sequence[str] = ("channel",), gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Tag every message with ``seg_no`` and ``seg_start_us``; a gap of exactly the threshold splits."""
    slots = gap_slots(messages, keys, gap_minutes).select(*keys, "_slot", "seg_no", "seg_start_us")
    tagged = messages.withColumn("_slot", slot("ts_us", minutes(gap_minutes)))
    return tagged.join(slots, [*keys, "_slot"]).drop("_slot")


def gap_segment_spans(messages: DataFrame, keys: Sequence[str] = ("channel",), gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Start, end and message count per segment, from the slots alone."""
    return gap_slots(messages, keys, gap_minutes).groupBy(*keys, "seg_no").agg(
        F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"), F.sum("_rows").alias("message_count"))


def segment_statistics(messages: DataFrame, keys: Sequence[str] = ("channel",), gap_minutes: float = GAP_MINUTES, decisions: DataFrame | None = None,
                       min_confidence: float = BOUNDARY_CONFIDENCE, min_messages: int = MIN_MESSAGES_FOR_BOUNDARIES) -> DataFrame:
    """Counters of a segmentation per key: messages, conversations, threads, gap splits, semantic splits.

    ``decisions``: ``(keys..., seg_no, pair_index, is_boundary, confidence)`` on the pairs of segments. Every accepted one in a segment of at least
    ``min_messages`` is a semantic split; each place that is cut makes one conversation more.
    """
    keys = list(keys)
    slots = gap_slots(main_messages(messages), keys, gap_minutes)
    spans = slots.groupBy(*keys).agg(F.max("seg_no").alias("segments"))
    totals = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_messages"))
    # Counting distinct threads in two steps keeps the first, wide one partially aggregated.
    threads = (messages.filter(F.col("thread_us").isNotNull()).groupBy(*keys, "thread_us").agg(F.lit(1).alias("_one"))
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("threads_extracted")))
    out = totals.join(spans, keys, "left").join(threads, keys, "left")
    zero = F.lit(0)
    splits = pieces = zero.cast("long")
    if decisions is not None:
        sizes = slots.groupBy(*keys, "seg_no").agg(F.sum("_rows").alias("_size")).filter(F.col("_size") >= min_messages)
        taken = decisions.filter(F.col("is_boundary") & (F.col("confidence") >= min_confidence)).groupBy(*keys, "seg_no", "pair_index").agg(F.count(F.lit(1)).alias("_times"))
        inside = F.col("pair_index").between(0, F.col("_size") - 2)
        cuts = taken.join(sizes, [*keys, "seg_no"]).groupBy(*keys).agg(F.sum("_times").alias("_splits"), F.count_if(inside).alias("_pieces"))
        out = out.join(cuts, keys, "left")
        splits, pieces = F.coalesce("_splits", zero), F.coalesce("_pieces", zero)
    segments, threads_n = F.coalesce("segments", zero), F.coalesce("threads_extracted", zero)
    return out.select(
        *keys, "total_messages", (segments + pieces + threads_n).alias("total_conversations"), threads_n.alias("threads_extracted"),
        F.greatest(segments - 1, zero).alias("time_gap_splits"), splits.alias("semantic_splits"))


def author_counts(conv_msgs: DataFrame, ids: Sequence[str], owner: str | None = None) -> DataFrame:
    """One row per conversation and author with fixed-size sums: the base of roll-ups and of participant tables."""
    own = F.coalesce(F.col("user_id") == F.col(owner), F.lit(False)) if owner else F.lit(False)
    return conv_msgs.groupBy(*ids, "user_id").agg(
        F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count_if(own).alias("_own"),
        F.count_if(is_bot_message()).alias("_bot"), F.sum(F.length("text")).alias("_chars"), F.max(has_work_indicator()).alias("_work"))


def roll_up_authors(authors: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Conversation roll-up from :func:`author_counts`."""
    return authors.groupBy(*ids).agg(
        F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"), F.sum("_n").alias("message_count"),
        F.sum("_own").alias("user_message_count"), F.count("user_id").alias("participant_count"),
        (F.sum("_bot") == F.sum("_n")).alias("is_bot"), F.coalesce(F.sum("_chars"), F.lit(0)).alias("chars"),
        F.coalesce(F.max("_work"), F.lit(False)).alias("has_work"))


def roll_up(conv_msgs: DataFrame, ids: Sequence[str], owner: str | None = None) -> DataFrame:
    """Conversation roll-up: span, counts, bot and character totals, distinct author count.

    Two steps, ``(conversation, author)`` then ``conversation``; both are partial aggregates of fixed-size
    state, so a conversation that holds a third of all messages still reduces on the map side.
    """
    return roll_up_authors(author_counts(conv_msgs, ids, owner), ids)


def participants(conv_msgs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Long table of distinct authors per conversation with the place each was first seen."""
    return conv_msgs.filter(F.col("user_id").isNotNull()).groupBy(*ids, "user_id").agg(
        F.min(F.struct("ts_us", "msg_id")).alias("first_seen"))


def thread_messages(messages: DataFrame) -> DataFrame:
    """Messages of every thread: the parent and all replies, keyed ``(channel, thread_us)``.

    The key side is distinct, so the parent lookup is one equi-join and emits one row per message.
    """
    replies = messages.filter(F.col("thread_us").isNotNull())
    keys = replies.select("channel", "thread_us").distinct()
    parents = messages.filter(F.col("thread_us").isNull()).drop("thread_us").join(
        keys.withColumn("ts_us", F.col("thread_us")), ["channel", "ts_us"])
    return replies.unionByName(parents)


def message_pairs(messages: DataFrame, keys: Sequence[str], *, ts: str = "ts_us", tie: Sequence[str] = ("msg_id",),
                  width_us: int = HOUR_US, most_rows: int | None = HOT_ROWS) -> DataFrame:
    """Adjacent messages of a conversation; blank text reads ``[no text]``. With a ``user_id`` the pairs have both authors."""
    shown = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit("[no text]")).otherwise(F.col("text"))
    authors = "user_id" in messages.columns
    pairs = ordered(messages, keys, ts=ts, tie=tie, width_us=width_us, number="_n", most_rows=most_rows,
                    following={"second_text": shown, "second_ts": F.col(ts), **({"second_user": F.col("user_id")} if authors else {})})
    return pairs.filter(F.col("second_ts").isNotNull()).select(
        *keys, (F.col("_n") - 1).alias("pair_index"), F.col(ts).alias("first_ts"), shown.alias("first_text"),
        "second_ts", "second_text", *([F.col("user_id").alias("first_user"), "second_user"] if authors else []))


def split_at_boundaries(segment_msgs: DataFrame, decisions: DataFrame, ids: Sequence[str],
                        min_confidence: float = BOUNDARY_CONFIDENCE, *, ts: str = "ts_us", tie: Sequence[str] = ("msg_id",),
                        width_us: int = HOUR_US, min_messages: int = MIN_MESSAGES_FOR_BOUNDARIES, most_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add ``sub_no``: how many accepted boundaries lie before a message inside its segment.

    ``decisions``: ``(ids..., pair_index, is_boundary, confidence)``; the cut falls after message
    ``pair_index``. Segments with fewer than ``min_messages`` are left whole.
    """
    sizes = segment_msgs.groupBy(*ids).agg(F.count(F.lit(1)).alias("_size"))
    # The cut belongs to the message after the pair, whose 1-based place is pair_index + 2.
    cuts = decisions.filter(F.col("is_boundary") & (F.col("confidence") >= min_confidence)).select(
        *ids, (F.col("pair_index") + 2).alias("place"), F.lit(1).alias("_cut")).dropDuplicates([*ids, "place"])
    placed = ordered(segment_msgs, ids, ts=ts, tie=tie, width_us=width_us, number="place", most_rows=most_rows).join(sizes, list(ids))
    marked = placed.join(cuts, [*ids, "place"], "left").withColumn(
        "_cut", F.when(F.col("_size") >= min_messages, F.coalesce("_cut", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return ordered(marked, ids, ts=ts, tie=tie, width_us=width_us, running_sum={"sub_no": F.col("_cut")}, most_rows=most_rows).drop("_cut", "_size")


def batches(df: DataFrame, keys: Sequence[str], size: int, **order) -> DataFrame:
    """Consecutive batches of ``size`` rows per key: ``batch_no`` counts from 0."""
    return ordered(df, keys, number="_place", **({"most_rows": HOT_ROWS} | order)).withColumn(
        "batch_no", F.floor((F.col("_place") - 1) / F.lit(size)).cast("long")).drop("_place")


