"""The conversation table: main segments and threads of a scope, one id per conversation.

``scope`` names the key columns a conversation lives in: ``("channel",)`` for whole channels, or
``("owner_id", "channel")`` for every requesting user at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from threadloom.operators import segments

ORDER = ("start_us", "kind_rank", "conv_id")


def conversation_id(scope: Sequence[str], kind: str, start: str):
    """Deterministic id, so a rerun or a retried task gives the same one."""
    return F.concat_ws(":", *[F.col(c) for c in scope], F.lit(kind), F.col(start).cast("string"))


def channel_conversations(messages: DataFrame, gap_minutes: float = segments.GAP_MINUTES) -> DataFrame:
    """Long table ``(conv_id, kind, message...)`` of all conversations of all channels.

    A thread parent is in its main segment and in its thread; that repetition is part of the result.
    """
    main = segments.gap_segments(segments.main_messages(messages), ["channel"], gap_minutes)
    main = main.withColumn("conv_id", conversation_id(["channel"], "m", "seg_start_us")).withColumn("kind", F.lit("m"))
    thread = segments.thread_messages(messages)
    thread = thread.withColumn("conv_id", conversation_id(["channel"], "t", "thread_us")).withColumn("kind", F.lit("t"))
    return main.drop("seg_no", "seg_start_us").unionByName(thread)


def roll_up(conv_msgs: DataFrame, scope: Sequence[str] = ("channel",), owner: str | None = None) -> DataFrame:
    """One row per conversation with the order key: start, threads first, then id."""
    return ranked(segments.roll_up(conv_msgs, [*scope, "conv_id", "kind"], owner))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kind_rank", F.when(F.col("kind") == "t", 0).otherwise(1))


def participant_lists(participants: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Authors in first-seen order as an array, for sinks; joins use the long table."""
    return participants.groupBy(*ids).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "user_id"))), lambda p: p["user_id"]).alias("participants"))
