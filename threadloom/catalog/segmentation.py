"""Queries that cut messages into conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.catalog.registry import query
from threadloom.catalog.sql import CONV, MAIN, MSGS, ROLL, THREADS, with_
from threadloom.operators import conversations, segments
from threadloom.sources.event_feed import messages, table


@query("time_gap_segments", with_(MSGS, MAIN) + """
SELECT channel, seg_no, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS message_count,
  count(DISTINCT user_id) AS participant_count FROM seg GROUP BY channel, seg_no""")
def time_gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = segments.gap_segments(segments.main_messages(messages(spark, sf_dir)))
    return segments.roll_up(tagged, ["channel", "seg_no"]).select(
        "channel", "seg_no", "start_us", "end_us", "message_count", "participant_count")


@query("time_gap_spans", with_(MSGS, MAIN) + """
SELECT channel, seg_no, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS message_count
FROM seg GROUP BY channel, seg_no""")
def time_gap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.gap_segment_spans(segments.main_messages(messages(spark, sf_dir)))


@query("segment_stats", with_(MSGS, MAIN) + """
SELECT t.channel, t.n AS total_messages, s.n + coalesce(h.n, 0) AS total_conversations,
  coalesce(h.n, 0) AS threads_extracted, s.n - 1 AS time_gap_splits
FROM (SELECT channel, count(*) AS n FROM msgs GROUP BY 1) t
LEFT JOIN (SELECT channel, max(seg_no)::BIGINT AS n FROM seg GROUP BY 1) s USING (channel)
LEFT JOIN (SELECT channel, count(DISTINCT thread_us) AS n FROM msgs GROUP BY 1) h USING (channel)""")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_statistics(messages(spark, sf_dir)).drop("semantic_splits")


@query("segment_stats_with_boundaries", with_(MSGS, MAIN) + """,
q AS (SELECT channel, seg_no, row_number() OVER w - 1 AS pair_index, lead(text) OVER w LIKE 'Planning%' AS cut, count(*) OVER (PARTITION BY channel, seg_no) AS size FROM seg
  WINDOW w AS (PARTITION BY channel, seg_no ORDER BY ts_us, msg_id)),
c AS (SELECT channel, count(*) AS n FROM q WHERE cut AND size >= 3 AND pair_index % 2 = 0 GROUP BY 1)
SELECT t.channel, t.n AS total_messages, s.n + coalesce(c.n, 0) + coalesce(h.n, 0) AS total_conversations, coalesce(h.n, 0) AS threads_extracted, s.n - 1 AS time_gap_splits, coalesce(c.n, 0) AS semantic_splits
FROM (SELECT channel, count(*) AS n FROM msgs GROUP BY 1) t LEFT JOIN (SELECT channel, max(seg_no)::BIGINT AS n FROM seg GROUP BY 1) s USING (channel)
LEFT JOIN (SELECT channel, count(DISTINCT thread_us) AS n FROM msgs GROUP BY 1) h USING (channel) LEFT JOIN c USING (channel)""")
def segment_stats_with_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters where a message that plans begins something new; every other decision is too unsure."""
    msgs = messages(spark, sf_dir)
    tagged = segments.gap_segments(segments.main_messages(msgs))
    pairs = segments.message_pairs(tagged, ["channel", "seg_no"])
    sure = F.when(F.col("pair_index") % 2 == 0, 0.8).otherwise(0.5)
    return segments.segment_statistics(msgs, decisions=pairs.select("channel", "seg_no", "pair_index", F.col("second_text").startswith("Planning").alias("is_boundary"), sure.alias("confidence")))


@query("session_window_equiv", with_(MSGS, MAIN) + """
SELECT channel, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS message_count FROM seg GROUP BY channel, seg_no""")
def session_window_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.streaming.sessions import session_rollup
    main = segments.main_messages(messages(spark, sf_dir))
    return session_rollup(main.withColumn("event_time", F.timestamp_micros("ts_us")), ["channel"]).select(
        "channel", "start_us", "end_us", "message_count")


@query("thread_conversations", with_(MSGS, THREADS) + """
SELECT channel, t_us AS thread_us, count(*) AS message_count, min(ts_us) AS start_us, max(ts_us) AS end_us,
  count(DISTINCT user_id) AS participant_count FROM tmsg GROUP BY channel, t_us""")
def thread_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = segments.thread_messages(messages(spark, sf_dir))
    return segments.roll_up(threads, ["channel", "thread_us"]).select(
        "channel", "thread_us", "message_count", "start_us", "end_us", "participant_count")


@query("conversations", with_(MSGS, MAIN, THREADS, CONV) + """
SELECT conv_id, channel, kind, start_us, end_us, message_count, participant_count, is_bot, chars, has_work FROM conv""")
def all_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_msgs = conversations.channel_conversations(messages(spark, sf_dir))
    return conversations.roll_up(conv_msgs).select(
        "conv_id", "channel", "kind", "start_us", "end_us", "message_count", "participant_count", "is_bot", "chars", "has_work")


@query("participants_in_order", with_(MSGS, MAIN, THREADS) + """,
p AS (SELECT channel||':m:'||min(ts_us) OVER (PARTITION BY channel, seg_no) AS conv_id, user_id, ts_us, msg_id FROM seg
  UNION ALL SELECT channel||':t:'||t_us, user_id, ts_us, msg_id FROM tmsg),
f AS (SELECT conv_id, user_id, min(ts_us) AS ts_us, arg_min(msg_id, (ts_us, msg_id)) AS msg_id FROM p
      WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT conv_id, string_agg(user_id, ',' ORDER BY ts_us, msg_id) AS participants FROM f GROUP BY 1""")
def participants_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = conversations.channel_conversations(messages(spark, sf_dir))
    return conversations.participant_lists(segments.participants(every, ["conv_id"]), ["conv_id"]).select(
        "conv_id", F.array_join("participants", ",").alias("participants"))


@query("message_pairs", """
SELECT conv_id, pair_index, first_turn, first_text, second_turn, second_text FROM (
  SELECT conv_id, row_number() OVER w - 1 AS pair_index, turn AS first_turn,
    CASE WHEN coalesce(length(text),0)=0 THEN '[no text]' ELSE text END AS first_text,
    lead(turn) OVER w AS second_turn,
    lead(CASE WHEN coalesce(length(text),0)=0 THEN '[no text]' ELSE text END) OVER w AS second_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE second_turn IS NOT NULL""")
def message_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("msg_id", F.col("turn"))
    pairs = segments.message_pairs(turns, ["conv_id"], ts="turn", width_us=1000)
    return pairs.withColumnsRenamed({"first_ts": "first_turn", "second_ts": "second_turn"})


@query("boundary_split", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS size
           FROM conversations),
c AS (SELECT *, sum(CASE WHEN size >= 3 AND n > 1 AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS sub_no FROM t)
SELECT conv_id, sub_no, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS message_count FROM c GROUP BY 1, 2""")
def boundary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("msg_id", F.col("turn"))
    from threadloom.operators.ordered import ordered
    following = ordered(turns, ["conv_id"], ts="turn", width_us=1000, number="n", following={"next_role": F.col("role")})
    decisions = following.filter(F.col("next_role").isNotNull()).select(
        "conv_id", (F.col("n") - 1).alias("pair_index"), (F.col("next_role") == "user").alias("is_boundary"),
        F.lit(0.8).alias("confidence"))
    cut = segments.split_at_boundaries(turns, decisions, ["conv_id"], ts="turn", width_us=1000)
    return cut.groupBy("conv_id", "sub_no").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("message_count"))


@query("batches", with_(MSGS, MAIN) + """,
n AS (SELECT channel, seg_no, (row_number() OVER (PARTITION BY channel, seg_no ORDER BY ts_us, msg_id) - 1) // 20 AS batch_no, msg_id FROM seg)
SELECT channel, seg_no, batch_no, count(*) AS rows_in_batch, min(msg_id) AS lowest_msg FROM n GROUP BY 1, 2, 3""")
def pair_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = segments.gap_segments(segments.main_messages(messages(spark, sf_dir)))
    return segments.batches(tagged, ["channel", "seg_no"], 20).groupBy("channel", "seg_no", "batch_no").agg(
        F.count(F.lit(1)).alias("rows_in_batch"), F.min("msg_id").alias("lowest_msg"))


@query("ordered_messages", with_(MSGS) + """
SELECT channel, msg_id, row_number() OVER (PARTITION BY channel ORDER BY ts_us, msg_id) AS place,
  lag(ts_us) OVER (PARTITION BY channel ORDER BY ts_us, msg_id) AS previous_us FROM msgs""")
def ordered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.operators.ordered import HOT_ROWS, ordered
    return ordered(messages(spark, sf_dir), ["channel"], number="place", prev={"previous_us": F.col("ts_us")}, most_rows=HOT_ROWS).select(
        "channel", "msg_id", "place", "previous_us")
