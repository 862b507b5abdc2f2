import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import MIN
from threadloom.operators import conversations, segments
from threadloom.operators.ordered import first_n, ordered, sub_slots
from threadloom.streaming.sessions import session_rollup


def random_rows(seed, n=200):
    rng = random.Random(seed)
    # Two thirds of the rows share one key, many share a time stamp, some slots are empty.
    return [(i, "hot" if rng.random() < 0.66 else rng.choice("ab"), rng.choice([rng.randrange(0, 40) * 30 * MIN, rng.randrange(0, 10**10)]),
             rng.randrange(5)) for i in range(n)]


def test_ordered_matches_a_plain_loop(spark):
    rows = random_rows(1)
    df = spark.createDataFrame(rows, "msg_id long, k string, ts_us long, v long")
    got = {r.msg_id: r for r in ordered(df, ["k"], prev={"p": F.col("v")}, following={"f": F.col("v")}, running_sum={"s": F.col("v")},
                                        max_before={"m": F.col("v")}, number="n", before="b").collect()}
    assert len(got) == len(rows)
    for key in "hot", "a", "b":
        part = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(part):
            g = got[r[0]]
            assert g.p == (part[i - 1][3] if i else None)
            assert g.f == (part[i + 1][3] if i + 1 < len(part) else None)
            assert g.s == sum(x[3] for x in part[: i + 1]) and g.n == i + 1
            assert g.m == (max(x[3] for x in part[:i]) if i else None)
            assert g.b == sum(x[2] < r[2] for x in part)


def hot_rows(seed, n=600):
    """95 % of the rows in one slot of one key, half of these at one moment."""
    rng = random.Random(seed)
    return [(i, "hot", rng.choice([7 * MIN, rng.randrange(0, 60 * MIN)]), rng.randrange(5)) if rng.random() < 0.95 else (i, rng.choice("ab"), rng.randrange(0, 10**10), 1) for i in range(n)]


@pytest.mark.parametrize("most", [20, 7, 100_000])
def test_hot_slots_are_cut_and_nothing_changes(spark, most):
    rows = hot_rows(3)
    df = spark.createDataFrame(rows, "msg_id long, k string, ts_us long, v long")
    want = {"prev": {"p": F.col("v")}, "following": {"f": F.col("v")}, "running_sum": {"s": F.col("v")}, "max_before": {"m": F.col("v")}, "number": "n", "before": "b"}
    plain = sorted(map(tuple, ordered(df, ["k"], **want).collect()))
    assert sorted(map(tuple, ordered(df, ["k"], most_rows=most, **want).collect())) == plain
    by_name = df.withColumn("name", F.lpad(F.col("msg_id").cast("string"), 5, "0"))
    assert sorted(tuple(r)[:4] + tuple(r)[5:] for r in ordered(by_name, ["k"], tie=("name",), most_rows=most, **want).collect()) == plain
    assert sorted(map(tuple, ordered(df, ["k"], tie=(), most_rows=most, running_sum={"c": F.lit(1)}).groupBy("k").agg(F.max("c")).collect())) == sorted(
        map(tuple, df.groupBy("k").count().collect()))


def test_a_hot_slot_lies_in_many_parts(spark):
    rows = hot_rows(4, 2_000)
    df = spark.createDataFrame(rows, "msg_id long, k string, ts_us long, v long").withColumn("_slot", F.floor(F.col("ts_us") / (60 * MIN)))
    cut = sub_slots(df, ["k"], ["ts_us", "msg_id"], 50)
    sizes = [r["count"] for r in cut.groupBy("k", "_slot", "_s1", "_s2").count().collect()]
    assert sum(sizes) == 2_000 and max(sizes) <= 150 and len(sizes) >= 20
    at = [(r.ts_us, r.msg_id, (r._s1, r._s2)) for r in cut.filter("k = 'hot'").orderBy("ts_us", "msg_id").collect()]
    assert [x[2] for x in at] == sorted(x[2] for x in at), "parts follow the order"
    same = df.withColumn("ts_us", F.lit(5)).withColumn("_slot", F.lit(0))
    assert max(r["count"] for r in sub_slots(same, ["k"], ["ts_us", "msg_id"], 50).groupBy("k", "_s1", "_s2").count().collect()) <= 150


def test_ordered_keeps_null_values(spark):
    df = spark.createDataFrame([(0, "a", 0, None), (1, "a", 5, "x"), (2, "a", 9, None)], "msg_id long, k string, ts_us long, v string")
    rows = ordered(df, ["k"], prev={"p": F.col("v")}, following={"f": F.col("v")}).orderBy("msg_id").collect()
    assert [(r.p, r.f) for r in rows] == [(None, "x"), (None, None), ("x", None)]


def test_first_n_uses_a_group_limit(spark):
    df = spark.createDataFrame(random_rows(2), "msg_id long, k string, ts_us long, v long")
    top = first_n(df, ["k"], ["ts_us", "msg_id"], 3)
    assert {r["k"]: r["count"] for r in top.groupBy("k").count().collect()} == {"hot": 3, "a": 3, "b": 3}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def spans(df):
    return sorted((r.start_us // MIN, r.end_us // MIN, r.message_count) for r in df.collect())


def test_gap_of_exactly_the_threshold_splits(chat):
    msgs = chat([(0, "U1", "a"), (60, "U1", "b"), (119.999, "U1", "c")])
    assert spans(segments.gap_segment_spans(msgs)) == [(0, 0, 1), (60, 119, 2)]


def test_no_message_and_one_message(chat):
    assert spans(segments.gap_segment_spans(chat([(5, "U1", "x")]))) == [(5, 5, 1)]
    assert segments.gap_segment_spans(chat([(5, "U1", "x")]).filter("false")).count() == 0


def test_segments_partition_the_messages_in_any_input_order(chat, spark):
    rng = random.Random(3)
    rows = [(rng.randrange(0, 3000), "U1", "x") for _ in range(80)]
    msgs = chat(rows)
    times = sorted(r[0] for r in rows)
    want, begin = [], 0
    for i in range(1, len(times) + 1):
        if i == len(times) or times[i] - times[i - 1] >= 60:
            want.append((times[begin], times[i - 1], i - begin))
            begin = i
    shuffled = msgs.orderBy(F.rand(7))
    assert spans(segments.gap_segment_spans(shuffled)) == want
    tagged = segments.gap_segments(shuffled)
    assert tagged.count() == len(rows) and tagged.select("msg_id").distinct().count() == len(rows)
    assert spans(segments.roll_up(tagged, ["seg_no"])) == want
    windowed = session_rollup(msgs.withColumn("event_time", F.timestamp_micros("ts_us")), ["channel"])
    assert spans(windowed) == want


def test_thread_parent_is_in_both_conversations(chat):
    msgs = chat([(0, "U1", "parent"), (5, "U2", "reply", {"thread": 0}), (7, "U1", "main")])
    rows = conversations.roll_up(conversations.channel_conversations(msgs)).collect()
    assert {(r.kind, r.message_count) for r in rows} == {("m", 2), ("t", 2)}


def test_participants_are_listed_as_first_seen(chat):
    msgs = chat([(0, "U9", "a"), (1, None, "bot"), (2, "U1", "b"), (3, "U9", "c")])
    people = segments.participants(msgs.withColumn("c", F.lit(1)), ["c"])
    assert conversations.participant_lists(people, ["c"]).first().participants == ["U9", "U1"]
    rolled = segments.roll_up(msgs.withColumn("c", F.lit(1)), ["c"]).first()
    assert (rolled.participant_count, rolled.is_bot, rolled.message_count) == (2, False, 4)


def test_boundaries_cut_after_the_first_of_the_pair(chat, spark):
    msgs = chat([(i, "U1", "x") for i in range(4)]).withColumn("c", F.lit(1))
    decisions = spark.createDataFrame([(1, 0, True, 0.5), (1, 1, True, 0.6), (1, 2, False, 0.9)], "c int, pair_index long, is_boundary boolean, confidence double")
    cut = segments.split_at_boundaries(msgs, decisions, ["c"])
    assert [r.sub_no for r in cut.orderBy("msg_id").collect()] == [0, 0, 1, 1]
    short = segments.split_at_boundaries(msgs.filter("msg_id < 2"), decisions, ["c"])
    assert {r.sub_no for r in short.collect()} == {0}


def test_pairs_show_blank_text(chat):
    pairs = segments.message_pairs(chat([(0, "U1", ""), (200, "U1", "b"), (201, "U1", "c")]), ["channel"]).orderBy("pair_index").collect()
    assert [(p.pair_index, p.first_text, p.second_text) for p in pairs] == [(0, "[no text]", "b"), (1, "b", "c")]


def test_statistics_count_splits(chat):
    msgs = chat([(0, "U1", "a"), (90, "U1", "b"), (91, "U2", "c", {"thread": 0})])
    row = segments.segment_statistics(msgs).first()
    assert (row.total_messages, row.total_conversations, row.threads_extracted, row.time_gap_splits) == (3, 3, 1, 1)


def test_semantic_splits_are_counted(spark, chat):
    """Accepted decisions count, also twice at one place; a cut at the end of a segment, or in a short one, makes nothing more."""
    msgs = chat([(m, "U1", "x") for m in (0, 1, 2, 3, 200, 201, 400)] + [(5, "U1", "r", {"thread": 0})])
    rows = [("C1", 1, 0, True, 0.6), ("C1", 1, 0, True, 0.9), ("C1", 1, 2, True, 0.59), ("C1", 1, 3, True, 0.9), ("C1", 1, 1, False, 0.9), ("C1", 2, 0, True, 0.9)]
    decisions = spark.createDataFrame(rows, "channel string, seg_no long, pair_index long, is_boundary boolean, confidence double")
    got = segments.segment_statistics(msgs, decisions=decisions).first()
    assert (got.total_messages, got.total_conversations, got.threads_extracted, got.time_gap_splits, got.semantic_splits) == (8, 5, 1, 2, 3)
    assert segments.segment_statistics(msgs).first().semantic_splits == 0
