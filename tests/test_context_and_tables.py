import hashlib
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import MIN
from threadloom.operators import collection, context, links, lookup, names, segments, texts, words
from threadloom.plans import periods
from threadloom.sources import records, tables
from threadloom.streaming import ingest, sessions

DAY = 24 * 60


def short(chat, rows, first=3):
    msgs = chat(rows)
    conv = msgs.filter(F.col("msg_id") == first).select(
        "channel", F.lit("c").alias("conv_id"), F.lit(1).alias("message_count"), F.lit(1).alias("user_message_count"), F.lit("m").alias("kind"),
        F.col("ts_us").alias("first_us"), F.col("msg_id").alias("first_msg"))
    found = context.short_segment_context(conv, context.channel_positions(msgs), ["channel", "conv_id"])
    return sorted(r.msg_id for r in found.collect())


def test_short_segment_steps_back_over_gaps_up_to_an_hour(chat):
    assert short(chat, [(0, "U2", "a"), (60, "U2", "b"), (120, "U2", "c"), (180, "U1", "d")]) == [0, 1, 2]
    assert short(chat, [(0, "U2", "a"), (59.9, "U2", "b"), (120, "U2", "c"), (180, "U1", "d")]) == [2]


def test_short_segment_takes_at_most_what_it_needs(chat):
    rows = [(i, "U2", "x") for i in range(8)] + [(9, "U1", "y")]
    assert short(chat, rows, first=8) == [4, 5, 6, 7]
    assert short(chat, [(0, "U2", "ctx", {"subtype": "context_message"}), (1, "U2", "b"), (2, "U1", "c")], first=2) == [1]


def test_mention_looks_back_twenty_messages_on_the_same_day(chat):
    rows = [(10, "U2", "early")] + [(DAY + i, "U2", f"m{i}") for i in range(25)] + [(DAY + 30, "U3", "hi <@U1>"), (DAY + 31, "U1", "yes")]
    msgs = chat(rows)
    conv = msgs.filter("msg_id >= 26").withColumn("c", F.lit("x"))
    got = sorted(r.msg_id for r in context.mention_lookback(conv, context.channel_positions(msgs), ["channel", "c"]).collect())
    assert got == list(range(6, 26))
    first_day = msgs.filter("msg_id = 0 or msg_id = 26").withColumn("c", F.lit("x"))
    few = context.mention_lookback(first_day, context.channel_positions(first_day), ["channel", "c"])
    assert few.count() == 0, "the day before does not count"


def test_no_look_back_when_the_user_opened(chat):
    msgs = chat([(0, "U2", "before"), (1, "U1", "note to <@U1>")])
    conv = msgs.filter("msg_id = 1").withColumn("c", F.lit("x"))
    assert context.mention_lookback(conv, context.channel_positions(msgs), ["channel", "c"]).count() == 0


def test_context_is_added_once(chat):
    msgs = chat([(0, "U2", "a"), (0, "U3", "same time"), (5, "U1", "b")])
    conv = msgs.filter("msg_id = 2").withColumn("conv_id", F.lit("c")).withColumn("owner_id", F.lit("U1")).withColumn("kind", F.lit("m"))
    ids = ["owner_id", "channel", "conv_id"]
    rolled = conv.groupBy(*ids, "kind").agg(F.count(F.lit(1)).alias("message_count"), F.count(F.lit(1)).alias("user_message_count"))
    full = context.enrich(conv, context.channel_positions(msgs), ids, "owner_id", rolled)
    assert sorted((r.msg_id, r.subtype) for r in full.collect()) == [(0, "context_message"), (2, None)]


def spans(spark, *rows):
    df = spark.createDataFrame([(o, t, tz, 1709683200000000) for o, t, tz in rows], "owner_id string, timespan string, tz string, as_of_us long")  # 2024-03-06 00:00 UTC
    return periods.resolve(df)


def test_periods(spark):
    good, bad = spans(spark, ("a", "Today", "UTC"), ("b", "today", "America/New_York"), ("c", "last-week", "UTC"), ("d", "2024-03-01..2024-03-02", "UTC"), ("e", "soon", "UTC"), ("f", "2024-13-01", "UTC"))
    got = {r.owner_id: (r.start_us, r.end_us) for r in good.collect()}
    day = DAY * MIN
    assert got["a"] == (1709683200000000, 1709683200000000 + day - 1000)
    assert got["b"][0] == 1709683200000000 - 19 * 60 * MIN, "still the fifth in New York"
    assert (got["c"][1] - got["c"][0] + 1000) // day == 8
    assert (got["d"][1] - got["d"][0] + 1000) // day == 2
    assert sorted(r.owner_id for r in bad.collect()) == ["e", "f"]


def test_timespan_words(spark):
    cases = [("today", "week", "last-week"), ("yesterday", "week", "yesterday"), ("2024-01-28", "week", "2024-01-28..2024-02-03"), ("x", "2024-01-01..2024-01-02", "2024-01-01..2024-01-02"), ("2024-01-28", "day", "2024-01-28")]
    df = spark.createDataFrame(cases, "d string, s string, want string")
    assert df.filter(periods.build_timespan(F.col("d"), F.col("s")) != F.col("want")).count() == 0


def period(spark, start, end, owner="U1"):
    return spark.createDataFrame([(owner, "p", round(start * MIN), round(end * MIN), "UTC")], "owner_id string, period_no string, start_us long, end_us long, tz string")


def test_mention_only_channel_counts_in_totals_only(spark, chat):
    msgs = chat([(10, "U1", "mine"), (11, "U2", "hi <@U1>", {"channel": "C9"}), (12, "U2", "reply", {"thread": 10}), (13, "U1", "re", {"thread": 10})])
    span = period(spark, 0, 100)
    threads = collection.thread_sizes(collection.participated_threads(msgs, span), segments.thread_messages(msgs), span)
    assert [(r.thread_us, r.message_count) for r in threads.collect()] == [(10 * MIN, 3)]
    tally = collection.channel_activity(collection.own_messages(msgs, span), collection.mentions(msgs, span), threads)
    assert [(r.channel, r.messages_sent, r.threads) for r in collection.kept_channels(tally).collect()] == [("C1", 2, 1)]
    total = collection.totals(tally, tally.select("owner_id", "period_no").limit(0)).first()
    assert (total.total_channels, total.total_messages, total.mentions_received, total.threads_participated) == (1, 2, 1, 1)


def test_a_day_back_is_context_and_not_activity(spark, chat):
    msgs = chat([(DAY - 5, "U1", "yesterday", {"thread": DAY - 6}), (DAY + 5, "U2", "answer", {"thread": DAY - 6}), (DAY + 6, "U1", "today")])
    span = period(spark, DAY, 2 * DAY - 0.001)
    assert [r.msg_id for r in collection.own_messages(msgs, span).collect()] == [2]
    threads = collection.thread_sizes(collection.participated_threads(msgs, span), segments.thread_messages(msgs), span)
    assert [r.message_count for r in threads.collect()] == [1], "found through the day before, counted in the period"


def test_search_needs_both_dates(chat):
    msgs = chat([(0, "U1", "Alpha beta"), (3 * DAY, "U1", "ALPHA"), (3 * DAY, "U2", "gamma")])
    found = lambda *a, **k: [r.msg_id for r in lookup.search(msgs, *a, **k).collect()]
    assert found(["alpha"]) == [0, 1] and found(["alpha", "beta"]) == [0] and found([], user="U2") == [2]
    assert found(["alpha"], from_date="1970-01-02") == [0, 1]
    assert found(["alpha"], from_date="1970-01-02", to_date="1970-01-04") == [1]
    assert found(["alpha"], limit=1) == [0]


def people(spark):
    raw = spark.createDataFrame([("U1", "ann", "Ann Lee", "", False), ("U2", "bo", "", "Bo B", False), ("U3", "cy", None, None, False), ("U4", "gone", "G", "", True)],
                                "user_id string, name string, real_name string, display_name string, deleted boolean")
    return names.directory(raw)


def test_names(spark):
    folk = people(spark)
    assert {r.user_id: r.shown_name for r in folk.collect()} == {"U1": "Ann Lee", "U2": "Bo B", "U3": "cy"}
    df = spark.createDataFrame([(1, "<@U1|x> and <@U9> to <@U2>"), (2, "none"), (3, None), (4, "<@U1><@U1>")], "i int, text string")
    got = {r.i: r.shown_text for r in names.resolve_mentions(df, folk, ["i"]).collect()}
    assert got == {1: "@Ann Lee and <@U9> to @Bo B", 2: "none", 3: None, 4: "@Ann Lee@Ann Lee"}


def test_channel_names(spark):
    chans = spark.createDataFrame([("C1", "general", False, False, None), ("C2", None, False, False, None), ("D1", None, True, False, "U2"), ("D2", None, True, False, "U8"),
                                   ("G1", "mpdm-a--b-1", False, True, None), ("G2", "mpdm-ann.x--bo.y@z--cy-12", False, True, None), ("G3", "odd", False, True, None)],
                                  "id string, name string, is_im boolean, is_mpim boolean, user string")
    members = spark.createDataFrame([("G1", 2, "U3"), ("G1", 1, "U2"), ("G1", 0, "U1")], "channel string, place int, user_id string")
    asked = spark.createDataFrame([("U1", c) for c in ("C1", "C2", "D1", "D2", "G1", "G2", "G3", "X")], "owner_id string, channel string")
    got = {r.channel: r.channel_name for r in names.channel_names(asked, chans, members, people(spark)).collect()}
    assert got == {"C1": "general", "C2": "C2", "D1": "Bo B", "D2": "U8", "G1": "Group: Bo, cy", "G2": "Group: Bo, Cy", "G3": "Group Chat", "X": "X"}


def test_linked_messages_keep_order_and_first_address(spark, chat):
    url = "https://acme.slack.com/archives/C1/p1704067200000100"
    msgs = chat([(1704067200000100 / MIN, "U2", "quoted"), (10, "U1", f"{url}?a=1 {url}"), (11, "U1", f"again {url} https://acme.slack.com/archives/C1/p99")])
    got = links.linked_messages(msgs, msgs, ["msg_id"]).orderBy("msg_id", "at").collect()
    assert [(r.msg_id, r.at, r.text, r.author_id, r.from_url) for r in got] == [(1, 0, "quoted", "U2", f"{url}?a=1"), (1, 1, "quoted", "U2", f"{url}?a=1"), (2, 0, "quoted", "U2", f"{url}?a=1")]


def test_top_words(spark):
    df = spark.createDataFrame([("g", 1, "Deploy deploy the server!"), ("g", 2, "server fails, they said; review review"), ("h", 1, "ok a the")], "k string, n int, text string")
    assert [(r.word, r.n) for r in words.top_words(df, ["k"], ["n"]).orderBy("rank").collect()] == [("deploy", 2), ("server", 2), ("review", 2)]


def test_conversation_texts_stream_over_batches(spark):
    rows = [(c, i, t) for c in "ab" for i, t in enumerate(["eins", "", "zwei", None, "drei", "vier", "fünf"])] + [("c", 0, " "), ("d", 0, "")]
    got = {r.c: r for r in texts.conversation_texts(spark.createDataFrame(rows, "c string, i int, text string"), ["c"], ["i"], keep_chars=7).collect()}
    whole = "eins zwei drei vier fünf"
    for key in "ab":
        assert (got[key].text_hash, got[key].n_chars, got[key].embed_text) == (hashlib.sha256(whole.encode()).hexdigest(), len(whole), whole[:7])
    assert not got["c"].has_text and not got["d"].has_text and got["d"].text_hash == hashlib.sha256(b"").hexdigest()


def test_vectors_are_made_once_per_text_and_reused(spark):
    rows = spark.createDataFrame([("a", 0, "one"), ("b", 0, "one"), ("c", 0, "two"), ("d", 0, " ")], "c string, i int, text string")
    found = texts.conversation_texts(rows, ["c"], ["i"])
    stored = tables.vector_rows(found.filter("c = 'c'").select("text_hash", F.array(F.lit(9.0)).alias("embedding")), "m", F.lit(1))
    made = texts.embed_missing(found, stored, "m", lambda batch: [[float(len(t))] for t in batch])
    assert [r.embedding for r in made.collect()] == [[3.0]]
    both = stored.unionByName(tables.vector_rows(made, "m", F.lit(2)))
    assert {r.c: r.embedding for r in texts.with_vectors(found, both, "m").collect()} == {"a": [3.0], "b": [3.0], "c": [9.0], "d": None}

    def broken(batch):
        raise RuntimeError("service is down")

    assert [r.embedding for r in texts.embed_missing(found, stored, "m", broken).collect()] == [None]
    assert tables.drop_vectors(both).count() == 0 and tables.drop_vectors(both, made.first().text_hash).count() == 1


def test_message_reader_quarantines(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    lines = [json.dumps({"channel": "C1", "ts": "1704067200.000100", "user": "U1", "text": "hi", "extra": 1, "reactions": [{"name": "eyes", "count": 1, "users": ["U2"]}]}),
             json.dumps({"channel": "C1", "user": "U1"}), "{broken", json.dumps({"channel": "C1", "ts": "1704067201.5", "reply_count": "many"}), json.dumps({"channel": "C1", "ts": "1704067202.5"})]
    with open(f"{folder}/m.json", "w") as f:
        f.write("\n".join(lines))
    good, bad = records.read_messages(spark, folder)
    assert [(r.ts_us, r.text, r.type) for r in good.orderBy("ts_us").collect()] == [(1704067200000100, "hi", "message"), (1704067202500000, "", "message")]
    assert bad.count() == 3


def test_upsert_is_idempotent_and_replaces_only_touched_days(spark, chat):
    path = tempfile.mkdtemp(prefix="run-") + "/messages"
    rows = lambda text, at, minutes: tables.message_rows(chat([(m, "U1", text) for m in minutes]), F.lit(at))
    put = lambda df: tables.upsert(spark, path, df, tables.MESSAGE_KEY, ["fetched_at"], "day_bucket")
    put(rows("old", 1, [0, 1, DAY]))
    for _ in range(2):
        put(rows("new", 2, [1, 2]))
    got = sorted((r.ts_us // MIN, r.text) for r in tables.read_table(spark, path).collect())
    assert got == [(0, "old"), (1, "new"), (2, "new"), (DAY, "old")]
    assert [r.row_count for r in tables.statistics({"messages": tables.read_table(spark, path)}).collect()] == [4]
    tables.truncate(spark, path)
    assert tables.read_table(spark, path + "-none") is None


def test_ledger(spark):
    keys = "owner_id string, channel string, day string, data_type string"
    wanted = spark.createDataFrame([("U1", "C1", d, "messages") for d in ("2024-01-01", "2024-01-02", "2024-01-03")] + [("U2", "C1", "2024-01-01", "messages")], keys)
    done = spark.createDataFrame([("U1", "C1", d, "messages") for d in ("2024-01-01", "2024-01-03")] + [("U2", "C1", "2024-01-01", "messages")], keys)
    days = lambda df: sorted((r.owner_id, r.day[-2:]) for r in df.collect())
    assert days(tables.missing_days(wanted, done, "2024-01-03")) == [("U1", "02"), ("U1", "03")], "today is never complete"
    assert days(tables.missing_days(wanted, done, "2024-01-03", ["owner_id"])) == [("U1", "01"), ("U1", "02"), ("U1", "03")]


@pytest.fixture()
def stream(spark, chat):
    folder = tempfile.mkdtemp(prefix="run-")
    rows = [(1 + i * 50 + (200 if i > 3 else 0), "U1", f"t{i}") for i in range(8)] + [(1 + i * 50, "U1", f"t{i}") for i in range(2)] + [(20 * DAY, "U1", "end")]
    msgs = chat(rows).withColumn("event_time", F.timestamp_micros("ts_us"))
    msgs.write.mode("overwrite").parquet(f"{folder}/in")
    return msgs, spark.readStream.schema(msgs.schema).parquet(f"{folder}/in"), folder


def drain(spark, plan, folder):
    q = plan.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_stream_sessions_equal_batch_sessions(spark, stream):
    msgs, source, folder = stream
    got = drain(spark, sessions.session_rollup(source, ["channel"], watermark="1 day").select("start_us", "end_us", "message_count"), folder)
    want = segments.gap_segment_spans(msgs).filter(F.col("end_us") < 19 * DAY * MIN)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("start_us", "end_us", "message_count").collect()))


def test_final_days_without_repeats(spark, stream):
    _, source, folder = stream
    got = drain(spark, ingest.final_days(ingest.first_seen(source), None), folder)
    assert [(r.day, r.message_count) for r in got.collect()] == [("1970-01-01", 8)]


def test_stream_into_the_message_table(spark, stream):
    msgs, source, folder = stream
    for _ in range(2):
        ingest.message_sink(source, f"{folder}/table", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    stored = tables.read_table(spark, f"{folder}/table")
    assert stored.count() == msgs.select("channel", "ts_us").distinct().count() == 9


def test_stream_sessions_after_a_restart_with_late_rows(spark, chat):
    """A stream stopped between files goes on where it was; rows behind the watermark change nothing; a busy channel comes as slots."""
    folder = tempfile.mkdtemp(prefix="run-")
    parts = [[(m, "U1", "x") for m in (0, 30, 59, 119, 200)], [(m, "U1", "x") for m in (230, 500, 2 * DAY)] + [(10, "U1", "x", {"channel": "C2"})],
             [(m, "U1", "late") for m in (70, 260)] + [(2 * DAY + 30, "U1", "x")], [(9 * DAY, "U1", "end"), (9 * DAY, "U1", "end", {"channel": "C2"})]]
    source = None
    for n, part in enumerate(parts):
        rows = chat(part).withColumn("event_time", F.timestamp_micros("ts_us"))
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        got = drain(spark, sessions.session_rollup(source, ["channel"], watermark="1 hour").select("channel", "start_us", "end_us", "message_count"), folder)
    told = sorted((r.channel, r.start_us // MIN, r.end_us // MIN, r.message_count) for r in got.collect())
    assert told == [("C1", 0, 59, 3), ("C1", 119, 119, 1), ("C1", 200, 230, 2), ("C1", 500, 500, 1), ("C1", 2 * DAY, 2 * DAY + 30, 2)]


def test_stream_sessions_by_several_keys_and_odd_gaps(spark, chat):
    folder = tempfile.mkdtemp(prefix="run-")
    rows = [(m * 7 % 900, f"U{m % 3}", "x", {"channel": f"C{m % 2}"}) for m in range(300)] + [(99 * DAY, f"U{m % 3}", "x", {"channel": f"C{m % 2}"}) for m in range(6)]
    msgs = chat(rows).withColumn("event_time", F.timestamp_micros("ts_us"))
    msgs.repartition(6).write.parquet(f"{folder}/in")
    keys = ["channel", "user_id"]
    source = spark.readStream.schema(msgs.schema).parquet(f"{folder}/in")
    plan = sessions.session_rollup(source, keys, gap_minutes=12.5, watermark="30 days")
    got = drain(spark, plan, folder)
    want = sessions.session_rollup(msgs, keys, gap_minutes=12.5).filter(F.col("end_us") < 60 * DAY * MIN)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*keys, "start_us", "end_us", "message_count").collect()))
    assert got.count() > 10


def test_no_exchange_of_single_rows_by_channel(spark, stream):
    """The only exchange before the partial counts of slots is none; by channel alone go slots."""
    _, source, folder = stream
    plan = sessions.session_rollup(source, ["channel"], watermark="1 day")
    query = plan.writeStream.outputMode("append").format("memory").queryName("plan_of_sessions").option("checkpointLocation", f"{folder}/plan").trigger(availableNow=True).start()
    query.awaitTermination()
    text = query._jsq.explainInternal(False)
    exchanges = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "window" in exchanges[1] and "window" not in exchanges[0].split("),")[0].replace("window_time", "")
    below = text[text.index(exchanges[1]):]
    assert "partial_count" in below or "HashAggregate" in below
