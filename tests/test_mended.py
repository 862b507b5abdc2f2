import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions.calls import answers
from threadloom.operators import collection, segments, texts, words
from threadloom.plans import prompts
from threadloom.sources import records
from threadloom.streaming import ingest


@pytest.mark.parametrize("batch", ["3", "7", "10000"])
def test_one_failing_prompt_costs_one_answer(spark, batch):
    def model(asked):
        if any("17" in a for a in asked):
            raise RuntimeError("refused")
        return [a.upper() for a in asked]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        table = spark.range(100).select(F.concat(F.lit("p"), F.format_string("%02d", "id")).alias("prompt"))
        got = {r.prompt: r.response for r in prompts.run_model(table, model).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [p for p, r in got.items() if r is None] == ["p17"] and got["p18"] == "P18" and len(got) == 100


def test_answers_of_the_wrong_number_are_asked_one_by_one():
    assert answers(lambda xs: [x for x in xs if x != 3], [1, 2, 3, 4], 2) == [1, 2, None, 4]
    assert answers(lambda xs: xs, [], 2) == [] and answers(lambda xs: xs, [1, 2, 3], None) == [1, 2, 3]


def test_one_failing_text_costs_one_vector(spark):
    rows = spark.createDataFrame([(str(i), 0, f"text {i}") for i in range(10)], "c string, i int, text string")
    found = texts.conversation_texts(rows, ["c"], ["i"], keep_chars=None)
    none = spark.createDataFrame([], "text_hash string, model string, embedding array<float>")

    def embed(batch):
        return [[1.0 / (t != "text 4")] for t in batch]

    made = [r.embedding for r in texts.embed_missing(found, none, "m", embed).collect()]
    assert made.count(None) == 1 and made.count([1.0]) == 9


def test_words_with_any_names_and_orders(spark):
    rows = [("g", 1, "beta beta alpha alpha gamma"), ("g", 2, "gamma gamma"), ("h", 5, "zeta")]
    for key, order in (("k", "n"), ("k", "word"), ("_word", "_n"), ("_k0", "_at"), ("_o0", "first_place")):
        for kind in ("int", "string"):
            df = spark.createDataFrame([(a, b if kind == "int" else str(b), c) for a, b, c in rows], f"{key} string, {order} {kind}, text string")
            got = words.top_words(df, [key], [order], n=2).filter(F.col("n") > 1)
            assert [(r.n, r.rank) for r in got.orderBy("rank").collect()] == [(3, 1), (2, 2)]
    plan = words.count_words(spark.createDataFrame(rows, "k string, n int, text string"), ["k"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_context_window_follows_the_zone_of_the_request(spark):
    # 2024-01-10 in New York is 05:00 UTC to 05:00 UTC.
    day = 86_400_000_000
    start = 1_704_862_800_000_000
    table = spark.createDataFrame([("U1", "p", start, start + day - 1000, "America/New_York")], "owner_id string, period_no string, start_us long, end_us long, tz string")
    row = collection.context_window(table).first()
    assert (row.start_us, row.end_us) == (start - day, start + day - 1000)
    assert collection.context_window(table.drop("tz")).first().start_us == 1_704_844_800_000_000 - day


def test_user_records_have_an_id(spark, tmp_path):
    (tmp_path / "users.json").write_text("\n".join(json.dumps(r) for r in ({"id": "U1", "name": "ann"}, {"user_id": "U2"}, {"name": "nobody"})))
    good, bad = records.read_users(spark, str(tmp_path))
    assert {(r.user_id, r.name) for r in good.collect()} == {("U1", "ann"), ("U2", "U2")} and bad.count() == 1


def test_pair_prompts_name_the_authors(spark, chat):
    pairs = segments.message_pairs(chat([(0, "U1", "x" * 300), (1, None, "b"), (2, "U2", "c")]), ["channel"])
    said = prompts.pair_prompts(pairs, ["channel"]).first().prompt
    assert 'Message A (from U1): "' + "x" * 197 + '..."' in said and 'Message B (from unknown): "b"' in said and 'Message B (from U2): "c"' in said
    assert "x" * 300 in prompts.pair_prompts(pairs, ["channel"], text_chars=None).first().prompt


def test_edits_pass_and_local_days_are_counted(spark, tmp_path):
    rows = [("C1", 1_704_852_000_000_000, "a"), ("C1", 1_704_852_000_000_000, "a"), ("C1", 1_704_852_000_000_000, "edited"), ("C1", 1_704_870_000_000_000, "b"), ("C1", 1_706_000_000_000_000, "late")]
    table = spark.createDataFrame(rows, "channel string, ts_us long, text string").withColumn("event_time", F.timestamp_micros("ts_us"))
    table.coalesce(1).write.parquet(f"{tmp_path}/in")

    def drained(plan, name):
        stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
        plan(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}").collect()

    assert len(drained(lambda s: ingest.first_seen(s), "keys")) == 3
    assert sorted(r.text for r in drained(lambda s: ingest.first_seen(s, version=["text"]), "versions")) == ["a", "b", "edited", "late"]
    days = drained(lambda s: ingest.final_days(s, "1 day", "America/New_York"), "days")
    assert {(r.day, r.message_count) for r in days} == {("2024-01-09", 3), ("2024-01-10", 1)}
    with pytest.raises(ValueError):
        ingest.final_days(table, None, "Asia/Tokyo")


def test_stream_sessions_come_out_a_gap_after_their_end(spark, chat, tmp_path):
    """The watermark is a gap past the end of the second session, but not past the end of the slot after its last one."""
    from threadloom.streaming import sessions

    rows = chat([(m, "U1", "x") for m in (10, 50, 70, 200, 259, 260 + 2 * 1440)]).withColumn("event_time", F.timestamp_micros("ts_us"))
    rows = rows.unionByName(rows.filter(F.col("ts_us") == 259 * 60_000_000).withColumn("ts_us", F.lit(319 * 60_000_000 - 1)).withColumn("event_time", F.timestamp_micros("ts_us")))
    rows.write.parquet(f"{tmp_path}/in")
    for late, want in ((2 * 1440 - 119, [(10, 70, 3), (200, 319, 3)]), (2 * 1440 - 118, [(10, 70, 3)])):
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        plan = sessions.session_rollup(source, ["channel"], watermark=f"{late} minutes")
        plan.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{late}-state").trigger(availableNow=True).start(f"{tmp_path}/{late}").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/{late}").collect()
        assert sorted((r.start_us // 60_000_000, -(-r.end_us // 60_000_000), r.message_count) for r in got) == want


def chat_folder(spark, path, n=400):
    """Events over a few days, with gaps, threads and messages without an author."""
    kinds = "array('purchase', 'error', 'signup', 'click', 'view')"
    spark.range(n).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id DIV 40 AS INT) * 9, CAST(id % 40 AS INT) * 3, 0) AS ts",
        "id * 7 % 60 AS user_id", f"element_at({kinds}, CAST(id * 11 % 5 + 1 AS INT)) AS event_type", "1.0D AS value", "'' AS props").write.parquet(f"{path}/events.parquet")
    spark.range(60).selectExpr("id AS c_custkey", "concat('Customer ', id) AS c_name", "'BUILDING' AS c_mktsegment").write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_messages_are_cut_into_conversations_once(spark, tmp_path):
    from threadloom.catalog.consolidation import Consolidation
    from threadloom.operators import conversations
    from threadloom.sources.event_feed import messages

    folder = chat_folder(spark, tmp_path)
    c = Consolidation(spark, folder)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan(c.conv_msgs) and "parquet" not in plan(c.kept_msgs)
    assert c.conv_msgs.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = conversations.channel_conversations(messages(spark, folder))
    assert sorted(map(str, c.conv_msgs.collect())) == sorted(map(str, whole.collect()))


def test_participants_of_topics_come_from_authors(spark, tmp_path):
    """The counts of a pass over the messages, without reading them."""
    from threadloom.catalog.consolidation import Consolidation
    from threadloom.catalog.summaries import TOPIC, participant_counts, topic_messages

    c = Consolidation(spark, chat_folder(spark, tmp_path))
    counts = {(r.channel, r.topic_id): r.participant_count for r in participant_counts(c).collect()}
    passed = {(r.channel, r.topic_id): r.participant_count for r in segments.roll_up(topic_messages(c), TOPIC).collect()}
    assert len(passed) > 5 and counts == {k: n for k, n in passed.items() if n}
