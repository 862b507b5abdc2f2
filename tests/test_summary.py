import pytest
from pyspark.sql import functions as F

from tests.conftest import MIN
from threadloom.functions import rendering
from threadloom.plans import prompts, report, summary


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_answers_are_parsed_with_defaults(spark):
    got = one(spark, prompts.parse_summary(F.lit('Sure: {"narrative": "N", "keyEvents": ["k"], "outcome": null} done')))
    assert (got.narrative, got.keyEvents, got.references, got.outcome, got.timesheetEntry) == ("N", ["k"], [], None, "Activity summary")
    assert one(spark, prompts.parse_summary(F.lit("{}"))).narrative == "Discussion summary unavailable"
    for bad in ("nothing", '{"narrative": "x", }', '{"a": 1'):
        assert one(spark, prompts.parse_summary(F.lit(bad))) is None
    assert one(spark, prompts.parse_topic(F.lit('{"keyPoints": ["p"]}'))).topic == "Unknown topic"


def test_a_batch_answer_must_have_one_entry_per_topic(spark):
    text = 'x [{"narrative": "a"}, {"keyEvents": ["b"]}] y'
    assert [s.narrative for s in one(spark, prompts.parse_summaries(F.lit(text), F.lit(2)))] == ["a", "Discussion summary unavailable"]
    assert one(spark, prompts.parse_summaries(F.lit(text), F.lit(3))) is None


def test_boundaries_count_by_position(spark):
    df = spark.createDataFrame([("a", 1, 2, '[{"index": 9, "boundary": true}, {"boundary": false}]'), ("b", 0, 2, "no"), ("c", 0, 1, '[{"boundary": true}, {"boundary": true}]')],
                               "c string, batch_no long, pairs long, response string")
    got = {(r.c, r.pair_index): (r.is_boundary, r.confidence) for r in prompts.parse_boundaries(df, ["c"]).collect()}
    assert got == {("a", 20): (True, 0.8), ("a", 21): (False, 0.8), ("b", 0): (False, 0.5), ("b", 1): (False, 0.5), ("c", 0): (False, 0.5)}


def test_pair_scorer_function(spark):
    pairs = spark.createDataFrame([("c", 0, "aa", "aa"), ("c", 1, "aa", "bb")], "c string, pair_index long, first_text string, second_text string")
    by_rule = prompts.score_pairs(pairs).orderBy("pair_index").collect()
    by_function = prompts.score_pairs(pairs, lambda a, b: [0.9 if x != y else 0.1 for x, y in zip(a, b)]).orderBy("pair_index").collect()
    assert [r.is_boundary for r in by_rule] == [r.is_boundary for r in by_function] == [False, True]


def people(spark):
    return spark.createDataFrame([("U1", "Ann"), ("U2", "Bo")], "user_id string, shown_name string")


def test_lines(spark):
    att = "array<struct<fallback:string,text:string,title:string,author_name:string,author_id:string,channel_name:string,from_url:string>>"
    rows = [(0, "U1", "hi <@U2>", None, None), (1, None, "built", "bot_message", None), (2, None, "old", "context_message", None), (3, "U9", "", None, None),
            (4, "U2", "", "mention_context", [("f", None, None, None, "U1", "gen", None)]), (5, "U1", "see", None, [(None, None, "T", None, None, None, "u"), (None, None, None, "x", None, None, None)])]
    df = spark.createDataFrame(rows, f"i int, user_id string, text string, subtype string, attachments {att}")
    got = {r.i: r.line for r in rendering.message_lines(df, people(spark), ["i"]).collect()}
    assert got == {0: "[Ann]: hi @Bo", 1: "[Bot]: built", 2: "[CONTEXT] [Unknown]: old", 3: "[U9]: [no text]",
                   4: '[PRIOR CONTEXT] [Bo] shared:\n[Shared message from Ann in #gen]: "f"', 5: '[Ann]: see\n[Shared link]: "T"'}


DAY = 24 * 60


@pytest.fixture(scope="module")
def build(spark, chat):
    def make(rows, model=None, **more):
        msgs = chat(rows)
        span = spark.createDataFrame([("U1", "p", DAY * MIN, 2 * DAY * MIN - 1000, "UTC")], "owner_id string, period_no string, start_us long, end_us long, tz string")
        chans = spark.createDataFrame([("C1", "general", False, False, False, False, None), ("D1", None, True, False, False, False, "U2")],
                                      "id string, name string, is_im boolean, is_mpim boolean, is_private boolean, is_group boolean, user string")
        members = spark.createDataFrame([], "channel string, place int, user_id string")
        return summary.UserSummaries(msgs, span, people(spark), chans, members, "https://acme.slack.com", model, **more)

    return make


WORK = "Reviewed the deployment plan for the payments service in detail today"


def test_one_conversation_and_a_two_hour_gap(build):
    rows = [(DAY + i, "U1", f"{WORK} part {i}") for i in range(5)]
    first = build(rows).topic_summaries.collect()
    assert len(first) == 1 and (first[0].message_count, first[0].user_messages, first[0].slack_link) == (5, 5, f"https://acme.slack.com/archives/C1/p{DAY * MIN}")
    assert first[0].narrative_summary == "Discussion about reviewed, deployment, plan involving 1 participants."
    later = rows + [(DAY + 124 + i, "U1", f"{WORK} second {i}") for i in range(3)]
    run = build(later)
    assert run.topic_summaries.count() == 2
    assert run.statistics.first().original_conversations == 2


def test_shared_references_merge_and_threads_join(build):
    rows = [(DAY + 1, "U1", f"{WORK} #12"), (DAY + 2, "U1", WORK), (DAY + 3, "U1", WORK),
            (DAY + 200, "U2", f"Question about #12 {WORK}"), (DAY + 201, "U2", "answer please", {"thread": DAY + 200}), (DAY + 202, "U1", f"Answer on #12 {WORK}", {"thread": DAY + 200}),
            (DAY + 800, "U1", f"Something else AB-9 {WORK} {WORK}"), (DAY - 30, "U1", "the day before"), (DAY + 30, "U2", "hello <@U1>", {"channel": "C9"})]
    run = build(rows)
    topics = {r.topic_id: r for r in run.topic_summaries.collect()}
    merged = [t for t in topics.values() if t.segments_merged == 2]
    assert len(merged) == 1 and merged[0].message_count == 6 and merged[0].user_messages == 4
    assert len(merged[0].slack_links) == 2 and sorted(merged[0].participants) == ["@Ann", "@Bo"] and merged[0].references == ["#12"]
    assert len(topics) == 2
    channels = run.channel_summaries.collect()
    assert [(c.channel, c.messages_sent, c.threads) for c in channels] == [("C1", 5, 1)], "a channel with mentions only is left out"
    totals = run.totals.first()
    assert (totals.total_channels, totals.total_messages, totals.mentions_received) == (1, 5, 1)


def test_mention_context_reaches_thread_topics(build):
    rows = [(DAY + 5, "U2", "background one"), (DAY + 6, "U2", "background two"), (DAY + 10, "U2", f"{WORK} <@U1>"), (DAY + 11, "U1", f"on it {WORK}", {"thread": DAY + 10}),
            (DAY + 12, "U1", f"in channel {WORK}")]
    run = build(rows)
    assert sorted((r.msg_id, r.subtype) for r in run.context.filter(F.col("conv_id").contains(":t:")).collect()) == [(0, "mention_context"), (1, "mention_context")]
    lines = [r.line for r in run.topic_lines.orderBy("line_no").collect()]
    assert "[PRIOR CONTEXT] [Bo]: background one" in lines


def test_linked_messages_are_shown(build):
    quoted = 1704067200000000
    rows = [(quoted / MIN, "U2", "the quoted words"), (DAY + 400, "U1", f"see https://acme.slack.com/archives/C1/p{quoted} {WORK}")]
    shown = [r.line for r in build(rows).topic_lines.collect()]
    assert len(shown) == 1 and shown[0].endswith('\n[Shared message from Bo]: "the quoted words"')


def test_model_and_its_failures(build):
    rows = [(DAY + 400 * k, "U1", f"{WORK} AB-{k} {WORK}") for k in range(3)]

    def model(asked):
        return ['{"narrative": "N", "nextActions": ["a"]}' if "Channel: #general" in p else "[]" for p in asked]

    told = build(rows, model).topic_summaries.collect()
    assert len(told) == 3 and {(t.narrative_summary, tuple(t.next_actions), tuple(t.participants)) for t in told} == {("N", ("a",), ())}, "a batch of the wrong length is asked one by one"

    def broken(asked):
        raise RuntimeError("down")

    fallback = build(rows, broken).topic_summaries.collect()
    assert {t.timesheet_entry for t in fallback} == {"Discussed reviewed, deployment, plan"} and {tuple(t.participants) for t in fallback} == {("@Ann",)}


def test_extra_boundaries_split_segments(build):
    rows = [(DAY + i, "U1", f"{WORK} {i}") for i in range(4)]
    cut_second = lambda pairs: pairs.withColumn("is_boundary", F.col("pair_index") == 1).withColumn("confidence", F.lit(0.8))
    assert build(rows, boundaries=cut_second).original.count() == 2


def test_document_and_report(build):
    run = build([(DAY + i, "U1", f"{WORK} {i}") for i in range(2)] + [(DAY + 60, "U2", "hi <@U1>")])
    doc = summary.summary_documents(run, F.lit("now")).first()
    assert doc.metadata.schema_version == "2.0.0" and doc.metadata.request.period_start == "1970-01-02T00:00:00.000"
    assert [(c.channel_name, c.channel_type, len(c.topics), c.consolidation_stats.consolidated_topics) for c in doc.channels] == [("general", "public_channel", 1, 1)]
    text = report.reports(run.topic_summaries, run.channel_summaries, run.totals, run.periods, F.lit(DAY * MIN)).first().report.split("\n")
    assert text[:5] == ["# Slack Activity Summary", "", "**Period:** Friday, January 2, 1970", "**Timezone:** UTC", "**Generated:** January 2, 1970 at 12:00 AM"]
    for line in ("| Messages Sent | 2 |", "## Friday, January 2, 1970", "### #general", "*Public Channel*", "**Activity:** 2 messages sent | 1 mention received", "**12:00 AM - 12:01 AM**",
                 "**Messages:** 2 messages", "**Participants:** @Ann", "**Timesheet:** Discussed reviewed, deployment, plan"):
        assert line in text, line


def test_report_as_lines_is_the_same_report(build, tmp_path, spark):
    rows = [(DAY + i, "U1", f"{WORK} {i} AB-{i}") for i in range(3)] + [(DAY + 400, "U1", f"{WORK} AB-1 <@U2>"), (DAY + 401, "U1", "ok", {"channel": "D1"}), (DAY + 900, "U2", f"{WORK} other <@U1>"),
            (DAY + 901, "U1", "yes", {"thread": DAY + 900}), (DAY - 40, "U2", "before")]
    for some in (rows, []):
        run = build(some or [(9 * DAY, "U2", "elsewhere")])
        parts = run.topic_summaries, run.channel_summaries, run.totals, run.periods, F.lit(DAY * MIN)
        lines = report.report_lines(*parts)
        got = [r.line for r in lines.orderBy("line_no").collect()]
        assert got == report.reports(*parts).first().report.split("\n")
        assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(len(got)))
    report.write_report_lines(lines, f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report/owner_id=U1").select("value").collect()] == got


def test_days_are_clamped_into_the_period(spark):
    topics = spark.createDataFrame([("U1", "p", "C1", t * MIN) for t in (0, DAY + 5, 9 * DAY)], "owner_id string, period_no string, channel string, start_us long")
    span = spark.createDataFrame([("U1", "p", DAY * MIN, 3 * DAY * MIN - 1000, "UTC")], "owner_id string, period_no string, start_us long, end_us long, tz string")
    bare = spark.createDataFrame([("U1", "p", "C1"), ("U1", "p", "C2")], "owner_id string, period_no string, channel string")
    got = sorted((r.channel, str(r.day)) for r in report.topics_by_day(topics, span, bare).collect())
    assert got == [("C1", "1970-01-02"), ("C1", "1970-01-02"), ("C1", "1970-01-03"), ("C2", "1970-01-02")]


def test_condensed(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["u"], 2)], "key_events array<string>, slack_links array<string>, segments_merged int")
    row = summary.condense(df).first()
    assert row.asDict() == {"key_events": ["a", "b", "c"]}


def test_participants_of_a_thread_are_listed_once_for_all_its_owners(spark, chat):
    """Six owners of one thread: one set of six, not six lists; an author of context is added, a user the directory has twice counts twice."""
    owners = [f"U{i}" for i in range(1, 7)]
    rows = [(DAY + 100, "U1", f"Question {WORK}")] + [(DAY + 100 + i, u, f"Answer {WORK} {WORK}", {"thread": DAY + 100}) for i, u in enumerate(owners)]
    rows += [(DAY + 800, "U1", f"Something else {WORK} {WORK}"), (DAY + 790, "U7", "before that")]
    span = spark.createDataFrame([(u, "p", DAY * MIN, 2 * DAY * MIN - 1000, "UTC") for u in owners], "owner_id string, period_no string, start_us long, end_us long, tz string")
    chans = spark.createDataFrame([("C1", "general", False, False, False, False, None)], "id string, name string, is_im boolean, is_mpim boolean, is_private boolean, is_group boolean, user string")
    known = spark.createDataFrame([("U1", "Ann"), ("U2", "Bo"), ("U2", "Bob")], "user_id string, shown_name string")
    run = summary.UserSummaries(chat(rows), span, known, chans, spark.createDataFrame([], "channel string, place int, user_id string"), "https://acme.slack.com")
    assert run.set_people.count() == 6
    topics = [(r.owner_id, r.start_us // MIN - DAY, tuple(r.participants), r.narrative_summary) for r in run.topic_summaries.collect()]
    threads = [t for t in topics if t[1] <= 100]
    assert len(threads) >= 6 and all(set(t[2]) >= {"@Ann", "@Bo", "@Bob", "@U3", "@U6"} and len(t[2]) == 7 and t[3].endswith("7 participants.") for t in threads)
    assert [t[2] for t in topics if t[1] > 700] == [("@Ann", "@U7")]
