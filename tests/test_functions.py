import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from threadloom.functions import clock, predicates, references as refs, rendering, similarity

CASES = [
    ("github_issue", "see #12, acme/app#7 and (#8)", ["#12", "#7", "#8"]), ("github_issue", "word#9 #10x", []),
    ("github_url", "https://GitHub.com/a/b/pull/5", ["#5"]), ("gitlab", "gitlab.com/a/b/c/-/merge_requests/3", ["gitlab:3"]), ("gitlab", "gitlab.com/a/-/issues/3", []),
    ("ticket", "AUTH-12 X-1 ab-3", ["AUTH-12"]), ("figma", "figma.com/board/AbC1/x", ["figma:AbC1"]),
    ("notion", "notion.so/w/12345678-1234-1234-1234-1234567890ab", ["notion:123456781234123412341234567890ab"]),
    ("confluence", "x.atlassian.net/wiki/spaces/ENG/pages/77/T", ["confluence:77"]), ("gdoc", "docs.google.com/document/d/a_b-1/edit", ["gdoc:a_b-1"]),
    ("gsheet", "docs.google.com/spreadsheets/d/s1", ["gsheet:s1"]), ("gslide", "docs.google.com/presentation/d/p1", ["gslide:p1"]),
    ("asana", "app.asana.com/0/11/22", ["asana:22"]), ("clickup", "app.clickup.com/t/ab12", ["clickup:ab12"]),
    ("sentry", "sentry.io/organizations/acme/issues/9 sentry.io/acme/issues/8", ["sentry:9", "sentry:8"]), ("datadog", "app.datadoghq.com/apm/a-b", ["datadog:a-b"]),
    ("pagerduty", "acme.pagerduty.com/incidents/Q1", ["pagerduty:Q1"]), ("zendesk", "acme.zendesk.com/agent/tickets/4", ["zendesk:4"]),
    ("salesforce", "acme.my.salesforce.com/x/Case/500A00000012345/view", ["sfdc:500A00000012345"]), ("salesforce", "acme.my.salesforce.com/x/Case/500A", []),
    ("error_pattern", "NullPointerException, a 503 status and Error alone", ["nullpointerexception", "503"]), ("error_pattern", "5000 error", []),
    ("user_mention", "<@U1|ann> <@U2> <@W3>", ["U1", "U2"]), ("aws_log_group", "cloudwatch/home#logsV2:log-groups/log-group$252FApp_1", ["app_1"]),
    ("service_name", "my Billing-API and foo-bar", ["billing-api"]), ("slack_message", "https://a.slack.com/archives/C1/p1234567890123456?x=1", ["slack:C1:1234567890.123456"]),
    ("ticket", "PROJ-1é éPROJ-2", ["PROJ-1", "PROJ-2"]), ("github_issue", "a #5", ["#5"]),
]


def test_every_extractor(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, text string")
    found = {}
    for r in refs.extract(df, "i").collect():
        found.setdefault((r.i, r.type), []).append(r.value)
    for i, (kind, text, want) in enumerate(CASES):
        assert sorted(found.get((i, kind), [])) == sorted(want), (kind, text)
    assert {c[0] for c in CASES} == {e.type for e in refs.EXTRACTORS} | {"slack_message"}


def test_raw_text_and_null_text(spark):
    df = spark.createDataFrame([(0, "x (#4)"), (1, None)], "i int, text string")
    assert [(r.value, r.raw) for r in refs.extract(df, "i").collect()] == [("#4", "(#4")]


def test_mentions_are_kept_but_not_compared(spark):
    df = spark.createDataFrame([(1, "<@U1> PROJ-1"), (1, "PROJ-1")], "c int, text string")
    assert {(r.value, r.comparable) for r in refs.conversation_references(df, ["c"]).collect()} == {("U1", False), ("PROJ-1", True)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*v):
    return F.array(*[F.lit(x) for x in v]).cast("array<float>")


def test_cosine(spark):
    assert one(spark, similarity.cosine(vec(1, 2), vec(2, 4))) == pytest.approx(1)
    assert one(spark, similarity.cosine(vec(1, 0), vec(0, 1))) == 0 and one(spark, similarity.cosine(vec(1, 0), vec(-1, 0))) == -1
    assert one(spark, similarity.cosine(vec(0, 0), vec(1, 1))) == 0
    with pytest.raises(PySparkException, match="mismatch"):
        one(spark, similarity.cosine(vec(1.0), vec(1, 1)))


def test_hybrid(spark):
    none = F.lit(None).cast("array<float>")
    assert one(spark, similarity.hybrid(F.lit(0.5), vec(1, 0), vec(1, 0))) == pytest.approx(0.7)
    assert one(spark, similarity.hybrid(F.lit(0.5), vec(1, 0), vec(-1, 0))) == pytest.approx(0.3)
    assert one(spark, similarity.hybrid(F.lit(0.5), vec(1, 0), none)) == 0.5


def test_overlap_scores(spark):
    assert one(spark, similarity.jaccard_from_sizes(F.lit(0), F.lit(0), F.lit(0))) == 0
    assert one(spark, similarity.same_author(F.lit(7), F.lit(7), F.lit(10))) is True, "exactly 0.7"
    assert one(spark, similarity.same_author(F.lit(0), F.lit(1), F.lit(1))) is False
    assert one(spark, similarity.same_author(F.lit(0), F.lit(0), F.lit(0))) is False


def test_times(spark):
    assert one(spark, clock.us_to_ts_string(F.lit(1704067200000100))) == "1704067200.000100"
    assert one(spark, clock.ts_string_to_us(F.lit("1704067200.0001"))) == 1704067200000100 and one(spark, clock.ts_string_to_us(F.lit("x"))) is None
    assert one(spark, clock.day_bucket(F.lit(1704067200000000), "America/New_York")) == "2023-12-31"
    assert one(spark, clock.day_start_us(F.lit("2024-03-10").cast("date"), "America/New_York")) == 1710046800000000
    assert one(spark, clock.day_start_us(F.lit("2024-03-11").cast("date"), "America/New_York")) == 1710129600000000, "a day of 23 hours"
    assert one(spark, clock.slot(F.lit(-1), 10)) == -1
    assert one(spark, rendering.time_range(F.lit(1704067200000000), F.lit(1704070800000000), "UTC")) == "12:00 AM - 1:00 AM"
    assert one(spark, rendering.time_range(F.lit(1704067200000000), F.lit(1704067200000000 + clock.DAY_US), "UTC")) == "Jan 1, 12:00 AM - Jan 2, 12:00 AM"


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, clock.ntz_to_us(F.expr("timestamp_ntz'2024-01-01 00:00:01.5'"))) == 1704067201500000
        assert one(spark, clock.day_bucket(F.lit(1704067200000000))) == "2024-01-01"
        assert one(spark, rendering.long_date(F.lit(1704067200000000), "UTC")) == "Monday, January 1, 2024"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_truncate(spark):
    assert one(spark, rendering.truncate(F.lit("abcdef"), 6)) == "abcdef" and one(spark, rendering.truncate(F.lit("abcdefg"), 6)) == "abc..."


def test_message_flags(spark):
    rows = [("bot_message", "U1", "x", True), (None, None, "x", True), (None, None, "", False), (None, "U1", "x", False)]
    df = spark.createDataFrame(rows, "subtype string, user_id string, text string, want boolean")
    assert df.filter(predicates.is_bot_message() != F.col("want")).count() == 0
    words = spark.createDataFrame([("All DONE.", True), ("undone", False), ("shipping now", True), (None, False)], "text string, want boolean")
    assert words.filter(predicates.has_work_indicator() != F.col("want")).count() == 0
    named = spark.createDataFrame([("hi <@U12>",), ("<@U1|ann> hi",)], "text string")
    assert [r.m for r in named.select(predicates.mentions_user("U1").alias("m")).collect()] == [False, True]


def test_channel_type(spark):
    flags = [(True, None, None, None, "im"), (None, True, True, None, "mpim"), (None, None, None, True, "private_channel"), (None, None, False, None, "public_channel")]
    df = spark.createDataFrame(flags, "is_im boolean, is_mpim boolean, is_private boolean, is_group boolean, want string")
    assert df.filter(predicates.channel_type() != F.col("want")).count() == 0
