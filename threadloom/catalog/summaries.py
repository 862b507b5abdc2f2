"""Queries that describe topics: prompts, answers, summaries, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.catalog.activity import PEOPLE, people, periods_of
from threadloom.catalog.consolidation import SCOPE, TO_TOPICS, Consolidation
from threadloom.catalog.registry import query
from threadloom.catalog.sql import MSGS, with_
from threadloom.catalog.user_sql import ANSWERED, DOCUMENTS, REPORT, TO_DOCUMENTS, TO_NAMED, TO_USER_TOPICS
from threadloom.functions import rendering
from threadloom.operators import folds, segments, words
from threadloom.plans import prompts, report, summary
from threadloom.session import stored
from threadloom.sources.event_feed import CHAT_BASE, channels, messages, table, with_reactions

TOPIC = ["channel", "topic_id"]
TOPIC_MESSAGES = """
tm AS (SELECT tp.topic_id, m.* FROM cmsg m JOIN tp USING (conv_id)),
tpart AS (SELECT channel, topic_id, count(DISTINCT user_id) AS participant_count FROM tm GROUP BY 1, 2)"""


def topic_messages(c: Consolidation) -> DataFrame:
    return c.kept_msgs.join(c.members, [*SCOPE, "conv_id"])


def participant_counts(c: Consolidation) -> DataFrame:
    """``(channel, topic_id, participant_count)``, from the authors of conversations; topics without one are left out."""
    return c.people.join(c.members, [*SCOPE, "conv_id"]).select(*TOPIC, "user_id").distinct().groupBy(*TOPIC).agg(F.count(F.lit(1)).alias("participant_count"))


@query("fallback_summary", with_(*TO_TOPICS, TOPIC_MESSAGES, recursive=True) + r"""
, w AS (SELECT channel, topic_id, ts_us, msg_id, unnest(string_split_regex(lower(text), '[\s\x{A0}\x{FEFF}\p{Z}]+')) AS w, generate_subscripts(string_split_regex(lower(text), '[\s\x{A0}\x{FEFF}\p{Z}]+'), 1) AS pos FROM tm),
c AS (SELECT channel, topic_id, regexp_replace(w, '[^a-z]', '', 'g') AS word, min((ts_us, msg_id, pos)) AS first, count(*) AS n FROM w GROUP BY 1, 2, 3),
s AS (SELECT unnest(string_split('""" + " ".join(words.STOP_WORDS) + r"""', ' ')) AS stop),
k AS (SELECT *, row_number() OVER (PARTITION BY channel, topic_id ORDER BY n DESC, first) AS r FROM c WHERE length(word) > 3 AND word NOT IN (SELECT stop FROM s) QUALIFY r <= 3),
g AS (SELECT channel, topic_id, string_agg(word, ', ' ORDER BY r) AS words FROM k GROUP BY 1, 2)
SELECT p.channel, p.topic_id, CASE WHEN words IS NULL THEN 'General discussion with '||participant_count||' participants.' ELSE 'Discussion about '||words||' involving '||participant_count||' participants.' END AS narrative,
  CASE WHEN words IS NULL THEN 'Participated in team discussion' ELSE 'Discussed '||words END AS timesheet_entry FROM tpart p LEFT JOIN g USING (channel, topic_id)""")
def fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topic_messages(Consolidation(spark, sf_dir))
    found = words.top_words(rows, TOPIC, ["ts_us", "msg_id"]).groupBy(*TOPIC).agg(rendering.in_order(["rank"], "word").alias("words"))
    counts = segments.roll_up(rows, TOPIC).select(*TOPIC, "participant_count")
    listed = F.coalesce("words", F.array().cast("array<string>"))
    return counts.join(found, TOPIC, "left").select(*TOPIC, prompts.fallback_narrative(listed, F.col("participant_count")).alias("narrative"),
                                                    prompts.fallback_entry(listed).alias("timesheet_entry"))


@query("topic_batches", with_(*TO_TOPICS, recursive=True) + """
, n AS (SELECT channel, topic_id, row_number() OVER (PARTITION BY channel ORDER BY start_us, topic_id) - 1 AS n FROM topic), b AS (SELECT channel, topic_id, n // 5 AS batch_no, n % 5 + 1 AS place_in_batch FROM n)
SELECT *, count(*) OVER (PARTITION BY channel, batch_no) <= 2 AS single FROM b""")
def topic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.topic_batches(Consolidation(spark, sf_dir).topics.select(*TOPIC, "start_us"), SCOPE, ["start_us", "topic_id"]).drop("start_us")


PROMPT_SQL = """
ln AS (SELECT tm.channel, topic_id, row_number() OVER (PARTITION BY tm.channel, topic_id ORDER BY ts_us, msg_id, conv_id) AS r, '['||CASE WHEN subtype='bot_message' OR tm.user_id IS NULL THEN 'Bot' ELSE coalesce(p.shown_name, tm.user_id) END||']: '||
  CASE WHEN q.shown_name IS NULL THEN text ELSE replace(text, '<@'||u||'>', '@'||q.shown_name) END AS line
  FROM (SELECT *, regexp_extract(text, '<@(U[A-Z0-9]+)>', 1) AS u FROM tm) tm LEFT JOIN people p ON p.user_id=tm.user_id LEFT JOIN people q ON q.user_id=tm.u),
tx AS (SELECT channel, topic_id, string_agg(line, chr(10) ORDER BY r) AS messages_text FROM ln WHERE r <= 50 GROUP BY 1, 2),
rf AS (SELECT c.channel, tp.topic_id, string_agg(DISTINCT r.value, ', ' ORDER BY r.value) AS refs FROM cmsg c JOIN refs r USING (msg_id) JOIN tp USING (conv_id) GROUP BY 1, 2)"""


@query("prompt_table", with_(*TO_TOPICS, TOPIC_MESSAGES, PEOPLE, PROMPT_SQL, recursive=True) + f"""
SELECT t.channel, t.topic_id, concat_ws(chr(10), 'Channel: #'||t.channel||CASE WHEN has_threads THEN ' (includes thread replies)' ELSE '' END,
  'Time Range: '||strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%S.%g')||' to '||strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%S.%g'), 'Total Messages: '||message_count,
  'Participants: '||participant_count, 'Detected references: '||refs, 'Messages:', messages_text, '{prompts.GROUP_TASK.replace("{owner}", "the team")}') AS prompt
FROM topic t JOIN tpart USING (channel, topic_id) JOIN tx USING (channel, topic_id) LEFT JOIN rf USING (channel, topic_id)""")
def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per topic of every channel, with the first fifty messages of the topic."""
    c = Consolidation(spark, sf_dir)
    rows = topic_messages(c).select(*TOPIC, "conv_id", "msg_id", "ts_us", "user_id", "subtype", "text")
    from threadloom.operators.ordered import first_n
    head = first_n(rows, TOPIC, ["ts_us", "msg_id", "conv_id"], prompts.GROUP_LINES, "line_no")
    lines = rendering.message_lines(head, people(spark, sf_dir), [*TOPIC, "line_no"])
    texts = lines.groupBy(*TOPIC).agg(F.array_join(rendering.in_order(["line_no"], "line"), "\n").alias("messages_text"))
    shared = c.conv_refs.join(c.members, [*SCOPE, "conv_id"]).select(*TOPIC, "value").distinct().groupBy(*TOPIC).agg(F.array_sort(F.collect_list("value")).alias("shared_refs"))
    full = c.topics.join(texts, TOPIC).join(participant_counts(c), TOPIC, "left").join(shared, TOPIC, "left").withColumns({
        "participant_count": F.coalesce("participant_count", F.lit(0)),
        "shared_refs": F.coalesce("shared_refs", F.array().cast("array<string>")), "owner_name": F.lit("the team"), "channel_name": F.col("channel"),
        "has_context": F.lit(False), "start_text": rendering.iso_time(F.col("start_us"), "UTC"), "end_text": rendering.iso_time(F.col("end_us"), "UTC")})
    return full.select(*TOPIC, prompts.group_prompt().alias("prompt"))


@query("topics_by_date", with_(*TO_TOPICS, recursive=True) + """
, s AS (SELECT min(ts_us) + 172800000000 AS a, max(ts_us) - 172800000000 AS b FROM msgs), z AS (SELECT timezone('Asia/Tokyo', make_timestamptz(a))::DATE AS f, timezone('Asia/Tokyo', make_timestamptz(b))::DATE AS l FROM s)
SELECT strftime(greatest(least(timezone('Asia/Tokyo', make_timestamptz(start_us))::DATE, l), f), '%Y-%m-%d') AS day, channel, count(*) AS topics, sum(message_count)::BIGINT AS messages FROM topic, z GROUP BY 1, 2""")
def topics_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics per local day of a period that is two days shorter than the table at both ends."""
    c = Consolidation(spark, sf_dir)
    two_days = 2 * 86_400_000_000
    span = messages(spark, sf_dir).agg((F.min("ts_us") + two_days).alias("start_us"), (F.max("ts_us") - two_days).alias("end_us")).select(
        F.lit("all").alias("owner_id"), F.lit("all").alias("period_no"), F.lit("Asia/Tokyo").alias("tz"), "start_us", "end_us")
    named = c.topics.withColumn("owner_id", F.lit("all")).withColumn("period_no", F.lit("all"))
    return report.topics_by_day(named, span).groupBy(F.col("day").cast("string").alias("day"), "channel").agg(
        F.count(F.lit(1)).alias("topics"), F.sum("message_count").alias("messages"))


@query("condensed", with_(*TO_TOPICS, recursive=True) + """
, v AS (SELECT DISTINCT c.channel, tp.topic_id, r.value FROM cmsg c JOIN refs r USING (msg_id) JOIN tp USING (conv_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY channel, topic_id ORDER BY value) AS n FROM v)
SELECT channel, topic_id, string_agg(value, ', ' ORDER BY n) AS key_events FROM k WHERE n <= 3 GROUP BY 1, 2""")
def condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short form of topics whose key events are their references in order."""
    c = Consolidation(spark, sf_dir)
    listed = c.conv_refs.join(c.members, [*SCOPE, "conv_id"]).select(*TOPIC, "value").distinct().groupBy(*TOPIC).agg(F.array_sort(F.collect_list("value")).alias("key_events"))
    full = listed.withColumn("slack_links", F.lit(None).cast("array<string>")).withColumn("segments_merged", F.lit(1))
    return summary.condense(full).select(*TOPIC, F.array_join("key_events", ", ").alias("key_events"))


ANSWERS = """
an AS (SELECT msg_id, CASE msg_id % 6 WHEN 0 THEN 'Here it is: {"narrative": "'||text||'", "keyEvents": ["a", "b"], "outcome": null, "timesheetEntry": "Did '||msg_id||'"} as asked'
  WHEN 1 THEN '{"keyEvents": ["only"]}' WHEN 2 THEN 'no json at all' WHEN 3 THEN '{"narrative": "broken' WHEN 4 THEN '{"narrative": "x" "outcome": "shipped"}'
  ELSE '{"narrative": "'||text||'", "outcome": "shipped"}' END AS response FROM msgs)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("msg_id"), F.col("text")
    q = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    body = (F.when(n % 6 == 0, q('Here it is: {"narrative": "', text, '", "keyEvents": ["a", "b"], "outcome": null, "timesheetEntry": "Did ', n.cast("string"), '"} as asked'))
            .when(n % 6 == 1, '{"keyEvents": ["only"]}').when(n % 6 == 2, "no json at all").when(n % 6 == 3, '{"narrative": "broken')
            .when(n % 6 == 4, '{"narrative": "x" "outcome": "shipped"}').otherwise(q('{"narrative": "', text, '", "outcome": "shipped"}')))
    return messages(spark, sf_dir).select("msg_id", body.alias("response"))


@query("response_parse", with_(MSGS, ANSWERS) + """
, j AS (SELECT msg_id, CASE WHEN json_valid(regexp_extract(response, '(?s)\\{.*\\}')) AND regexp_extract(response, '(?s)\\{.*\\}') <> '' THEN regexp_extract(response, '(?s)\\{.*\\}') END AS b FROM an)
SELECT msg_id, b IS NOT NULL AS parsed, CASE WHEN b IS NOT NULL THEN coalesce(json_extract_string(b, '$.narrative'), 'Discussion summary unavailable') END AS narrative,
  CASE WHEN b IS NOT NULL THEN coalesce(json_array_length(b, '$.keyEvents'), 0)::BIGINT END AS key_events, json_extract_string(b, '$.outcome') AS outcome,
  CASE WHEN b IS NOT NULL THEN coalesce(json_extract_string(b, '$.timesheetEntry'), 'Activity summary') END AS timesheet_entry FROM j""")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("s", prompts.parse_summary("response"))
    return rows.select("msg_id", F.col("s").isNotNull().alias("parsed"), F.col("s.narrative").alias("narrative"),
                       F.when(F.col("s").isNotNull(), F.size("s.keyEvents")).alias("key_events"), F.col("s.outcome").alias("outcome"), F.col("s.timesheetEntry").alias("timesheet_entry"))


@query("boundary_parse", """
WITH p AS (SELECT conv_id, row_number() OVER w - 1 AS pair_index, lead(role) OVER w = 'user' AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY b IS NOT NULL)
SELECT conv_id, pair_index, CASE WHEN conv_id % 4 = 0 THEN false ELSE b END AS is_boundary, CASE WHEN conv_id % 4 = 0 THEN 0.5 ELSE 0.8 END AS confidence FROM p""")
def boundary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the boundary prompts of all conversations; every fourth conversation gets an unreadable one."""
    turns = table(spark, sf_dir, "conversations").withColumn("msg_id", F.col("turn"))
    pairs = segments.message_pairs(turns, ["conv_id"], ts="turn", width_us=1000)
    roles = turns.select("conv_id", F.col("turn").alias("second_ts"), (F.col("role") == "user").alias("_b"))
    batched = pairs.join(roles, ["conv_id", "second_ts"]).withColumn("batch_no", F.floor(F.col("pair_index") / F.lit(prompts.PAIR_BATCH)).cast("long"))
    entry = F.struct((F.col("pair_index") + 1).alias("index"), F.col("_b").alias("boundary"))
    answered = batched.groupBy("conv_id", "batch_no").agg(
        F.count(F.lit(1)).alias("pairs"), F.concat(F.lit("Answer: "), F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e))).alias("response"))
    answered = answered.withColumn("response", F.when(F.col("conv_id") % 4 == 0, "cannot say").otherwise(F.col("response")))
    return prompts.parse_boundaries(answered, ["conv_id"])


@query("pair_scores", """
WITH p AS (SELECT conv_id, row_number() OVER w - 1 AS pair_index, text AS a, lead(text) OVER w AS b, lead(turn) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY t IS NOT NULL),
q AS (SELECT *, list_distinct(string_split_regex(lower(a), '\\W+')) AS x, list_distinct(string_split_regex(lower(b), '\\W+')) AS y FROM p)
SELECT conv_id, pair_index, len(list_intersect(x, y)) / len(list_distinct(x || y)) <= 0.1 AS is_boundary FROM q""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in boundary rule: word overlap of adjacent messages."""
    turns = table(spark, sf_dir, "conversations").withColumn("msg_id", F.col("turn"))
    pairs = segments.message_pairs(turns, ["conv_id"], ts="turn", width_us=1000)
    return prompts.score_pairs(pairs, least_overlap=0.1).select("conv_id", "pair_index", "is_boundary")


def fixed_model(asked: list[str]) -> list[str]:
    """A text model for demonstrations: names the first line of the prompt."""
    def answer(prompt: str) -> str:
        count = prompt.count("--- Topic ")
        item = {"narrative": "About " + prompt.split("\n", 1)[0], "keyEvents": ["first", "second"], "timesheetEntry": "Worked"}
        return json.dumps([item] * count if count else item)

    return [answer(p) for p in asked]


@query("model_plugin", with_(*TO_NAMED, recursive=True) + ANSWERED)
def model_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of all users described by a text model function."""
    return user_summaries(spark, sf_dir, fixed_model).topic_summaries.select("owner_id", "channel", "topic_id", "narrative_summary", "timesheet_entry")


def user_summaries(spark: SparkSession, sf_dir: str, model: prompts.TextModel | None = None) -> summary.UserSummaries:
    # Every step reads the messages, most of them a few columns.
    msgs = stored(messages(spark, sf_dir), "messages")
    authors = msgs.filter(F.col("user_id").isNotNull()).select("channel", "user_id").distinct()
    place = F.struct(F.length("user_id").alias("l"), F.col("user_id").alias("u"))
    other = authors.groupBy(F.col("channel").alias("id")).agg(F.max_by("user_id", place).alias("user"))
    return summary.UserSummaries(
        with_reactions(msgs), periods_of(msgs), people(spark, sf_dir), channels(msgs).join(other, "id"),
        authors.filter(F.col("channel").startswith("G")).withColumn("place", place), CHAT_BASE, model)


@query("user_topics", with_(*TO_USER_TOPICS, recursive=True) + """
SELECT owner_id, channel, topic_id, narrative_summary, start_us, end_us, message_count, user_messages, timesheet_entry, 'https://acme.slack.com/archives/'||channel||'/p'||start_us AS slack_link FROM utopic""")
def user_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of every user in their period, described without a model."""
    return user_summaries(spark, sf_dir).topic_summaries.select(
        "owner_id", "channel", "topic_id", "narrative_summary", "start_us", "end_us", "message_count", "user_messages", "timesheet_entry", "slack_link")


@query("summary_doc", with_(*TO_DOCUMENTS, recursive=True) + ", " + DOCUMENTS.strip())
def summary_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per user, read back from its text: a row per topic, or per channel or user without one."""
    docs = summary.summary_documents(user_summaries(spark, sf_dir), F.lit("2024-02-01T00:00:00.000")).select("metadata", "summary", "channels")
    text = docs.select(F.to_json(F.struct("metadata", "summary", "channels")).alias("document"))
    # Topics become a column of their own, so that no row carries those of others.
    read = text.select(F.from_json("document", docs.schema).alias("d")).select("d.metadata", "d.summary", F.inline_outer("d.channels")).select("*", F.explode_outer("topics").alias("t"))
    stats = ["original_segments", "consolidated_topics"] + [F.col(f"consolidation_stats.{a}").alias(b) for a, b in (
        ("bot_messages_merged", "bots_merged"), ("trivial_messages_merged", "trivial_merged"), ("adjacent_merged", "adjacent_merged"),
        ("proximity_merged", "proximity_merged"), ("same_author_merged", "same_author_merged"))]
    stats[:2] = [F.col(f"consolidation_stats.{n}").alias(n) for n in stats[:2]]
    return read.select(
        F.col("metadata.request.user_id").alias("owner_id"), "metadata.request.period_start", "metadata.request.period_end", "metadata.request.timezone", "metadata.schema_version", "summary.*",
        "channel_id", "channel_name", "channel_type", "interactions.messages_sent", F.col("interactions.mentions_received").alias("channel_mentions"), "interactions.threads", *stats,
        "t.narrative_summary", "t.start_time", "t.end_time", "t.message_count", "t.user_messages", F.array_join("t.participants", ", ").alias("participants"),
        F.array_join("t.references", ", ").alias("refs"), "t.timesheet_entry", "t.slack_link", "t.segments_merged")


@query("report_lines", with_(*TO_DOCUMENTS, recursive=True) + ", " + REPORT.strip())
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown report per user, line by line."""
    run = user_summaries(spark, sf_dir)
    lines = report.report_lines(run.topic_facts, run.channel_facts, run.totals, run.periods, F.lit(1_706_745_600_000_000), run)
    return lines.select("owner_id", "line_no", "line")
