"""Chat tables derived from the driver's ``events`` and ``customer`` tables.

The reference inputs hold no chat messages, so one deterministic view turns every event into a message.
Every row of the source becomes one row of the view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.functions.clock import DAY_US, ntz_to_us, slot

CHAT_BASE = "https://acme.slack.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages ``(msg_id, channel, ts_us, user_id, subtype, text, thread_us, event_type)``."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), ntz_to_us("ts").alias("ts_us"), "event_type", F.col("user_id").alias("uid"))
    last_digit = F.col("uid") % 10
    letter = F.when(last_digit == 9, "D").when(last_digit == 8, "G").otherwise("C")
    issue, project = (F.col("msg_id") % 40).cast("string"), (F.col("msg_id") % 25).cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "purchase", F.concat(F.lit("Reviewed #"), issue, F.lit(" for PROJ-"), project))
        .when(kind == "error", F.concat(F.lit("<@U"), (F.col("uid") * 7) % 150,
                                        F.lit("> TimeoutError in payments-api, 500 error on #"), issue))
        .when(kind == "signup", F.concat(F.lit("Build #"), issue, F.lit(" passed")))
        .when(kind == "click", F.when(F.col("msg_id") % 2 == 0, "ok").otherwise("confirmed"))
        .otherwise(F.concat(F.lit("Planning notes "), (F.col("msg_id") % 97).cast("string"))))
    base = e.select(
        "msg_id", F.concat(letter, last_digit.cast("string")).alias("channel"), "ts_us",
        F.when(~((kind == "signup") & (F.col("msg_id") % 3 == 0)), F.concat(F.lit("U"), F.col("uid").cast("string"))).alias("user_id"),
        F.when(kind == "signup", "bot_message").alias("subtype"), text.alias("text"), "event_type")
    # The first message of a channel and day opens the thread that day's "view" events answer to. A minimum
    # per (channel, day) is partially aggregated, so no day is sorted in one task.
    opened = base.groupBy("channel", slot("ts_us", DAY_US).alias("_day")).agg(F.min("ts_us").alias("_open"))
    return (
        base.withColumn("_day", slot("ts_us", DAY_US)).join(opened, ["channel", "_day"])
        .withColumn("thread_us", F.when(kind == "view", F.col("_open")))
        .select("msg_id", "channel", "ts_us", "user_id", "subtype", "text", "thread_us", "event_type"))


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User directory from ``customer``: some names empty, some users deleted."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("U"), key.cast("string")).alias("user_id"),
        F.concat(F.lit("login"), key.cast("string")).alias("name"),
        F.when(key % 3 == 0, F.col("c_name")).when(key % 3 == 1, F.lit("")).alias("real_name"),
        F.when(key % 2 == 0, F.concat(F.initcap("c_mktsegment"), F.lit(" "), key.cast("string"))).otherwise(F.lit("")).alias("display_name"),
        (key % 11 == 5).alias("deleted"), (key % 17 == 0).alias("is_bot"))


def channels(messages_df: DataFrame) -> DataFrame:
    """Channel records for the channels that occur in a message table."""
    seen = messages_df.groupBy("channel").agg(F.countDistinct("user_id").alias("num_members"))
    first, digit = F.substring("channel", 1, 1), F.substring("channel", 2, 1).cast("int")
    return seen.select(
        F.col("channel").alias("id"),
        F.when(first == "C", F.concat(F.lit("team-"), digit.cast("string")))
        .when(first == "G", F.lit("mpdm-ana.lee--bo.kim--cy-1")).alias("name"),
        (first == "C").alias("is_channel"), (digit == 7).alias("is_group"), (first == "D").alias("is_im"),
        (first == "G").alias("is_mpim"), (digit == 6).alias("is_private"), (digit != 5).alias("is_member"), "num_members")


def reference_texts(messages_df: DataFrame) -> DataFrame:
    """Every message with a link or name of one reference type woven into its text, so all types occur."""
    n = F.col("msg_id").cast("string")
    forms = [
        F.concat(F.lit("see acme/app#"), n), F.concat(F.lit("https://github.com/acme/app/pull/"), n),
        F.concat(F.lit("https://gitlab.com/acme/group/app/-/merge_requests/"), n), F.concat(F.lit("AUTH2-"), n, F.lit(" and x9AB-1")),
        F.concat(F.lit("https://www.figma.com/design/Ab"), n, F.lit("/title")),
        F.concat(F.lit("https://www.notion.so/acme/"), F.md5(n)),
        F.concat(F.lit("https://acme.atlassian.net/wiki/spaces/ENG/pages/"), n, F.lit("/Plan")),
        F.concat(F.lit("https://docs.google.com/document/d/doc_"), n, F.lit("/edit")),
        F.concat(F.lit("https://docs.google.com/spreadsheets/d/sheet-"), n), F.concat(F.lit("https://docs.google.com/presentation/d/p"), n),
        F.concat(F.lit("https://app.asana.com/0/77/"), n), F.concat(F.lit("https://app.clickup.com/t/ab"), n),
        F.concat(F.lit("https://sentry.io/organizations/acme/issues/"), n, F.lit("/")),
        F.concat(F.lit("https://app.datadoghq.com/monitors/m-"), n), F.concat(F.lit("https://acme.pagerduty.com/incidents/Q"), n),
        F.concat(F.lit("https://acme.zendesk.com/agent/tickets/"), n),
        F.concat(F.lit("https://acme.lightning.force.com/lightning/r/Case/"), F.lpad(n, 15, "0"), F.lit("/view")),
        F.concat(F.lit("NullPointerException, Error and 404 status in job "), n), F.concat(F.lit("<@U"), n, F.lit("|sam> and <@W1>")),
        F.concat(F.lit("https://eu.console.aws.amazon.com/cloudwatch/home#logsV2:log-groups/log-group/App_"), n),
        F.concat(F.lit("Billing"), n, F.lit("prd-worker is slow")),
        F.concat(F.lit("https://acme.slack.com/archives/C1/p1704067200"), F.lpad(n, 6, "0"), F.lit("?thread_ts=1 twice")),
    ]
    which = F.col("msg_id") % len(forms)
    extra = F.element_at(F.array(*forms), (which + 1).cast("int"))
    return messages_df.withColumn("text", F.concat("text", F.lit(" "), extra))


def with_reactions(messages_df: DataFrame) -> DataFrame:
    """Messages with a ``reactions`` array; the users follow from the message number."""
    person = lambda k: F.concat(F.lit("U"), ((F.col("msg_id") * k) % 150).cast("string"))
    one = F.struct(F.lit("eyes").alias("name"), F.lit(2).cast("long").alias("count"), F.array(person(3), person(7)).alias("users"))
    two = F.struct(F.lit("done").alias("name"), F.lit(1).cast("long").alias("count"), F.array(person(11)).alias("users"))
    return messages_df.withColumn("reactions", F.when(F.col("event_type") == "purchase", F.array(one, two))
                                  .when(F.col("event_type") == "error", F.array(two)))


def with_links(messages_df: DataFrame) -> DataFrame:
    """Thread replies that quote the message their thread starts with, some of them twice, some into nowhere."""
    opened = F.concat(F.lit(f"{CHAT_BASE}/archives/"), F.col("channel"), F.lit("/p"), F.col("thread_us").cast("string"))
    nowhere = F.lit(f" {CHAT_BASE}/archives/C1/p1")
    return messages_df.withColumn("text", F.when(
        F.col("thread_us").isNotNull(),
        F.concat("text", F.lit(" "), opened, F.when(F.col("msg_id") % 3 == 0, F.concat(F.lit(" "), opened)).otherwise(nowhere)))
        .otherwise(F.col("text")))


def with_attachments(messages_df: DataFrame) -> DataFrame:
    """Messages with attachments of the kinds the line rendering tells apart."""
    n = F.col("msg_id").cast("string")
    none = F.lit(None).cast("string")

    def attachment(**fields):
        names = ("fallback", "text", "title", "author_name", "author_id", "channel_name", "from_url")
        return F.struct(*[fields.get(f, none).alias(f) for f in names])

    shared = attachment(text=F.concat(F.lit("Shared "), n, F.lit(" <@U3>")), author_id=F.concat(F.lit("U"), (F.col("msg_id") % 200).cast("string")),
                        channel_name=F.lit("general"))
    named = attachment(fallback=F.concat(F.lit("Fallback "), F.repeat(F.lit("long "), 70), n), author_name=F.lit("Ana"))
    linked = attachment(title=F.concat(F.lit("Title "), n), from_url=F.lit("https://example.com/x"))
    plain = attachment(text=F.concat(F.lit("Plain "), n))
    return messages_df.withColumn("attachments", F.when(F.col("event_type") == "purchase", F.array(shared, linked, attachment()))
                                  .when(F.col("event_type") == "signup", F.array(named, plain)))
