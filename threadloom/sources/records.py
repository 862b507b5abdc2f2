"""Reading exported chat records with declared schemas; malformed records go to a quarantine table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from threadloom.functions.clock import local_day, ts_string_to_us

BAD = "_bad"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ATTACHMENT = T.StructType(_strings("fallback", "text", "pretext", "title", "title_link", "author_name", "author_id", "channel_name",
                                   "channel_id", "from_url", "footer"))
REACTION = T.StructType([*_strings("name"), T.StructField("count", T.LongType()), T.StructField("users", T.ArrayType(T.StringType()))])
MESSAGE = T.StructType([
    *_strings("channel", "ts", "user", "text", "type", "subtype", "thread_ts"), T.StructField("reply_count", T.LongType()),
    T.StructField("reply_users_count", T.LongType()), *_strings("latest_reply"),
    T.StructField("reactions", T.ArrayType(REACTION)), T.StructField("attachments", T.ArrayType(ATTACHMENT))])
CHANNEL = T.StructType([
    *_strings("id", "name"), *[T.StructField(n, T.BooleanType()) for n in
                               ("is_channel", "is_group", "is_im", "is_mpim", "is_private", "is_member")],
    T.StructField("num_members", T.LongType()), *_strings("user"), T.StructField("members", T.ArrayType(T.StringType()))])
USER = T.StructType([*_strings("id", "user_id", "name", "real_name", "display_name"), T.StructField("is_bot", T.BooleanType()),
                     T.StructField("deleted", T.BooleanType())])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records with every field parsed. A JSON scan checks only the columns a query asks for, so whether a record is malformed would
    depend on the query; parsing the line as an expression with options keeps the whole schema."""
    fields = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(F.from_json("value", fields, options).alias("_r")).select("_r.*")


def _split(rows: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined ones. A row is good when it parsed and its required fields are there."""
    good = F.col(BAD).isNull()
    for name in needed:
        good = good & F.col(name).isNotNull()
    return rows.filter(good).drop(BAD), rows.filter(~good)


def normalize_messages(rows: DataFrame, tz: str = "UTC") -> DataFrame:
    """Defaults and derived time columns of message records."""
    filled = rows.na.fill({"text": "", "type": "message"})
    ts_us = ts_string_to_us("ts")
    return (filled.withColumn("ts_us", ts_us).withColumn("thread_us", ts_string_to_us("thread_ts")).withColumn("event_time", F.timestamp_micros(ts_us))
            .withColumn("day", local_day(ts_us, tz)).withColumnRenamed("user", "user_id").withColumn("msg_id", F.col("ts")))


def read_messages(spark: SparkSession, path: str, channel: str | None = None, start_us: int | None = None, end_us: int | None = None,
                  tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Messages and quarantine of a JSON export; ``channel`` is stamped on records of one channel's file."""
    rows = _read(spark, path, MESSAGE)
    if channel is not None:
        rows = rows.withColumn("channel", F.lit(channel))
    good, bad = _split(rows, ["channel", "ts"])
    good = normalize_messages(good, tz)
    if start_us is not None and end_us is not None:
        good = good.filter(F.col("ts_us").between(start_us, end_us))
    return good, bad


def read_channels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _split(_read(spark, path, CHANNEL), ["id"])


def read_users(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """User records and quarantine. The key is ``id``; tables written with ``user_id`` are read too."""
    rows = _read(spark, path, USER).withColumn("user_id", F.coalesce("id", "user_id")).drop("id")
    good, bad = _split(rows, ["user_id"])
    return good.withColumn("name", F.coalesce("name", "user_id")), bad
