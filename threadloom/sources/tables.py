"""State tables: latest-wins upserts on partitioned Parquet, the ingest ledger, vectors, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.functions.clock import day_bucket
from threadloom.functions.predicates import channel_type
from threadloom.session import cut_lineage

MESSAGE_KEY = ("channel", "ts_us")
# The channel is part of the reaction key: a time stamp is unique only inside its channel.
REACTION_KEY = ("owner_id", "channel", "msg_id", "reaction")
MENTION_KEY = ("owner_id", "channel", "ts_us")
LEDGER_KEY = ("owner_id", "channel", "day", "data_type")
VECTOR_KEY = ("text_hash", "model")


def latest_wins(rows: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """The newest row per key. ``max_by`` is a partial aggregate, so a key with very many versions is reduced before the
    shuffle; a ranking window would gather it."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def message_rows(messages: DataFrame, fetched_at: Column, tz: str = "UTC") -> DataFrame:
    """Messages as stored: day bucket, kind, raw record and fetch time."""
    reply = F.coalesce(F.col("thread_us") != F.col("ts_us"), F.lit(False))
    raw = F.to_json(F.struct(*messages.columns))
    return messages.withColumn("raw_json", raw).withColumn("message_type", F.when(reply, "thread_reply").otherwise("message")).withColumn(
        "day_bucket", day_bucket("ts_us", tz)).withColumn("fetched_at", fetched_at)


def channel_rows(channels: DataFrame, updated_at: Column) -> DataFrame:
    return channels.withColumn("type", channel_type()).withColumn("updated_at", updated_at)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], version: Sequence[str], partition: str | None = None) -> None:
    """Merge rows into a Parquet table. With a partition column only the partitions that get new rows are read and replaced.

    The merged rows are checkpointed before the write, so a retried task never reads files that are being replaced.
    """
    new = cut_lineage(new)
    old = read_table(spark, path)
    merged = new
    if old is not None:
        if partition:
            # The list of touched partitions is a distinct column of the batch; it prunes the scan.
            old = old.join(new.select(partition).distinct(), partition, "left_semi")
        merged = old.select(*new.columns).unionByName(new)
    writer = cut_lineage(latest_wins(merged, keys, version)).write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or ``None`` when nothing has been written yet. Partition values stay text."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.option("basePath", path).parquet(path)


def truncate(spark: SparkSession, path: str) -> None:
    """Empty a table and keep its schema."""
    rows = read_table(spark, path)
    if rows is not None:
        cut_lineage(rows.limit(0)).write.mode("overwrite").parquet(path)


def ledger_rows(done: DataFrame, fetched_at: Column) -> DataFrame:
    return done.select(*LEDGER_KEY, fetched_at.alias("fetched_at"))


def missing_days(wanted: DataFrame, ledger: DataFrame, today: Column | str, whole_range: Sequence[str] = ()) -> DataFrame:
    """Wanted ``(owner, channel, day, data_type)`` rows that must be fetched; today never counts as complete.

    With ``whole_range`` keys, one missing day makes all days of that range missing.
    """
    now = F.lit(today) if isinstance(today, str) else today
    missing = wanted.join(ledger.filter(F.col("day") < now).select(*LEDGER_KEY), list(LEDGER_KEY), "left_anti")
    if whole_range:
        return wanted.join(missing.select(*whole_range).distinct(), list(whole_range), "left_semi")
    return missing


def vector_rows(vectors: DataFrame, model: str, created_at: Column) -> DataFrame:
    """``(text_hash, embedding)`` rows as stored, in single precision."""
    return vectors.select("text_hash", F.lit(model).alias("model"), F.col("embedding").cast("array<float>").alias("embedding"),
                          F.size("embedding").alias("dimensions"), created_at.alias("created_at"))


def drop_vectors(vectors: DataFrame, text_hash: str | None = None) -> DataFrame:
    """The vector table without one text, or without any."""
    return vectors.filter(F.col("text_hash") != text_hash) if text_hash else vectors.limit(0)


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and first and last day bucket per table, one aggregate each."""
    parts = []
    for name, rows in tables.items():
        day = F.col("day_bucket") if "day_bucket" in rows.columns else F.lit(None).cast("string")
        parts.append(rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.min(day).alias("oldest"), F.max(day).alias("newest")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
