"""Gap sessionisation on streams; the same code runs on a batch table.

Single messages never meet by key alone. They are first reduced to one row per key and time slot as wide as the gap, by a session window
inside ``(key, slot)`` with a partial step before its exchange. Every message is also shown to the slot before its own, so a slot knows
whether its session goes on there, and leaves the window when the watermark has passed the end that the session has in those two slots.
The second step keeps one open session per key, gets slots only, and tells the session with its last slot: as soon as the watermark is a
gap past the session's end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.functions.clock import minutes, slot

STORE = "spark.sql.streaming.stateStore.providerClass"
LOCAL = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_rollup(messages: DataFrame, keys: Sequence[str], gap_minutes: float = 60.0, watermark: str | None = None) -> DataFrame:
    """``(keys..., start_us, end_us, message_count)`` of sessions; a gap of exactly the width splits.

    On a stream (columns ``event_time`` and ``ts_us``) a session comes out once, after it was closed; rows later than the watermark are left
    out, and a stream without a watermark closes nothing.
    """
    if not messages.isStreaming:
        return _from_slots(messages, keys, minutes(gap_minutes))
    source = messages.withWatermark("event_time", watermark) if watermark else messages
    return _streamed(source, list(keys), minutes(gap_minutes))


def _from_slots(messages: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """Sessions of a table: slots are merged by windows as long as the slot's own span and the gap."""
    slots = messages.groupBy(*keys, F.floor(F.col("ts_us") / gap_us).alias("_slot")).agg(
        F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    span = F.concat((F.col("_hi") - F.col("_lo") + gap_us - 1).cast("string"), F.lit(" microseconds"))
    return slots.withColumn("_at", F.timestamp_micros("_lo")).groupBy(*keys, F.session_window("_at", span)).agg(
        F.min("_lo").alias("start_us"), F.max("_hi").alias("end_us"), F.sum("_n").alias("message_count"))


def use_rocks(spark: SparkSession) -> None:
    """Named state needs this store; a session that has chosen it, or another one that can, is left alone."""
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)


def _streamed(source: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    use_rocks(source.sparkSession)
    # Sessions of a slot meet as one row of each task.
    source.sparkSession.conf.set(LOCAL, "true")
    here = slot(F.unix_micros("event_time"), gap_us)
    places = F.array(F.struct(here.alias("window"), F.lit(True).alias("own")), F.struct((here - 1).alias("window"), F.lit(False).alias("own")))
    shown = source.select(*keys, "event_time", "ts_us", F.explode(places).alias("_in")).select(*keys, "event_time", "ts_us", F.col("_in.window").alias("_window"), F.col("_in.own").alias("_own"))
    slots = shown.groupBy(*keys, "_window", F.session_window("event_time", f"{gap_us - 1} microseconds")).agg(
        F.min(F.when(F.col("_own"), F.col("ts_us"))).alias("_lo"), F.max(F.when(F.col("_own"), F.col("ts_us"))).alias("_hi"),
        F.count_if("_own").alias("_n"), F.max(~F.col("_own")).alias("_goes_on"))
    closed = slots.filter("_n > 0").select(*keys, "_lo", "_hi", "_n", "_goes_on")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema.fields)
    return closed.groupBy(*keys).transformWithState(
        OpenSession(keys), f"{types}, start_us long, end_us long, message_count long", outputMode="append", timeMode="none")


class OpenSession(StatefulProcessor):
    """The open session of one key: ends and count. A slot comes after those before it in its session, or with them."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start_us long, end_us long, message_count long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = tuple(self.open.get()) if self.open.exists() else None
        for lo, hi, n, goes_on in sorted((r["_lo"], r["_hi"], r["_n"], r["_goes_on"]) for r in rows):
            now = (lo, hi, n) if now is None else (now[0], max(now[1], hi), now[2] + n)
            if not goes_on:
                yield Row(**dict(zip(self.keys, key)), start_us=now[0], end_us=now[1], message_count=now[2])
                now = None
        if now is not None:
            self.open.update(now)
        elif self.open.exists():
            self.open.clear()

    def close(self) -> None:
        pass
