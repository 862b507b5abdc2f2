"""Queries on state tables, texts, links and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.catalog.activity import PEOPLE, REACTED, people
from threadloom.catalog.consolidation import TO_TOPICS, Consolidation
from threadloom.catalog.registry import query
from threadloom.catalog.sql import MAIN, MSGS, with_
from threadloom.functions import clock, rendering
from threadloom.operators import collection, links, segments, texts, words
from threadloom.sources import tables
from threadloom.sources.event_feed import CHAT_BASE, channels, messages, table, with_attachments, with_links, with_reactions
from threadloom.streaming import ingest, sessions


@query("upsert_latest", with_(MSGS) + """
SELECT channel, ts_us, 'v'||(CASE WHEN msg_id % 2 = 0 THEN 2 ELSE 1 END)||' '||text AS text, CASE WHEN thread_us <> ts_us THEN 'thread_reply' ELSE 'message' END AS message_type,
  strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day_bucket FROM msgs""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message once and half of them a second time with a later fetch time."""
    base = messages(spark, sf_dir)
    first = tables.message_rows(base.withColumn("text", F.concat(F.lit("v1 "), "text")), F.lit(1))
    again = tables.message_rows(base.withColumn("text", F.when(F.col("msg_id") % 2 == 0, F.concat(F.lit("v2 "), "text")).otherwise(
        F.concat(F.lit("v1 "), "text"))), F.lit(2))
    return tables.latest_wins(first.unionByName(again), tables.MESSAGE_KEY, ["fetched_at"]).select(
        "channel", "ts_us", "text", "message_type", "day_bucket")


@query("mentions_table", with_(MSGS) + """
SELECT DISTINCT channel, ts_us, unnest(regexp_extract_all(text, '<@([^|>]+)(?:\\|[^>]+)?>', 1)) AS owner_id FROM msgs""")
def mentions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collection.mentions(messages(spark, sf_dir)).select("owner_id", "channel", "ts_us")
    return found.unionByName(found).dropDuplicates(list(tables.MENTION_KEY))


@query("reactions_table", with_(MSGS, REACTED) + "SELECT owner_id, channel, msg_id, reaction, max(2) AS fetched_at FROM rea GROUP BY 1, 2, 3, 4")
def reactions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = collection.reactions_given(with_reactions(messages(spark, sf_dir))).select(*tables.REACTION_KEY)
    twice = given.withColumn("fetched_at", F.lit(1)).unionByName(given.withColumn("fetched_at", F.lit(2)))
    return tables.latest_wins(twice, tables.REACTION_KEY, ["fetched_at"])


@query("channels_table", with_(MSGS) + """
SELECT channel AS id, CASE channel[1] WHEN 'D' THEN 'im' WHEN 'G' THEN 'mpim' ELSE CASE WHEN channel[2:] IN ('6','7') THEN 'private_channel' ELSE 'public_channel' END END AS type,
  count(DISTINCT user_id) AS num_members, 2 AS updated_at FROM msgs GROUP BY channel""")
def channels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = channels(messages(spark, sf_dir))
    both = tables.channel_rows(records.withColumn("num_members", F.lit(0).cast("long")), F.lit(1)).unionByName(tables.channel_rows(records, F.lit(2)))
    return tables.latest_wins(both, ["id"], ["updated_at"]).select("id", "type", "num_members", "updated_at")


LEDGER = """
days AS (SELECT DISTINCT user_id AS owner_id, channel, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day, event_type FROM msgs WHERE user_id IS NOT NULL),
want AS (SELECT DISTINCT owner_id, channel, day FROM days), have AS (SELECT DISTINCT owner_id, channel, day FROM days WHERE event_type='click'),
last AS (SELECT max(day) AS today FROM days)"""


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    msgs = messages(spark, sf_dir).filter(F.col("user_id").isNotNull()).select(
        F.col("user_id").alias("owner_id"), "channel", clock.day_bucket("ts_us").alias("day"), F.lit("messages").alias("data_type"), "event_type")
    wanted = msgs.select(*tables.LEDGER_KEY).distinct()
    done = tables.ledger_rows(msgs.filter(F.col("event_type") == "click").distinct(), F.lit(1)).dropDuplicates(list(tables.LEDGER_KEY))
    return wanted, done, msgs.agg(F.max("day").alias("today"))


@query("missing_days", with_(MSGS, LEDGER) + """
SELECT owner_id, channel, day FROM want w WHERE NOT EXISTS (SELECT 1 FROM have h, last WHERE h.owner_id=w.owner_id AND h.channel=w.channel AND h.day=w.day AND h.day < today)""")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, done, today = _ledger(spark, sf_dir)
    day = today.first()["today"]  # one value: the day that is still open
    return tables.missing_days(wanted, done, day).select("owner_id", "channel", "day")


@query("missing_ranges", with_(MSGS, LEDGER) + """
, miss AS (SELECT DISTINCT owner_id FROM want w WHERE NOT EXISTS (SELECT 1 FROM have h, last WHERE h.owner_id=w.owner_id AND h.channel=w.channel AND h.day=w.day AND h.day < today))
SELECT owner_id, channel, day FROM want WHERE owner_id IN (SELECT owner_id FROM miss)""")
def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The all-or-nothing form: one missing day asks for the owner's whole range again."""
    wanted, done, today = _ledger(spark, sf_dir)
    return tables.missing_days(wanted, done, today.first()["today"], ["owner_id"]).select("owner_id", "channel", "day")


@query("table_stats", with_(MSGS, REACTED) + """
SELECT 'messages' AS table_name, count(*) AS row_count, min(d) AS oldest, max(d) AS newest FROM (SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d') AS d FROM msgs)
UNION ALL SELECT 'mentions', count(*), NULL, NULL FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '<@([^|>]+)>', 1))) FROM msgs)
UNION ALL SELECT 'reactions', count(*), NULL, NULL FROM rea UNION ALL SELECT 'channels', count(DISTINCT channel), NULL, NULL FROM msgs""")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = messages(spark, sf_dir)
    return tables.statistics({"messages": tables.message_rows(msgs, F.lit(1)), "mentions": collection.mentions(msgs),
                              "reactions": collection.reactions_given(with_reactions(msgs)), "channels": channels(msgs)})


@query("text_hash", """
SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS text_hash, length(string_agg(text, ' ' ORDER BY turn)) AS n_chars
FROM conversations WHERE text <> '' GROUP BY conv_id""")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.conversation_texts(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "text_hash", "n_chars")


@query("source_text_hash", """
SELECT source, doc_id, sha256(text) AS text_hash, length(text) AS n_chars FROM documents WHERE text <> ''""")
def source_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and length of every document by source, whole texts; a text is one value, so no group is longer than a document."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return docs.select("source", "doc_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("n_chars"))


def _hashed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"), (F.length(F.trim("text")) > 0).alias("has_text"),
                                                    F.substring("text", 1, texts.EMBED_CHARS).alias("embed_text"))
    stored = docs.join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select(
        "text_hash", F.lit("m1").alias("model"), "embedding", F.col("doc_id").alias("created_at"))
    return docs, tables.latest_wins(stored, tables.VECTOR_KEY, ["created_at"])


@query("embedding_reuse", """
WITH d AS (SELECT doc_id, sha256(text) AS text_hash FROM documents), c AS (SELECT text_hash, max(vec_id) AS v FROM d JOIN embeddings ON vec_id=doc_id GROUP BY 1)
SELECT doc_id, d.text_hash, v IS NOT NULL AS cached, round(e.embedding[1]::DOUBLE, 6) AS first_value FROM d LEFT JOIN c USING (text_hash) LEFT JOIN embeddings e ON e.vec_id=v""")
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = _hashed_documents(spark, sf_dir)
    return texts.with_vectors(docs, stored, "m1").select(
        "doc_id", "text_hash", F.col("embedding").isNotNull().alias("cached"), F.round(F.get("embedding", 0).cast("double"), 6).alias("first_value"))


@query("embed_plugin", r"""
WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY 1),
stored AS (SELECT sha256(text) AS h FROM documents JOIN embeddings ON vec_id = doc_id),
todo AS (SELECT DISTINCT sha256(text) AS text_hash, lower(left(text, 32000)) AS said FROM t WHERE sha256(text) NOT IN (SELECT h FROM stored)),
w AS (SELECT text_hash, unnest(string_split_regex(trim(said, E' \n\t'), '\s+')) AS w FROM todo),
c AS (SELECT text_hash, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 32 AS b, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
g AS (SELECT text_hash, unnest(range(32)) AS b FROM todo)
SELECT g.text_hash, string_agg(coalesce(n, 0)::VARCHAR, ' ' ORDER BY g.b) AS vector FROM g LEFT JOIN c ON c.text_hash = g.text_hash AND c.b = g.b GROUP BY 1""")
def embed_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by a fixed Python function for the conversations whose text has none stored."""
    _, stored = _hashed_documents(spark, sf_dir)
    spoken = texts.conversation_texts(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])
    made = texts.embed_missing(spoken, stored, "m1", texts.hashed_words())
    return made.select("text_hash", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("vector"))


@query("top_words", r"""
WITH w AS (SELECT source, doc_id, unnest(string_split_regex(lower(text), '[\s\x{A0}\x{FEFF}\p{Z}]+')) AS w, generate_subscripts(string_split_regex(lower(text), '[\s\x{A0}\x{FEFF}\p{Z}]+'), 1) AS pos FROM documents),
c AS (SELECT source, regexp_replace(w, '[^a-z]', '', 'g') AS word, min((doc_id, pos)) AS first, count(*) AS n FROM w GROUP BY 1, 2),
s AS (SELECT unnest(string_split('""" + " ".join(words.STOP_WORDS) + r"""', ' ')) AS stop)
SELECT source, word, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS rank FROM c
WHERE length(word) > 3 AND word NOT IN (SELECT stop FROM s) QUALIFY rank <= 3""")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.top_words(table(spark, sf_dir, "documents"), ["source"], ["doc_id"]).select("source", "word", "n", "rank")


LINKED = """
lk AS (SELECT * EXCLUDE (text), CASE WHEN thread_us IS NULL THEN text ELSE text||' https://acme.slack.com/archives/'||channel||'/p'||thread_us||
  CASE WHEN msg_id%3=0 THEN ' https://acme.slack.com/archives/'||channel||'/p'||thread_us ELSE ' https://acme.slack.com/archives/C1/p1' END END AS text FROM msgs),
qt AS (SELECT msg_id, unnest(regexp_extract_all(text, 'https://[\\w-]+\\.slack\\.com/archives/([A-Z0-9]+)/p(\\d+)', 1)) AS c, unnest(regexp_extract_all(text, 'https://[\\w-]+\\.slack\\.com/archives/([A-Z0-9]+)/p(\\d+)', 2)) AS p,
  unnest(regexp_extract_all(text, 'https://[\\w-]+\\.slack\\.com/archives/[A-Z0-9]+/p\\d+', 0)) AS raw, generate_subscripts(regexp_extract_all(text, 'https://[\\w-]+\\.slack\\.com/archives/[A-Z0-9]+/p\\d+', 0), 1) - 1 AS at FROM lk)"""


@query("linked_messages", with_(MSGS, LINKED) + """
SELECT q.msg_id, q.at, l.text, l.user_id AS author_id, q.c AS channel_id, q.raw AS from_url FROM qt q JOIN lk l ON l.channel=q.c AND l.ts_us = try_cast(q.p AS BIGINT) AND length(q.p) > 10""")
def linked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_links(messages(spark, sf_dir))
    return links.linked_messages(rows, rows, ["msg_id"]).select("msg_id", F.col("at").cast("long").alias("at"), "text", "author_id", "channel_id", "from_url")


@query("permalinks", with_(MSGS) + """
SELECT msg_id, 'https://acme.slack.com/archives/'||channel||'/p'||ts_us AS link, CASE WHEN thread_us IS NULL THEN 'https://slack.com/archives/'||channel
  ELSE 'https://acme.slack.com/archives/'||channel||'/p'||thread_us END AS thread_link FROM msgs""")
def permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("msg_id", links.permalink(CHAT_BASE, ts_us="ts_us").alias("link"),
                                          links.permalink(CHAT_BASE, ts_us="thread_us").alias("thread_link"))


@query("group_links", with_(*TO_TOPICS, recursive=True) + """
, l AS (SELECT f.channel, tp.topic_id, f.start_us, CASE WHEN kind='t' THEN 0 ELSE 1 END AS kr, f.conv_id, 'https://acme.slack.com/archives/'||f.channel||'/p'||f.start_us AS link FROM fconv f JOIN tp USING (conv_id))
SELECT channel, topic_id, arg_min(link, (start_us, kr, conv_id)) AS primary_link, string_agg(link, ' ' ORDER BY start_us, kr, conv_id) AS links FROM l GROUP BY 1, 2""")
def group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Consolidation(spark, sf_dir)
    placed = c.conv.select("channel", "conv_id", "start_us", "kind_rank").join(c.members, ["channel", "conv_id"])
    urls = c.conv.select("conv_id", links.permalink(CHAT_BASE, ts_us="start_us").alias("link"))
    found = links.topic_links(placed, urls, ["channel", "topic_id"], ["start_us", "kind_rank", "conv_id"])
    return found.select("channel", "topic_id", "primary_link", F.array_join("links", " ").alias("links"))


@query("truncated_texts", """
SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 497)||'...' ELSE text END AS short, length(left(text, 32000)) AS embed_chars FROM documents""")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rendering.truncate(F.col("text"), 500).alias("short"),
                                                    F.length(F.substring("text", 1, texts.EMBED_CHARS)).alias("embed_chars"))


@query("dates", with_(MSGS) + """
, l AS (SELECT msg_id, timezone('America/New_York', make_timestamptz(ts_us)) AS t, timezone('America/New_York', make_timestamptz(ts_us + 7200000000)) AS e FROM msgs)
SELECT msg_id, strftime(t, '%A, %B %-d, %Y') AS long_date, strftime(t, '%B %-d, %Y at %-I:%M %p') AS date_time,
  CASE WHEN t::DATE = e::DATE THEN strftime(t, '%-I:%M %p')||' - '||strftime(e, '%-I:%M %p') ELSE strftime(t, '%b %-d, %-I:%M %p')||' - '||strftime(e, '%b %-d, %-I:%M %p') END AS time_range FROM l""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tz = "America/New_York"
    return messages(spark, sf_dir).select(
        "msg_id", rendering.long_date(F.col("ts_us"), tz).alias("long_date"), rendering.date_time(F.col("ts_us"), tz).alias("date_time"),
        rendering.time_range(F.col("ts_us"), F.col("ts_us") + 7_200_000_000, tz).alias("time_range"))


@query("attachments", with_(MSGS, PEOPLE) + """
, a AS (SELECT msg_id, event_type, 'U'||(msg_id%200) AS aid, repeat('long ', 70) AS long FROM msgs WHERE event_type IN ('purchase','signup'))
SELECT msg_id, CASE event_type WHEN 'purchase' THEN '[Shared message '||coalesce('from '||p.shown_name||' ', '')||'in #general]: "Shared '||msg_id||' '||coalesce('@'||u3.shown_name, '<@U3>')||'"'||chr(10)||'[Shared link]: "Title '||msg_id||'"'
  ELSE '[Shared message from Ana]: "'||left('Fallback '||long||msg_id, 297)||'..."'||chr(10)||'[Attachment]: "Plain '||msg_id||'"' END AS attachment_text
FROM a LEFT JOIN people p ON p.user_id=aid LEFT JOIN people u3 ON u3.user_id='U3'""")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_attachments(messages(spark, sf_dir))
    return rendering.attachment_texts(rows, people(spark, sf_dir), ["msg_id"])


@query("prompt_lines", with_(MSGS, PEOPLE) + """
SELECT msg_id, '['||CASE WHEN subtype='bot_message' OR m.user_id IS NULL THEN 'Bot' ELSE coalesce(p.shown_name, m.user_id) END||']: '||
  CASE WHEN q.shown_name IS NULL THEN text ELSE replace(text, '<@'||u||'>', '@'||q.shown_name) END AS line
FROM (SELECT *, regexp_extract(text, '<@(U[A-Z0-9]+)>', 1) AS u FROM msgs) m LEFT JOIN people p ON p.user_id=m.user_id LEFT JOIN people q ON q.user_id=m.u""")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.message_lines(messages(spark, sf_dir), people(spark, sf_dir), ["msg_id"]).select("msg_id", "line")


@query("day_final_stream", with_(MSGS) + """
, d AS (SELECT channel, ts_us // 86400000000 AS dn, count(*) AS message_count, min(ts_us) AS first_us, max(ts_us) AS last_us FROM msgs GROUP BY 1, 2), l AS (SELECT max(ts_us) AS t FROM msgs)
SELECT channel, strftime(make_timestamp(dn * 86400000000), '%Y-%m-%d') AS day, message_count, first_us, last_us FROM d, l WHERE (dn + 1) * 86400000000 <= (t // 1000) * 1000 - 86400000000""")
def day_final_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are final when the whole table has gone through a stream with a one-day watermark."""
    return _drain(spark, sf_dir, lambda s: ingest.final_days(ingest.first_seen(s), None), "day_final")


@query("session_stream", with_(MSGS, MAIN) + """
, x AS (SELECT channel, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS message_count FROM seg GROUP BY channel, seg_no), l AS (SELECT max(ts_us) AS t FROM main)
SELECT x.* FROM x, l WHERE end_us + 3599999999 <= (t // 1000) * 1000 - 86400000000""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are closed when the whole table has gone through a stream."""
    return _drain(spark, sf_dir, lambda s: sessions.session_rollup(segments.main_messages(s), ["channel"], watermark="1 day").select(
        "channel", "start_us", "end_us", "message_count"), "session")


def _drain(spark: SparkSession, sf_dir: str, plan, name: str) -> DataFrame:
    """Run a plan over the message table as a stream until it is used up and read what it wrote.

    The stream reads a written copy of the derived messages. Folders lie beside the checkpoints, which every executor sees.
    """
    from threadloom.session import shared_folder
    root = shared_folder(spark, name)
    rows = messages(spark, sf_dir).withColumn("event_time", F.timestamp_micros("ts_us"))
    rows.write.parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    out = plan(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    out.awaitTermination()
    return spark.read.parquet(f"{root}/out")
