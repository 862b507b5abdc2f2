"""Queries on requests, activity of users, and direct lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.catalog.registry import query
from threadloom.catalog.sql import MSGS, THREADS, with_
from threadloom.functions import clock, predicates
from threadloom.operators import collection, context, lookup, names, segments
from threadloom.plans import periods
from threadloom.session import cut_lineage, shared_folder
from threadloom.sources import records, tables
from threadloom.sources.event_feed import channels, directory, messages, with_reactions


def requests(messages_df: DataFrame) -> DataFrame:
    """One request per user, dated at the user's last message; wording and zone vary with the user number."""
    number = F.col("uid")
    per_user = messages_df.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max("ts_us").alias("as_of_us")).withColumn(
        "uid", F.substr("user_id", F.lit(2)).cast("long"))
    words = ["today", "Yesterday", "last-week", "2024-01-05..2024-01-12", "2024-01-10", "LastWeek", "2024-01-20..2024-01-31", "next-year"]
    zones = ["UTC", "America/New_York", "Asia/Tokyo"]
    pick = lambda options: F.element_at(F.array(*[F.lit(o) for o in options]), (number % len(options) + 1).cast("int"))
    return per_user.select(F.col("user_id").alias("owner_id"), pick(words).alias("timespan"), pick(zones).alias("tz"), "as_of_us")


def periods_of(messages_df: DataFrame) -> DataFrame:
    """Resolved requests, one small row each; written once because every activity table joins them."""
    return cut_lineage(periods.resolve(requests(messages_df))[0])


def user_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_of(messages(spark, sf_dir))


REQUESTS = """
rq AS (SELECT user_id AS owner_id, max(ts_us) AS as_of_us, user_id[2:]::BIGINT AS uid FROM msgs WHERE user_id IS NOT NULL GROUP BY user_id),
rq1 AS (SELECT owner_id, as_of_us, ['today','Yesterday','last-week','2024-01-05..2024-01-12','2024-01-10','LastWeek','2024-01-20..2024-01-31','next-year'][uid%8+1] AS timespan,
  ['UTC','America/New_York','Asia/Tokyo'][uid%3+1] AS tz FROM rq),
rq2 AS (SELECT *, timezone(tz, make_timestamptz(as_of_us))::DATE AS today FROM rq1),
rq3 AS (SELECT *, CASE WHEN lower(timespan)='today' THEN today WHEN lower(timespan)='yesterday' THEN today-1 WHEN lower(timespan) IN ('last-week','lastweek') THEN today-7
    ELSE try_cast(split_part(timespan,'..',1) AS DATE) END AS d0,
  CASE WHEN lower(timespan) IN ('today','last-week','lastweek') THEN today WHEN lower(timespan)='yesterday' THEN today-1
    WHEN timespan LIKE '%..%' THEN try_cast(split_part(timespan,'..',2) AS DATE) ELSE try_cast(timespan AS DATE) END AS d1 FROM rq2),
per AS (SELECT owner_id, timespan, tz, as_of_us, epoch_us(timezone(tz, d0::TIMESTAMP)) AS start_us, epoch_us(timezone(tz, (d1+1)::TIMESTAMP)) - 1000 AS end_us
  FROM rq3 WHERE d0 IS NOT NULL AND d1 IS NOT NULL)"""

ACTIVITY = """
sent AS (SELECT p.owner_id, m.* FROM msgs m JOIN per p ON p.owner_id = m.user_id AND m.ts_us BETWEEN p.start_us AND p.end_us),
ment AS (SELECT p.owner_id, m.channel, m.msg_id, m.ts_us FROM (SELECT *, unnest(list_distinct(regexp_extract_all(text, '<@([^|>]+)(?:\\|[^>]+)?>', 1))) AS u FROM msgs) m
  JOIN per p ON p.owner_id = m.u AND m.ts_us BETWEEN p.start_us AND p.end_us),
act AS (SELECT DISTINCT owner_id, channel FROM sent),
wide AS (SELECT owner_id, start_us, end_us, epoch_us(timezone(tz, date_trunc('day', timezone(tz, make_timestamptz(start_us - 86400000000)))::TIMESTAMP)) AS ws,
  epoch_us(timezone(tz, (date_trunc('day', timezone(tz, make_timestamptz(end_us))) + INTERVAL 1 DAY)::TIMESTAMP)) - 1000 AS we FROM per),
thr AS (SELECT DISTINCT w.owner_id, m.channel, m.thread_us, w.start_us, w.end_us FROM msgs m JOIN wide w ON w.owner_id = m.user_id AND m.ts_us BETWEEN w.ws AND w.we
  JOIN act a ON a.owner_id = m.user_id AND a.channel = m.channel WHERE m.thread_us IS NOT NULL),
thn AS (SELECT t.owner_id, t.channel, t.thread_us, count(*) AS message_count FROM thr t JOIN tmsg x ON x.channel=t.channel AND x.t_us=t.thread_us
  AND x.ts_us BETWEEN t.start_us AND t.end_us GROUP BY 1, 2, 3),
tally AS (SELECT owner_id, channel, count_if(w='s')::BIGINT AS messages_sent, count_if(w='m')::BIGINT AS mentions_received, count_if(w='t')::BIGINT AS threads FROM (
  SELECT owner_id, channel, 's' AS w FROM sent UNION ALL SELECT owner_id, channel, 'm' FROM ment UNION ALL SELECT owner_id, channel, 't' FROM thn) GROUP BY 1, 2)"""

REACTED = """
rea AS (SELECT channel, msg_id, ts_us, 'eyes' AS reaction, unnest(list_distinct(['U'||((msg_id*3)%150), 'U'||((msg_id*7)%150)])) AS owner_id FROM msgs WHERE event_type='purchase'
  UNION ALL SELECT channel, msg_id, ts_us, 'done', 'U'||((msg_id*11)%150) FROM msgs WHERE event_type IN ('purchase','error'))"""

TO_ACTIVITY = (MSGS, THREADS, REQUESTS, ACTIVITY)


@query("request_periods", with_(MSGS, REQUESTS) + "SELECT owner_id, timespan, tz, start_us, end_us FROM per")
def request_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_periods(spark, sf_dir).select("owner_id", "timespan", "tz", "start_us", "end_us")


@query("rejected_requests", with_(MSGS, REQUESTS) + "SELECT owner_id, 'Invalid timespan: '||timespan AS error FROM rq3 WHERE d0 IS NULL OR d1 IS NULL")
def rejected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.resolve(requests(messages(spark, sf_dir)))[1].select("owner_id", "error")


@query("calendar_ranges", with_(MSGS, REQUESTS) + """
, x AS (SELECT owner_id, tz, today, date_trunc('week', today)::DATE AS mon FROM rq2),
y AS (SELECT owner_id, tz, 'this_week' AS what, mon AS a, today AS b FROM x UNION ALL SELECT owner_id, tz, 'previous_week', mon-7, mon-1 FROM x
  UNION ALL SELECT owner_id, tz, 'iso_week', mon, mon+6 FROM x
  UNION ALL SELECT owner_id, tz, 'month', date_trunc('month', today)::DATE, last_day(today) FROM x
  UNION ALL SELECT owner_id, tz, 'normalized', least(today, DATE '2024-01-15'), greatest(today, DATE '2024-01-15') FROM x)
SELECT owner_id, what, epoch_us(timezone(tz, a::TIMESTAMP)) AS start_us, epoch_us(timezone(tz, (b+1)::TIMESTAMP)) - 1000 AS end_us FROM y""")
def calendar_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, tz, as_of = requests(messages(spark, sf_dir)), F.col("tz"), F.col("as_of_us")
    today = clock.local_day(as_of, tz)
    kinds = {"this_week": periods.this_week(as_of, tz), "previous_week": periods.previous_week(as_of, tz),
             "iso_week": periods.iso_week(F.extract(F.lit("YEAROFWEEK"), today), F.weekofyear(today), tz), "month": periods.month(today, tz),
             "normalized": periods.normalized(today, F.lit("2024-01-15").cast("date"), tz)}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), c.alias("r")) for n, c in kinds.items()]))
    return asked.select("owner_id", rows.alias("_k")).select("owner_id", "_k.what", "_k.r.start_us", "_k.r.end_us")


@query("timespan_words", with_(MSGS, REQUESTS) + """
, s AS (SELECT owner_id, ['today','yesterday','2024-01-28'][uid%3+1] AS d, ['day','week','2024-01-01..2024-01-02','month'][uid%4+1] AS l
        FROM (SELECT owner_id, owner_id[2:]::BIGINT AS uid FROM rq1))
SELECT owner_id, CASE WHEN l LIKE '%..%' THEN l WHEN d='today' THEN CASE WHEN l='week' THEN 'last-week' ELSE 'today' END WHEN d='yesterday' THEN d
  WHEN l='day' THEN d WHEN l='week' THEN d||'..'||(d::DATE+6)::VARCHAR ELSE d END AS timespan FROM s""")
def timespan_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, n = requests(messages(spark, sf_dir)), F.substr("owner_id", F.lit(2)).cast("long")
    pick = lambda options: F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))
    return asked.select("owner_id", periods.build_timespan(pick(["today", "yesterday", "2024-01-28"]),
                                                           pick(["day", "week", "2024-01-01..2024-01-02", "month"])).alias("timespan"))


@query("active_channels", with_(*TO_ACTIVITY) + "SELECT owner_id, channel FROM act")
def active_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.active_channels(messages(spark, sf_dir), user_periods(spark, sf_dir)).select("owner_id", "channel")


@query("participated_threads", with_(*TO_ACTIVITY) + "SELECT owner_id, channel, thread_us, message_count FROM thn")
def participated_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs, spans = messages(spark, sf_dir), user_periods(spark, sf_dir)
    joined = collection.participated_threads(msgs, spans)
    return collection.thread_sizes(joined, segments.thread_messages(msgs), spans).select("owner_id", "channel", "thread_us", "message_count")


def _activity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    msgs, spans = messages(spark, sf_dir), user_periods(spark, sf_dir)
    joined = collection.participated_threads(msgs, spans)
    sizes = collection.thread_sizes(joined, segments.thread_messages(msgs), spans)
    tally = collection.channel_activity(collection.own_messages(msgs, spans), collection.mentions(msgs, spans), sizes)
    return tally, collection.reactions_given(with_reactions(msgs), spans)


@query("channel_activity", with_(*TO_ACTIVITY) + "SELECT owner_id, channel, messages_sent, mentions_received, threads, messages_sent > 0 OR threads > 0 AS kept FROM tally")
def channel_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel a user wrote in, was mentioned in or has threads in; a mention alone does not keep a channel."""
    kept = (F.col("messages_sent") > 0) | (F.col("threads") > 0)
    return _activity(spark, sf_dir)[0].select("owner_id", "channel", "messages_sent", "mentions_received", "threads", kept.alias("kept"))


@query("top_channels", with_(*TO_ACTIVITY) + """
SELECT owner_id, channel, messages_sent, mentions_received, threads, row_number() OVER (PARTITION BY owner_id ORDER BY messages_sent+mentions_received+threads DESC, channel) AS place
FROM tally WHERE messages_sent > 0 OR threads > 0 QUALIFY place <= 5""")
def top_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most active channels of every user, the length of the report's list."""
    from threadloom.operators.ordered import first_n
    kept = collection.kept_channels(_activity(spark, sf_dir)[0]).withColumn("_sum", F.col("messages_sent") + F.col("mentions_received") + F.col("threads"))
    return first_n(kept, ["owner_id", "period_no"], [F.desc("_sum"), "channel"], 5, "place").select(
        "owner_id", "channel", "messages_sent", "mentions_received", "threads", "place")


@query("totals", with_(*TO_ACTIVITY, REACTED) + """
, rt AS (SELECT r.owner_id, count(*) AS n FROM rea r JOIN per p ON p.owner_id=r.owner_id AND r.ts_us BETWEEN p.start_us AND p.end_us GROUP BY 1),
t AS (SELECT owner_id, count_if(messages_sent>0 OR threads>0)::BIGINT AS c, sum(messages_sent)::BIGINT AS m, sum(mentions_received)::BIGINT AS r, sum(threads)::BIGINT AS h FROM tally GROUP BY 1)
SELECT coalesce(t.owner_id, rt.owner_id) AS owner_id, coalesce(c,0) AS total_channels, coalesce(m,0) AS total_messages, coalesce(r,0) AS mentions_received,
  coalesce(h,0) AS threads_participated, coalesce(n,0) AS reactions_given FROM t FULL JOIN rt ON t.owner_id=rt.owner_id""")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally, reacted = _activity(spark, sf_dir)
    return collection.totals(tally, reacted).drop("period_no")


@query("reactions_given", with_(MSGS, REACTED) + "SELECT owner_id, channel, msg_id, ts_us, reaction FROM rea")
def reactions_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.reactions_given(with_reactions(messages(spark, sf_dir))).select("owner_id", "channel", "msg_id", "ts_us", "reaction")


@query("mentions", with_(MSGS) + """SELECT msg_id, channel, unnest(list_distinct(regexp_extract_all(text, '<@([^|>]+)(?:\\|[^>]+)?>', 1))) AS owner_id FROM msgs""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.mentions(messages(spark, sf_dir)).select("msg_id", "channel", "owner_id")


@query("mention_search", with_(MSGS) + "SELECT msg_id, channel, ts_us FROM msgs WHERE text LIKE '%<@U49>%' AND ts_us BETWEEN 1704412800000000 AND 1705708799999000")
def mention_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.search_mentions(messages(spark, sf_dir), "U49", 1704412800000000, 1705708799999000).select("msg_id", "channel", "ts_us")


@query("search", with_(MSGS) + """
SELECT msg_id, channel, user_id, text FROM msgs WHERE lower(text) LIKE '%timeouterror%' AND lower(text) LIKE '%#1%' AND channel='C7'
  AND ts_us // 86400000000 BETWEEN 19728 AND 19742 ORDER BY ts_us, msg_id LIMIT 50""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.search(messages(spark, sf_dir), ["TimeoutError", "#1"], channel="C7", from_date="2024-01-06", to_date="2024-01-20").select(
        "msg_id", "channel", "user_id", "text")


@query("authored", with_(MSGS) + "SELECT msg_id, channel, ts_us FROM msgs WHERE user_id='U14' AND ts_us BETWEEN 1704412800000000 AND 1705708799999000")
def authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.read_range(messages(spark, sf_dir), None, 1704412800000000, 1705708799999000, "U14").select("msg_id", "channel", "ts_us")


@query("range_read", with_(MSGS) + "SELECT msg_id, ts_us, text FROM msgs WHERE channel='C3' AND ts_us BETWEEN 1704412800000000 AND 1705708799999000")
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.read_range(messages(spark, sf_dir), "C3", 1704412800000000, 1705708799999000).select("msg_id", "ts_us", "text")


@query("message_roundtrip", with_(MSGS) + """
SELECT msg_id, ts_us, user_id, text || CASE WHEN msg_id % 3 = 0 THEN ' (edited)' ELSE '' END AS text, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day_bucket, 0::BIGINT AS quarantined FROM msgs
  WHERE channel='C3' AND ts_us BETWEEN 1704412800000000 AND 1705708799999000 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 2 * count(*) FROM msgs WHERE msg_id % 10 = 0""")
def message_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write path: JSON export with broken records, reader and quarantine, upsert of a first and an edited version into the table
    partitioned by day, pruned range read; one more row counts the quarantine."""
    root = shared_folder(spark, "roundtrip")
    rows = messages(spark, sf_dir)
    stamp = F.concat(F.floor(F.col("ts_us") / 1_000_000).cast("string"), F.lit("."), F.lpad((F.col("ts_us") % 1_000_000).cast("string"), 6, "0"))
    record = F.struct("channel", stamp.alias("ts"), F.col("user_id").alias("user"), F.concat("msg_id", F.lit("|"), "text").alias("text"), "subtype")
    broken = rows.filter(F.col("msg_id") % 10 == 0).select(F.explode(F.array(F.lit('{"channel": "C1", "ts": '), F.lit('{"channel": "C1", "text": "no stamp"}'))).alias("value"))
    rows.select(F.to_json(record).alias("value")).unionByName(broken).write.text(f"{root}/export")
    good, bad = records.read_messages(spark, f"{root}/export")
    edited = good.filter(F.substring_index("text", "|", 1).cast("long") % 3 == 0).withColumn("text", F.concat("text", F.lit(" (edited)")))
    for number, part in enumerate((good, edited)):
        tables.upsert(spark, f"{root}/table", tables.message_rows(part, F.lit(number)), tables.MESSAGE_KEY, ["fetched_at", "msg_id"], "day_bucket")
    found = lookup.read_range(tables.read_table(spark, f"{root}/table"), "C3", 1704412800000000, 1705708799999000)
    number = F.substring_index("text", "|", 1)
    kept = found.select(number.cast("long").alias("msg_id"), "ts_us", "user_id", F.substr("text", F.length(number) + 2).alias("text"), F.col("day_bucket").cast("string").alias("day_bucket"),
                        F.lit(0).cast("long").alias("quarantined"))
    lost = bad.agg(F.count(F.lit(1)).alias("quarantined"))
    return kept.unionByName(lost, allowMissingColumns=True)


PEOPLE = """
usr AS (SELECT 'U'||c_custkey AS user_id, 'login'||c_custkey AS name, CASE c_custkey%3 WHEN 0 THEN c_name WHEN 1 THEN '' END AS real_name,
  CASE WHEN c_custkey%2=0 THEN upper(c_mktsegment[1])||lower(c_mktsegment[2:])||' '||c_custkey ELSE '' END AS display_name, c_custkey%11=5 AS deleted FROM customer),
people AS (SELECT user_id, coalesce(nullif(real_name,''), nullif(display_name,''), nullif(name,''), user_id) AS shown_name FROM usr WHERE NOT deleted)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.directory(directory(spark, sf_dir))


@query("display_names", with_(PEOPLE) + "SELECT user_id, shown_name FROM people")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("user_id", "shown_name")


@query("at_names", with_(MSGS, PEOPLE) + "SELECT msg_id, m.user_id, '@'||coalesce(shown_name, m.user_id) AS at_name FROM msgs m LEFT JOIN people USING (user_id)")
def at_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.at_names(messages(spark, sf_dir), people(spark, sf_dir)).select("msg_id", "user_id", "at_name")


@query("mention_names", with_(MSGS, PEOPLE) + """
SELECT msg_id, CASE WHEN shown_name IS NULL THEN text ELSE replace(text, '<@'||u||'>', '@'||shown_name) END AS shown_text
FROM (SELECT *, regexp_extract(text, '<@(U[A-Z0-9]+)>', 1) AS u FROM msgs) m LEFT JOIN people p ON p.user_id = m.u""")
def mention_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.resolve_mentions(messages(spark, sf_dir), people(spark, sf_dir), ["msg_id"]).select("msg_id", "shown_text")


@query("history", with_(MSGS, PEOPLE) + """
SELECT h.msg_id, h.ts_us, h.text, h.thread_us, h.user_id AS user_key, p.shown_name AS user_name FROM (
  SELECT * FROM msgs WHERE channel='C2' AND ts_us BETWEEN 1704412800000000 AND 1705708799999000 ORDER BY ts_us, msg_id LIMIT 100) h
LEFT JOIN people p ON p.user_id=h.user_id""")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.history(messages(spark, sf_dir), people(spark, sf_dir), "C2", 1704412800000000, 1705708799999000)
    return rows.select("msg_id", "ts_us", "text", "thread_us", F.col("user.id").alias("user_key"), F.col("user.name").alias("user_name"))


@query("user_objects", with_(MSGS, PEOPLE) + """
SELECT msg_id, m.user_id AS user_key, p.shown_name AS user_name, m.user_id IS NULL AS absent FROM msgs m LEFT JOIN people p ON p.user_id=m.user_id""")
def user_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.with_user_objects(messages(spark, sf_dir), people(spark, sf_dir))
    return rows.select("msg_id", F.col("user.id").alias("user_key"), F.col("user.name").alias("user_name"), F.col("user").isNull().alias("absent"))


@query("thread", with_(MSGS) + """
, t AS (SELECT min(thread_us) AS t FROM msgs WHERE channel='C4')
SELECT msg_id, ts_us, user_id, text FROM msgs, t WHERE channel='C4' AND coalesce(thread_us, ts_us) = t.t""")
def thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thread of a channel; its key is looked up in the same job."""
    msgs = messages(spark, sf_dir)
    first = msgs.filter(F.col("channel") == "C4").groupBy("channel").agg(F.min("thread_us").alias("t"))
    keyed = msgs.withColumn("t", F.coalesce("thread_us", "ts_us")).join(first, ["channel", "t"], "left_semi")
    return keyed.select("msg_id", "ts_us", "user_id", "text")


@query("message_lookup", with_(MSGS) + """
SELECT m.msg_id, x.msg_id AS found_msg, x.text AS found_text FROM msgs m LEFT JOIN msgs x ON x.channel=m.channel AND x.ts_us=m.thread_us WHERE m.thread_us IS NOT NULL""")
def message_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the point lookup: every reply asks for the first message of its thread."""
    msgs = messages(spark, sf_dir)
    found = msgs.select("channel", F.col("ts_us").alias("thread_us"), F.col("msg_id").alias("found_msg"), F.col("text").alias("found_text"))
    return msgs.filter(F.col("thread_us").isNotNull()).join(found, ["channel", "thread_us"], "left").select("msg_id", "found_msg", "found_text")


CHANNELS = """
chn AS (SELECT channel AS id, CASE channel[1] WHEN 'C' THEN 'team-'||channel[2:] WHEN 'G' THEN 'mpdm-ana.lee--bo.kim--cy-1' END AS name, count(DISTINCT user_id) AS num_members,
  channel[1]='D' AS is_im, channel[1]='G' AS is_mpim, channel[2:]='6' AS is_private, channel[2:]='7' AS is_group FROM msgs GROUP BY channel)"""


@query("channel_directory", with_(MSGS, CHANNELS) + """
SELECT id, name, num_members, CASE WHEN is_im THEN 'im' WHEN is_mpim THEN 'mpim' WHEN is_private OR is_group THEN 'private_channel' ELSE 'public_channel' END AS type FROM chn""")
def channel_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.channel_directory(channels(messages(spark, sf_dir))).select("id", "name", "num_members", "type")


@query("channel_names", with_(MSGS, PEOPLE, CHANNELS) + """
, ask AS (SELECT DISTINCT user_id AS owner_id, channel FROM msgs WHERE user_id IS NOT NULL),
oth AS (SELECT channel, arg_max(user_id, (length(user_id), user_id)) AS other FROM ask_u GROUP BY 1),
own AS (SELECT owner_id, shown_name AS own_name FROM ask LEFT JOIN people ON user_id = owner_id),
mem AS (SELECT a.owner_id, a.channel, string_agg(split_part(p.shown_name,' ',1), ', ' ORDER BY length(m.user_id), m.user_id) AS first_names
  FROM ask a JOIN ask_u m ON m.channel=a.channel AND m.user_id <> a.owner_id JOIN people p ON p.user_id=m.user_id WHERE a.channel LIKE 'G%' GROUP BY 1, 2)
SELECT a.owner_id, a.channel, CASE WHEN c.is_im THEN coalesce(p.shown_name, o.other) WHEN c.is_mpim THEN coalesce('Group: '||m.first_names, 'Group: Ana, Bo, Cy') ELSE c.name END AS channel_name
FROM ask a JOIN chn c ON c.id=a.channel LEFT JOIN oth o ON o.channel=a.channel LEFT JOIN people p ON p.user_id=o.other
LEFT JOIN mem m ON m.owner_id=a.owner_id AND m.channel=a.channel""".replace("oth AS (", "ask_u AS (SELECT DISTINCT user_id, channel FROM msgs WHERE user_id IS NOT NULL),\noth AS (", 1))
def channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all channels for all their authors; the other side of a direct channel is its last user by id."""
    msgs = messages(spark, sf_dir)
    authors = msgs.filter(F.col("user_id").isNotNull()).select("channel", "user_id").distinct()
    place = F.struct(F.length("user_id").alias("l"), F.col("user_id").alias("u"))
    other = authors.groupBy(F.col("channel").alias("id")).agg(F.max_by("user_id", place).alias("user"))
    members = authors.filter(F.col("channel").startswith("G")).withColumn("place", place)
    return names.channel_names(authors.withColumnRenamed("user_id", "owner_id"), channels(msgs).join(other, "id"), members, people(spark, sf_dir))


@query("message_flags", with_(MSGS) + """
SELECT msg_id, coalesce(subtype='bot_message', false) OR (user_id IS NULL AND text <> '') AS is_bot, regexp_matches(text, '(?i)\\b(confirm(ed|ing)?|verif(y|ied|ying)|test(ed|ing)?|check(ed|ing)?|fix(ed|ing)?|done|complete[d]?|approve[d]?|review(ed|ing)?|resolve[d]?|merge[d]?|deploy(ed|ing)?|update[d]?|ship(ped|ping)?|launch(ed|ing)?|release[d]?)\\b') AS has_work,
  coalesce(subtype IN ('context_message','mention_context'), false) AS is_context, channel LIKE 'D%' AS is_direct, coalesce(thread_us <> ts_us, false) AS is_reply FROM msgs""")
def message_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(
        "msg_id", predicates.is_bot_message().alias("is_bot"), predicates.has_work_indicator().alias("has_work"),
        predicates.is_context_message().alias("is_context"), predicates.is_direct_channel().alias("is_direct"), segments.is_thread_reply().alias("is_reply"))


@query("day_and_ts", with_(MSGS) + """
SELECT msg_id, (ts_us // 1000000)||'.'||lpad((ts_us % 1000000)::VARCHAR, 6, '0') AS ts, ts_us AS back_us, strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day_utc,
  strftime(timezone('America/New_York', make_timestamptz(ts_us)), '%Y-%m-%d') AS day_local, round(abs(ts_us - thread_us) / 60000000.0, 6) AS minutes FROM msgs""")
def day_and_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = clock.us_to_ts_string("ts_us")
    return messages(spark, sf_dir).select(
        "msg_id", ts.alias("ts"), clock.ts_string_to_us(ts).alias("back_us"), clock.day_bucket("ts_us").alias("day_utc"),
        clock.day_bucket("ts_us", "America/New_York").alias("day_local"), F.round(clock.minutes_between("ts_us", "thread_us"), 6).alias("minutes"))


CONTEXT_SQL = """
own AS (SELECT user_id AS owner_id, channel, msg_id, ts_us FROM msgs WHERE user_id IS NOT NULL AND (thread_us IS NULL OR thread_us = ts_us)),
og AS (SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w >= 3600000000 THEN 1 ELSE 0 END AS opens FROM own WINDOW w AS (PARTITION BY owner_id, channel ORDER BY ts_us, msg_id)),
os AS (SELECT *, sum(opens) OVER (PARTITION BY owner_id, channel ORDER BY ts_us, msg_id) AS seg_no FROM og),
sc AS (SELECT owner_id, channel, seg_no, count(*) AS n, min(ts_us) AS first_us FROM os GROUP BY 1, 2, 3),
pos AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts_us, msg_id) AS place, rank() OVER (PARTITION BY channel ORDER BY ts_us) - 1 AS before FROM msgs),
cand AS (SELECT s.owner_id, s.channel, s.seg_no, m.msg_id, m.ts_us, row_number() OVER (PARTITION BY s.owner_id, s.channel, s.seg_no ORDER BY m.ts_us DESC, m.msg_id DESC) AS step, 5 - s.n AS need,
  coalesce(lag(m.ts_us) OVER (PARTITION BY s.owner_id, s.channel, s.seg_no ORDER BY m.ts_us DESC, m.msg_id DESC), s.first_us) - m.ts_us AS gap
  FROM sc s JOIN pos f ON f.channel=s.channel AND f.ts_us=s.first_us JOIN pos m ON m.channel=s.channel AND m.place BETWEEN f.before - (4 - s.n) AND f.before WHERE s.n <= 2),
ctx AS (SELECT * FROM (SELECT *, max(gap) OVER (PARTITION BY owner_id, channel, seg_no ORDER BY step) AS widest FROM cand WHERE step <= need) WHERE widest <= 3600000000)"""


def own_segments(msgs: DataFrame) -> DataFrame:
    own = segments.main_messages(msgs).filter(F.col("user_id").isNotNull()).withColumn("owner_id", F.col("user_id"))
    return segments.gap_segments(own, ["owner_id", "channel"])


@query("short_segment_context", with_(MSGS, CONTEXT_SQL) + "SELECT owner_id, channel, seg_no, msg_id, ts_us FROM ctx")
def short_segment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = messages(spark, sf_dir)
    ids = ["owner_id", "channel", "seg_no"]
    tagged = own_segments(msgs)
    conv = tagged.groupBy(*ids).agg(F.count(F.lit(1)).alias("message_count"), F.count(F.lit(1)).alias("user_message_count")).withColumn("kind", F.lit("m"))
    conv = conv.join(context.first_messages(tagged, ids), ids)
    return context.short_segment_context(conv, context.channel_positions(msgs), ids).select(*ids, "msg_id", "ts_us")


@query("context_dedup", with_(MSGS, CONTEXT_SQL) + """
, allm AS (SELECT owner_id, channel, seg_no, ts_us, 0 AS added FROM os UNION ALL
  SELECT DISTINCT owner_id, channel, seg_no, ts_us, 1 FROM ctx c WHERE NOT EXISTS (SELECT 1 FROM os o WHERE o.owner_id=c.owner_id AND o.channel=c.channel AND o.seg_no=c.seg_no AND o.ts_us=c.ts_us))
SELECT owner_id, channel, seg_no, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS message_count, sum(added)::BIGINT AS context_added FROM allm GROUP BY 1, 2, 3""")
def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every user with their context added and rolled up again."""
    msgs = messages(spark, sf_dir)
    ids = ["owner_id", "channel", "seg_no"]
    tagged = own_segments(msgs).withColumn("kind", F.lit("m"))
    conv = tagged.groupBy(*ids, "kind").agg(F.count(F.lit(1)).alias("message_count"), F.count(F.lit(1)).alias("user_message_count"))
    full = context.enrich(tagged, context.channel_positions(msgs), ids, "owner_id", conv)
    return full.groupBy(*ids).agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("message_count"),
                                  F.count_if(predicates.is_context_message()).alias("context_added"))


@query("mention_lookback", with_(MSGS, THREADS) + """
, fm AS (SELECT channel, t_us, u, min(ts_us) AS mention_us FROM (SELECT *, unnest(regexp_extract_all(text, '<@([^|>]+)>', 1)) AS u FROM
    (SELECT channel, t_us, msg_id, ts_us, text FROM tmsg UNION ALL SELECT channel, ts_us // 86400000000, msg_id, ts_us, text FROM msgs WHERE thread_us IS NULL)) GROUP BY 1, 2, 3),
fa AS (SELECT channel, t_us, arg_min(struct_pack(u := user_id), (ts_us, msg_id)).u AS author FROM
    (SELECT channel, t_us, msg_id, ts_us, user_id FROM tmsg UNION ALL SELECT channel, ts_us // 86400000000, msg_id, ts_us, user_id FROM msgs WHERE thread_us IS NULL) GROUP BY 1, 2),
pos AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts_us, msg_id) AS place, rank() OVER (PARTITION BY channel ORDER BY ts_us) - 1 AS before FROM msgs)
SELECT f.channel, f.t_us AS group_no, f.u AS mentioned, m.msg_id FROM fm f JOIN fa a ON a.channel=f.channel AND a.t_us=f.t_us AND a.author IS DISTINCT FROM f.u
JOIN pos p ON p.channel=f.channel AND p.ts_us=f.mention_us JOIN pos m ON m.channel=f.channel AND m.place BETWEEN p.before - 19 AND p.before
  AND m.ts_us // 86400000000 = f.mention_us // 86400000000""")
def mention_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context for every mentioned user in every thread and in every channel day taken as one conversation."""
    msgs = messages(spark, sf_dir)
    threads = segments.thread_messages(msgs).withColumn("group_no", F.col("thread_us"))
    days = msgs.filter(F.col("thread_us").isNull()).withColumn("group_no", clock.slot("ts_us", clock.DAY_US))
    groups = threads.select("channel", "group_no", "msg_id", "ts_us", "user_id", "text").unionByName(
        days.select("channel", "group_no", "msg_id", "ts_us", "user_id", "text"))
    return context.mention_lookback(groups, context.channel_positions(msgs), ["channel", "group_no"]).select("channel", "group_no", "mentioned", "msg_id")


@query("union_keys", with_(*TO_ACTIVITY) + "SELECT owner_id, channel FROM sent UNION SELECT owner_id, channel FROM ment UNION SELECT owner_id, channel FROM thn")
def union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activity(spark, sf_dir)[0].select("owner_id", "channel").distinct()
