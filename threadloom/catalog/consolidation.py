"""Queries that merge conversations into topics."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.catalog.references import refs_sql
from threadloom.catalog.registry import query
from threadloom.catalog.sql import CONV, MAIN, MSGS, THREADS, with_
from threadloom.functions import references as refs
from threadloom.operators import conversations, folds, merging, segments, texts
from threadloom.session import cut_lineage, dealt
from threadloom.sources.event_feed import messages

SCOPE = ["channel"]

BOTS = """
bo AS (SELECT *, row_number() OVER w AS n, lead(start_us) OVER w AS next_start, lead(is_bot) OVER w AS next_bot
       FROM conv WINDOW w AS (PARTITION BY channel ORDER BY start_us, CASE WHEN kind='t' THEN 0 ELSE 1 END, conv_id)),
bot(channel, n, conv_id, cluster_id, merged, kept_id, kept_end, kept_bot, carry_id, carry_end) AS (
  SELECT DISTINCT channel, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, false, NULL::VARCHAR, NULL::BIGINT, false, NULL::VARCHAR, NULL::BIGINT FROM conv
  UNION ALL
  SELECT channel, n, conv_id, CASE WHEN back THEN kept_id ELSE eid END, back OR fwd,
    CASE WHEN back OR fwd THEN kept_id ELSE eid END,
    CASE WHEN back THEN greatest(kept_end, eend) WHEN fwd THEN kept_end ELSE eend END,
    CASE WHEN back OR fwd THEN kept_bot ELSE ebot END,
    CASE WHEN fwd THEN eid END, CASE WHEN fwd THEN eend END
  FROM (SELECT *, ebot AND NOT back AND coalesce(NOT next_bot AND abs(next_start - eend) <= 1800000000, false) AS fwd
    FROM (SELECT *, ebot AND coalesce(NOT kept_bot AND abs(start_us - kept_end) <= 1800000000, false) AS back
      FROM (SELECT o.channel, o.n, o.conv_id, o.start_us, o.next_start, o.next_bot, b.kept_id, b.kept_end, b.kept_bot,
          coalesce(b.carry_id, o.conv_id) AS eid, greatest(o.end_us, b.carry_end) AS eend, o.is_bot AND b.carry_id IS NULL AS ebot
        FROM bot b JOIN bo o ON o.channel = b.channel AND o.n = b.n + 1)))),
bmap AS (SELECT channel, conv_id, cluster_id, merged FROM bot WHERE n > 0),
bconv AS (SELECT c.channel, b.cluster_id AS conv_id, min(start_us) AS start_us, max(end_us) AS end_us, sum(message_count)::BIGINT AS message_count,
  sum(chars)::BIGINT AS chars, bool_or(has_work) AS has_work, max(kind) AS kind, bool_and(is_bot) AS is_bot
  FROM conv c JOIN bmap b USING (channel, conv_id) GROUP BY 1, 2)"""

TRIVIAL = """
tro AS (SELECT *, row_number() OVER w AS n, lead(start_us) OVER w AS next_start, lead(message_count) OVER w AS next_count
       FROM bconv WINDOW w AS (PARTITION BY channel ORDER BY start_us, CASE WHEN kind='t' THEN 0 ELSE 1 END, conv_id)),
tri(channel, n, conv_id, cluster_id, merged, kept_id, kept_end, kept_count, carry_id, carry_end, carry_count, carry_chars, carry_work) AS (
  SELECT DISTINCT channel, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, false, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT,
    NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN FROM bconv
  UNION ALL
  SELECT channel, n, conv_id, CASE WHEN back THEN kept_id WHEN gone THEN NULL ELSE eid END, back OR fwd,
    CASE WHEN back OR fwd OR gone THEN kept_id ELSE eid END,
    CASE WHEN back THEN greatest(kept_end, eend) WHEN fwd OR gone THEN kept_end ELSE eend END,
    CASE WHEN back THEN kept_count + ecount WHEN fwd OR gone THEN kept_count ELSE ecount END,
    CASE WHEN fwd THEN eid END, CASE WHEN fwd THEN eend END, CASE WHEN fwd THEN ecount END, CASE WHEN fwd THEN echars END, CASE WHEN fwd THEN ework END
  FROM (SELECT *, small AND NOT back AND NOT fwd AND NOT ework AS gone
    FROM (SELECT *, small AND NOT back AND coalesce(next_count > ecount AND abs(next_start - eend) <= 1800000000, false) AS fwd
      FROM (SELECT *, small AND coalesce(kept_count > ecount AND abs(start_us - kept_end) <= 1800000000, false) AS back
        FROM (SELECT *, ecount <= 2 AND echars < 100 AS small
          FROM (SELECT o.channel, o.n, o.conv_id, o.start_us, o.next_start, o.next_count, b.kept_id, b.kept_end, b.kept_count,
              coalesce(b.carry_id, o.conv_id) AS eid, greatest(o.end_us, b.carry_end) AS eend, o.message_count + coalesce(b.carry_count, 0) AS ecount,
              o.chars + coalesce(b.carry_chars, 0) AS echars, o.has_work OR coalesce(b.carry_work, false) AS ework
            FROM tri b JOIN tro o ON o.channel = b.channel AND o.n = b.n + 1)))))),
tmap AS (SELECT channel, conv_id, cluster_id, merged FROM tri WHERE n > 0),
fmap AS (SELECT b.channel, b.conv_id, t.cluster_id FROM bmap b JOIN tmap t ON t.channel = b.channel AND t.conv_id = b.cluster_id
         WHERE t.cluster_id IS NOT NULL),
fconv AS (SELECT c.channel, f.cluster_id AS conv_id, min(start_us) AS start_us, max(end_us) AS end_us, sum(message_count)::BIGINT AS message_count,
  max(kind) AS kind FROM conv c JOIN fmap f USING (channel, conv_id) GROUP BY 1, 2),
cmsg AS (SELECT s.*, f.cluster_id AS conv_id FROM (
    SELECT channel||':m:'||min(ts_us) OVER (PARTITION BY channel, seg_no) AS cid, channel, msg_id, ts_us, user_id, subtype, text FROM seg
    UNION ALL SELECT channel||':t:'||t_us, channel, msg_id, ts_us, user_id, subtype, text FROM tmsg) s
  JOIN fmap f ON f.channel = s.channel AND f.conv_id = s.cid)"""

EDGES = refs_sql("msgs") + """,
cr AS (SELECT DISTINCT m.channel, m.conv_id, r.value FROM cmsg m JOIN refs r USING (msg_id) WHERE r.type <> 'user_mention'),
pl AS (SELECT channel, conv_id, list(DISTINCT user_id) FILTER (WHERE user_id IS NOT NULL) AS p FROM cmsg GROUP BY 1, 2),
rl AS (SELECT channel, conv_id, list(value) AS r FROM cr GROUP BY 1, 2),
fc AS (SELECT f.*, row_number() OVER (PARTITION BY f.channel ORDER BY start_us, CASE WHEN kind='t' THEN 0 ELSE 1 END, f.conv_id) AS n,
  coalesce(pl.p, []) AS p, coalesce(rl.r, []) AS r
  FROM fconv f LEFT JOIN pl ON pl.channel=f.channel AND pl.conv_id=f.conv_id LEFT JOIN rl ON rl.channel=f.channel AND rl.conv_id=f.conv_id),
pr AS (SELECT i.channel, i.conv_id AS left_id, j.conv_id AS right_id, abs(j.start_us - i.end_us) AS gap,
  CASE WHEN len(i.r)+len(j.r)=0 THEN 0 ELSE len(list_intersect(i.r,j.r)) / len(list_distinct(i.r||j.r)) END AS sim,
  CASE WHEN len(i.p)=1 AND len(j.p)=1 THEN i.p[1]=j.p[1]
    ELSE len(list_distinct(i.p||j.p)) > 0 AND len(list_intersect(i.p,j.p)) / len(list_distinct(i.p||j.p)) >= 0.7 END AS same
  FROM fc i JOIN fc j ON i.channel=j.channel AND i.n < j.n AND abs(j.start_us - i.end_us) <= 21600000000),
ed0 AS (SELECT *, gap <= 900000000 AS adj,
  same AND gap <= (CASE WHEN channel LIKE 'D%' THEN 10800000000 ELSE 5400000000 END) AND sim >= (CASE WHEN channel LIKE 'D%' THEN 0.05 ELSE 0.2 END) AS prox,
  CASE WHEN same THEN gap <= 21600000000 AND sim >= 0.2 ELSE gap <= 14400000000 AND sim >= 0.4 END AS simi FROM pr),
ed AS (SELECT channel, left_id, right_id, gap AS gap_us, sim, same, CASE WHEN adj AND NOT same THEN 'adjacent'
  WHEN prox AND sim < 0.2 THEN 'proximity' WHEN same AND sim < 0.4 THEN 'same_author' END AS merged_by
  FROM ed0 WHERE adj OR prox OR simi)"""

TOPICS = """
both_ways AS (SELECT left_id AS a, right_id AS b FROM ed UNION SELECT right_id, left_id FROM ed),
reach(a, b) AS (SELECT conv_id, conv_id FROM fconv UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
tp AS (SELECT r.a AS conv_id, arg_min(f.conv_id, (f.start_us, CASE WHEN f.kind='t' THEN 0 ELSE 1 END, f.conv_id)) AS topic_id
  FROM reach r JOIN fconv f ON f.conv_id = r.b GROUP BY 1),
topic AS (SELECT f.channel, tp.topic_id, min(start_us) AS start_us,
  arg_max(end_us, (start_us, CASE WHEN kind='t' THEN 0 ELSE 1 END, f.conv_id)) AS end_us, max(end_us) AS max_end_us,
  sum(message_count)::BIGINT AS message_count, bool_or(kind='t') AS has_threads, count(*) AS conversations
  FROM fconv f JOIN tp USING (conv_id) GROUP BY 1, 2)"""

TO_CONV = (MSGS, MAIN, THREADS, CONV)
TO_TRIVIAL = (*TO_CONV, BOTS, TRIVIAL)
TO_TOPICS = (*TO_TRIVIAL, EDGES, TOPICS)


class Consolidation:
    """Stages of a consolidation. Conversation-sized results are written to the checkpoint folder between stages: a
    later stage reads each of them several times, and messages are not segmented again for every reading.

    The messages with their conversations are written too, dealt out evenly, as roll-ups, references and texts each read all of them.
    ``one_pass`` leaves that out for what reads them once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, scope: list[str] = SCOPE, one_pass: bool = False):
        self.scope, self.one_pass = scope, one_pass
        self._segmented = conversations.channel_conversations(messages(spark, sf_dir))

    @cached_property
    def conv_msgs(self) -> DataFrame:
        return self._segmented if self.one_pass else cut_lineage(dealt(self._segmented, "msg_id", "ts_us"))

    @cached_property
    def authors(self) -> DataFrame:
        """Sums per conversation and author: the one pass over the messages that roll-ups and participants share."""
        return cut_lineage(segments.author_counts(self.conv_msgs, [*self.scope, "conv_id", "kind"]))

    @cached_property
    def original(self) -> DataFrame:
        return cut_lineage(conversations.ranked(segments.roll_up_authors(self.authors, [*self.scope, "conv_id", "kind"])))

    @cached_property
    def bot_map(self) -> DataFrame:
        return cut_lineage(folds.merge_bots(self.original, self.scope))

    @cached_property
    def after_bots(self) -> DataFrame:
        return cut_lineage(folds.apply_merges(self.original, self.bot_map, self.scope))

    @cached_property
    def trivial_map(self) -> DataFrame:
        return cut_lineage(folds.merge_trivial(self.after_bots, self.scope))

    @cached_property
    def conv(self) -> DataFrame:
        return cut_lineage(folds.apply_merges(self.after_bots, self.trivial_map, self.scope))

    def _merged(self, rows: DataFrame) -> DataFrame:
        return folds.remap(folds.remap(rows, self.bot_map, self.scope), self.trivial_map, self.scope)

    @cached_property
    def kept_msgs(self) -> DataFrame:
        return self._merged(self.conv_msgs)

    @cached_property
    def conv_refs(self) -> DataFrame:
        """References are extracted before the merges, so the maps are joined to distinct values and not to messages."""
        ids = [*self.scope, "conv_id"]
        return cut_lineage(self._merged(refs.conversation_references(self.conv_msgs, ids)).groupBy(*ids, "value").agg(F.max("comparable").alias("comparable")))

    @cached_property
    def people(self) -> DataFrame:
        ids = [*self.scope, "conv_id"]
        return self._merged(self.authors.filter(F.col("user_id").isNotNull()).select(*ids, "user_id")).distinct()

    @cached_property
    def edges(self) -> DataFrame:
        return cut_lineage(merging.merge_edges(self.conv, self.conv_refs, cut_lineage(self.people), self.scope))

    @cached_property
    def members(self) -> DataFrame:
        return cut_lineage(merging.topic_members(self.conv, self.edges, self.scope))

    @cached_property
    def topics(self) -> DataFrame:
        return merging.topic_roll_up(self.conv, self.members, self.scope)


@query("bot_merge", with_(*TO_CONV, BOTS, recursive=True) + "SELECT channel, conv_id, cluster_id, merged FROM bmap")
def bot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Consolidation(spark, sf_dir, one_pass=True).bot_map


@query("trivial_merge", with_(*TO_TRIVIAL, recursive=True) + "SELECT channel, conv_id, cluster_id, merged FROM tmap")
def trivial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Consolidation(spark, sf_dir, one_pass=True).trivial_map


@query("merged_conversations", with_(*TO_TRIVIAL, recursive=True) + "SELECT channel, conv_id, start_us, end_us, message_count, kind FROM fconv")
def merged_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Consolidation(spark, sf_dir, one_pass=True).conv.select("channel", "conv_id", "start_us", "end_us", "message_count", "kind")


@query("merge_edges", with_(*TO_TRIVIAL, EDGES, recursive=True) + """
SELECT channel, left_id, right_id, gap_us, round(sim, 6) AS similarity, same AS same_author, merged_by FROM ed""")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Consolidation(spark, sf_dir).edges.select("channel", "left_id", "right_id", "gap_us", F.round("similarity", 6).alias("similarity"),
                                                   "same_author", "merged_by")


#: Vectors of ``texts.hashed_words`` for the merged conversations, and edges with the score that they change.
VECTORS = r"""
said AS (SELECT channel, conv_id, string_agg(text, ' ' ORDER BY ts_us, msg_id) AS t FROM cmsg WHERE text <> '' GROUP BY 1, 2),
hw AS (SELECT channel, conv_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 32 AS b, count(*) AS n FROM (
  SELECT channel, conv_id, unnest(string_split_regex(trim(lower(left(t, 32000)), E' \n\t'), '\s+')) AS w FROM said) WHERE w <> '' GROUP BY ALL),
vec AS (SELECT channel, conv_id, list(coalesce(n, 0)::DOUBLE ORDER BY g.b) AS v FROM (SELECT channel, conv_id, unnest(range(32)) AS b FROM said) g LEFT JOIN hw USING (channel, conv_id, b) GROUP BY 1, 2),
vpr AS (SELECT p.* REPLACE (CASE WHEN x.v IS NULL OR y.v IS NULL THEN p.sim ELSE 0.6::DOUBLE * p.sim + 0.4::DOUBLE * CASE WHEN list_dot_product(x.v, x.v) = 0 OR list_dot_product(y.v, y.v) = 0 THEN 0
    ELSE greatest(0::DOUBLE, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))) END END AS sim)
  FROM pr p LEFT JOIN vec x ON x.channel = p.channel AND x.conv_id = p.left_id LEFT JOIN vec y ON y.channel = p.channel AND y.conv_id = p.right_id)"""
LIFTED = EDGES[:EDGES.index("ed0 AS")] + VECTORS.strip() + ",\n" + EDGES[EDGES.index("ed0 AS"):].replace("FROM pr)", "FROM vpr)", 1)


@query("merge_edges_with_vectors", with_(*TO_TRIVIAL, LIFTED, recursive=True) + """
SELECT channel, left_id, right_id, gap_us, round(sim, 6) AS similarity, same AS same_author, merged_by FROM ed""")
def merge_edges_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges where what the conversations say counts beside their references."""
    c = Consolidation(spark, sf_dir)
    said = cut_lineage(texts.conversation_texts(c.kept_msgs, [*SCOPE, "conv_id"], ["ts_us", "msg_id"]))
    none = spark.createDataFrame([], "text_hash string, model string, embedding array<float>")
    made = cut_lineage(texts.embed_missing(said, none, "words", texts.hashed_words()).withColumn("model", F.lit("words")))
    vectors = texts.with_vectors(said, made, "words").select(*SCOPE, "conv_id", "embedding")
    found = merging.merge_edges(c.conv, c.conv_refs, cut_lineage(c.people), SCOPE, vectors=cut_lineage(vectors))
    return found.select("channel", "left_id", "right_id", "gap_us", F.round("similarity", 6).alias("similarity"), "same_author", "merged_by")


@query("topics", with_(*TO_TOPICS, recursive=True) + """
SELECT channel, topic_id, start_us, end_us, max_end_us, message_count, has_threads, conversations FROM topic""")
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Consolidation(spark, sf_dir).topics.drop("user_message_count")


@query("consolidation_stats", with_(*TO_TOPICS, recursive=True) + """
SELECT o.channel, o.n AS original_conversations, b.n AS bots_merged, t.m AS trivial_merged, t.d AS trivial_dropped,
  coalesce(e.a, 0) AS adjacent_merged, coalesce(e.p, 0) AS proximity_merged, coalesce(e.s, 0) AS same_author_merged,
  coalesce(g.n, 0) AS consolidated_groups, coalesce(g.r, 0) AS reference_groups_merged
FROM (SELECT channel, count(*) AS n FROM conv GROUP BY 1) o
JOIN (SELECT channel, count_if(merged)::BIGINT AS n FROM bmap GROUP BY 1) b USING (channel)
JOIN (SELECT channel, count_if(merged)::BIGINT AS m, count_if(cluster_id IS NULL)::BIGINT AS d FROM tmap GROUP BY 1) t USING (channel)
LEFT JOIN (SELECT channel, count_if(merged_by='adjacent')::BIGINT AS a, count_if(merged_by='proximity')::BIGINT AS p, count_if(merged_by='same_author')::BIGINT AS s FROM ed GROUP BY 1) e USING (channel)
LEFT JOIN (SELECT channel, count(*) AS n, sum(conversations - 1)::BIGINT AS r FROM topic GROUP BY 1) g USING (channel)""")
def consolidation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Consolidation(spark, sf_dir)
    return merging.consolidation_statistics(c.original, c.bot_map, c.trivial_map, c.edges, c.topics, SCOPE)
