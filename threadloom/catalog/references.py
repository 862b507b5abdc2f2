"""Queries on references and similarity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.catalog.registry import query
from threadloom.catalog.sql import MAIN, MSGS, with_
from threadloom.functions import references as refs, similarity
from threadloom.operators import conversations, merging, segments
from threadloom.operators.ordered import ordered
from threadloom.sources.event_feed import messages, reference_texts, table


def _each(source: str, pattern: str, type_: str, value: str) -> str:
    return f"SELECT msg_id, '{type_}' AS type, {value} AS value FROM (SELECT msg_id, unnest(regexp_extract_all(text, '{pattern}', 1)) AS v FROM {source})"


# The same types for an RE2 engine; plain word edges are ASCII there.
RE2 = [
    ("github_issue", r"(?:^|[\s(\[])(?:[\w-]+/[\w-]+#|#)(\d+)\b", "'#'||v"),
    ("github_url", r"(?i)github\.com/[\w-]+/[\w-]+/(?:issues|pull)/(\d+)", "'#'||v"),
    ("gitlab", r"(?i)gitlab\.com/[\w-]+(?:/[\w-]+)+/-/(?:issues|merge_requests)/(\d+)", "'gitlab:'||v"),
    ("ticket", r"\b([A-Z]{2,}[A-Z0-9]*-\d+)\b", "upper(v)"),
    ("figma", r"(?i)figma\.com/(?:file|design|board)/([a-zA-Z0-9]+)", "'figma:'||v"),
    ("notion", r"(?i)notion\.(?:so|site)/(?:[\w-]+/)*([a-f0-9]{32}|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})", "'notion:'||replace(v,'-','')"),
    ("confluence", r"(?i)atlassian\.net/wiki/spaces/[\w-]+/pages/(\d+)", "'confluence:'||v"),
    ("gdoc", r"(?i)docs\.google\.com/document/d/([\w-]+)", "'gdoc:'||v"),
    ("gsheet", r"(?i)docs\.google\.com/spreadsheets/d/([\w-]+)", "'gsheet:'||v"),
    ("gslide", r"(?i)docs\.google\.com/presentation/d/([\w-]+)", "'gslide:'||v"),
    ("asana", r"(?i)app\.asana\.com/\d+/\d+/(\d+)", "'asana:'||v"),
    ("clickup", r"(?i)app\.clickup\.com/t/([a-z0-9]+)", "'clickup:'||v"),
    ("sentry", r"(?i)sentry\.io/(?:organizations/)?[\w-]+/issues/(\d+)", "'sentry:'||v"),
    ("datadog", r"(?i)app\.datadoghq\.com/(?:dashboard|monitors|apm|logs)/([a-zA-Z0-9-]+)", "'datadog:'||v"),
    ("pagerduty", r"(?i)[\w-]+\.pagerduty\.com/incidents/([A-Z0-9]+)", "'pagerduty:'||v"),
    ("zendesk", r"(?i)[\w-]+\.zendesk\.com/agent/tickets/(\d+)", "'zendesk:'||v"),
    ("salesforce", r"(?i)[\w-]+\.(?:(?:my\.)?salesforce|lightning\.force)\.com/.*?(?:Case|cases)/([a-zA-Z0-9]{15,18})", "'sfdc:'||v"),
    ("error_pattern", r"(?i)\b([a-z]{2,}(?:error|exception))\b", "lower(v)"),
    ("error_pattern", r"(?i)\b([45]\d{2})\s+(?:error|status)\b", "lower(v)"),
    ("user_mention", r"<@(U[A-Z0-9]+)(?:\|[^>]+)?>", "v"),
    ("aws_log_group", r"(?i)cloudwatch[^#]*#[^/]*log-groups/log-group(?:/|%252F|\$252F)([a-zA-Z0-9_-]+)", "lower(v)"),
    ("service_name", r"(?i)\b([a-z][a-z0-9]*-(?:auth|api|web|service|worker|backend|frontend|core|app))\b", "lower(v)"),
]


def refs_sql(source: str) -> str:
    links = (f"SELECT msg_id, 'slack_message' AS type, 'slack:'||c||':'||(CASE WHEN length(p) > 10 THEN p[:10]||'.'||p[11:] ELSE p END) AS value "
             f"FROM (SELECT msg_id, unnest(regexp_extract_all(text, '(?i)https?://[\\w-]+\\.slack\\.com/archives/([A-Z0-9]+)/p(\\d+)', 1)) AS c, "
             f"unnest(regexp_extract_all(text, '(?i)https?://[\\w-]+\\.slack\\.com/archives/([A-Z0-9]+)/p(\\d+)', 2)) AS p FROM {source})")
    return "refs AS (\n" + "\nUNION ALL ".join([_each(source, p, t, v) for t, p, v in RE2] + [links]) + ")"


WOVEN = """
woven AS (SELECT msg_id, text || ' ' || CASE msg_id % 22
  WHEN 0 THEN 'see acme/app#'||msg_id WHEN 1 THEN 'https://github.com/acme/app/pull/'||msg_id
  WHEN 2 THEN 'https://gitlab.com/acme/group/app/-/merge_requests/'||msg_id WHEN 3 THEN 'AUTH2-'||msg_id||' and x9AB-1'
  WHEN 4 THEN 'https://www.figma.com/design/Ab'||msg_id||'/title' WHEN 5 THEN 'https://www.notion.so/acme/'||md5(msg_id::VARCHAR)
  WHEN 6 THEN 'https://acme.atlassian.net/wiki/spaces/ENG/pages/'||msg_id||'/Plan'
  WHEN 7 THEN 'https://docs.google.com/document/d/doc_'||msg_id||'/edit' WHEN 8 THEN 'https://docs.google.com/spreadsheets/d/sheet-'||msg_id
  WHEN 9 THEN 'https://docs.google.com/presentation/d/p'||msg_id WHEN 10 THEN 'https://app.asana.com/0/77/'||msg_id
  WHEN 11 THEN 'https://app.clickup.com/t/ab'||msg_id WHEN 12 THEN 'https://sentry.io/organizations/acme/issues/'||msg_id||'/'
  WHEN 13 THEN 'https://app.datadoghq.com/monitors/m-'||msg_id WHEN 14 THEN 'https://acme.pagerduty.com/incidents/Q'||msg_id
  WHEN 15 THEN 'https://acme.zendesk.com/agent/tickets/'||msg_id
  WHEN 16 THEN 'https://acme.lightning.force.com/lightning/r/Case/'||lpad(msg_id::VARCHAR,15,'0')||'/view'
  WHEN 17 THEN 'NullPointerException, Error and 404 status in job '||msg_id WHEN 18 THEN '<@U'||msg_id||'|sam> and <@W1>'
  WHEN 19 THEN 'https://eu.console.aws.amazon.com/cloudwatch/home#logsV2:log-groups/log-group/App_'||msg_id
  WHEN 20 THEN 'Billing'||msg_id||'prd-worker is slow'
  ELSE 'https://acme.slack.com/archives/C1/p1704067200'||lpad(msg_id::VARCHAR,6,'0')||'?thread_ts=1 twice' END AS text FROM msgs)"""

CONV_REFS = refs_sql("msgs") + """,
cref AS (SELECT DISTINCT channel, seg_no, value, type <> 'user_mention' AS comparable FROM seg JOIN refs USING (msg_id))"""


@query("references", with_(MSGS, refs_sql("msgs")) + "SELECT msg_id, type, value, count(*) AS n FROM refs GROUP BY 1, 2, 3")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.extract(messages(spark, sf_dir), "msg_id").groupBy("msg_id", "type", "value").agg(F.count(F.lit(1)).alias("n"))


@query("reference_kinds", with_(MSGS, WOVEN, refs_sql("woven")) + "SELECT msg_id, type, value, count(*) AS n FROM refs GROUP BY 1, 2, 3")
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refs.extract(reference_texts(messages(spark, sf_dir)), "msg_id")
    return found.groupBy("msg_id", "type", "value").agg(F.count(F.lit(1)).alias("n"))


@query("conversation_refs", with_(MSGS, MAIN, CONV_REFS) + """
SELECT channel, seg_no, value, bool_or(comparable) AS comparable FROM cref GROUP BY 1, 2, 3""")
def conversation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = segments.gap_segments(segments.main_messages(messages(spark, sf_dir)))
    return refs.conversation_references(tagged, ["channel", "seg_no"])


@query("ref_jaccard_pairs", with_(MSGS, MAIN, CONV_REFS) + """,
sp AS (SELECT channel, seg_no, min(ts_us) AS s, max(ts_us) AS e FROM seg GROUP BY 1, 2),
sz AS (SELECT channel, seg_no, count(DISTINCT value) AS n FROM cref WHERE comparable GROUP BY 1, 2),
sh AS (SELECT a.channel, a.seg_no AS i, b.seg_no AS j, count(DISTINCT a.value) AS shared
       FROM cref a JOIN cref b ON a.channel=b.channel AND a.value=b.value AND a.comparable AND b.comparable AND a.seg_no < b.seg_no
       JOIN sp p ON p.channel=a.channel AND p.seg_no=a.seg_no JOIN sp q ON q.channel=b.channel AND q.seg_no=b.seg_no
       WHERE abs(q.s - p.e) <= 21600000000 GROUP BY 1, 2, 3)
SELECT sh.channel, i, j, shared, round(shared / (x.n + y.n - shared), 6) AS similarity
FROM sh JOIN sz x ON x.channel=sh.channel AND x.seg_no=i JOIN sz y ON y.channel=sh.channel AND y.seg_no=j""")
def ref_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = messages(spark, sf_dir)
    tagged = segments.gap_segments(segments.main_messages(msgs)).withColumn("conv_id", F.col("seg_no"))
    conv = tagged.groupBy("channel", "conv_id").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us")).withColumn(
        "kind_rank", F.lit(1))
    pairs = merging.shared_reference_pairs(conv, refs.conversation_references(tagged, ["channel", "conv_id"]), ["channel"])
    return pairs.select("channel", F.col("left_id").alias("i"), F.col("right_id").alias("j"), "shared",
                        F.round("similarity", 6).alias("similarity"))


@query("cosine_neighbours", """
WITH p AS (SELECT label, vec_id, lead(vec_id) OVER w AS next_id, embedding AS a, lead(embedding) OVER w AS b
           FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, next_id, round(list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), 6) AS cosine FROM p WHERE next_id IS NOT NULL""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    near = ordered(vectors, ["label"], ts="vec_id", tie=(), width_us=1000,
                   following={"next_id": F.col("vec_id"), "next_vector": F.col("embedding")})
    return near.filter(F.col("next_id").isNotNull()).select(
        "label", "vec_id", "next_id", F.round(similarity.cosine(F.col("embedding"), F.col("next_vector")), 6).alias("cosine"))


@query("hybrid_similarity", with_(MSGS, MAIN, CONV_REFS) + """,
sp AS (SELECT channel, seg_no, min(ts_us) AS s, arg_min(msg_id, (ts_us, msg_id)) AS first_msg FROM seg GROUP BY 1, 2),
nx AS (SELECT channel, seg_no AS i, lead(seg_no) OVER w AS j, first_msg AS fi, lead(first_msg) OVER w AS fj FROM sp
       WINDOW w AS (PARTITION BY channel ORDER BY seg_no)),
r AS (SELECT DISTINCT channel, seg_no, value FROM cref WHERE comparable),
x AS (SELECT nx.*, (SELECT count(*) FROM r WHERE r.channel=nx.channel AND r.seg_no=i) AS ni,
  (SELECT count(*) FROM r WHERE r.channel=nx.channel AND r.seg_no=j) AS nj,
  (SELECT count(*) FROM r JOIN r q ON r.channel=q.channel AND r.value=q.value WHERE r.channel=nx.channel AND r.seg_no=i AND q.seg_no=j) AS sh
  FROM nx WHERE j IS NOT NULL),
y AS (SELECT *, CASE WHEN ni+nj-sh > 0 THEN sh/(ni+nj-sh) ELSE 0 END AS rs FROM x)
SELECT y.channel, i, j, round(CASE WHEN a.embedding IS NULL OR b.embedding IS NULL THEN rs
  ELSE 0.6*rs + 0.4*greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) END, 6) AS score
FROM y LEFT JOIN embeddings a ON a.vec_id=fi LEFT JOIN embeddings b ON b.vec_id=fj""")
def hybrid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment against the next one of its channel; some have a vector, some do not."""
    tagged = segments.gap_segments(segments.main_messages(messages(spark, sf_dir)))
    firsts = tagged.groupBy("channel", "seg_no").agg(F.min_by("msg_id", F.struct("ts_us", "msg_id")).alias("first_msg"))
    near = ordered(firsts, ["channel"], ts="seg_no", tie=(), width_us=1000,
                   following={"j": F.col("seg_no"), "fj": F.col("first_msg")}).filter(F.col("j").isNotNull())
    near = near.withColumnsRenamed({"seg_no": "i", "first_msg": "fi"})
    values = refs.conversation_references(tagged, ["channel", "seg_no"]).filter("comparable").select("channel", "seg_no", "value")
    sizes = values.groupBy("channel", "seg_no").agg(F.count(F.lit(1)).alias("n"))
    # One row per (pair, value of its first segment), matched on value: linear in the number of references.
    left = near.select("channel", "i", "j").join(values.withColumnRenamed("seg_no", "i"), ["channel", "i"])
    shared = left.join(values.withColumnRenamed("seg_no", "j"), ["channel", "j", "value"]).groupBy("channel", "i", "j").agg(
        F.count(F.lit(1)).alias("sh"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    wide = (near.join(sizes.withColumnsRenamed({"seg_no": "i", "n": "ni"}), ["channel", "i"], "left")
            .join(sizes.withColumnsRenamed({"seg_no": "j", "n": "nj"}), ["channel", "j"], "left")
            .join(shared, ["channel", "i", "j"], "left")
            .join(vectors.withColumnsRenamed({"vec_id": "fi", "embedding": "a"}), "fi", "left")
            .join(vectors.withColumnsRenamed({"vec_id": "fj", "embedding": "b"}), "fj", "left"))
    zero = F.lit(0)
    score = similarity.jaccard_from_sizes(F.coalesce("sh", zero), F.coalesce("ni", zero), F.coalesce("nj", zero))
    return wide.select("channel", "i", "j", F.round(similarity.hybrid(score, F.col("a"), F.col("b")), 6).alias("score"))


@query("same_author_pairs", with_(MSGS, MAIN) + """,
sp AS (SELECT channel, seg_no, list(DISTINCT user_id) FILTER (WHERE user_id IS NOT NULL) AS p0 FROM seg GROUP BY 1, 2),
ps AS (SELECT channel, seg_no, coalesce(p0, []) AS p FROM sp),
nx AS (SELECT channel, seg_no AS i, lead(seg_no) OVER w AS j, p AS a, lead(p) OVER w AS b FROM ps WINDOW w AS (PARTITION BY channel ORDER BY seg_no))
SELECT channel, i, j, CASE WHEN len(a)=1 AND len(b)=1 THEN a[1]=b[1]
  ELSE len(list_distinct(a||b)) > 0 AND len(list_intersect(a,b)) / len(list_distinct(a||b)) >= 0.7 END AS same_author
FROM nx WHERE j IS NOT NULL""")
def same_author_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = segments.gap_segments(segments.main_messages(messages(spark, sf_dir))).withColumnRenamed("seg_no", "conv_id")
    people = segments.participants(tagged, ["channel", "conv_id"])
    convs = tagged.select("channel", "conv_id").distinct()
    near = ordered(convs, ["channel"], ts="conv_id", tie=(), width_us=1000, following={"right_id": F.col("conv_id")}).filter(
        F.col("right_id").isNotNull()).withColumnRenamed("conv_id", "left_id")
    return merging.with_same_author(near, people, ["channel"]).select(
        "channel", F.col("left_id").alias("i"), F.col("right_id").alias("j"), "same_author")
