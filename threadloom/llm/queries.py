"""The registered queries of the operators and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import chats, exact, extraction, jaccard, langid, leaks, licenses, mixing, phrases, repairs, substrings, tokens, urls
from threadloom.llm.common import ORACLES, QUERIES, query, table  # noqa: F401
from threadloom.session import shared_folder

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
  CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS no FROM s),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM p),
f AS (SELECT *, cap::DOUBLE / w AS full_at FROM w),
l AS (SELECT *, (1.5 * (SELECT sum(source_size)::DOUBLE FROM s) - coalesce(sum(cap) OVER (ORDER BY full_at, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER (ORDER BY full_at, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN full_at >= a THEN w * a ELSE cap::DOUBLE END AS target FROM l, (SELECT arg_min(level, {'f': full_at, 'n': no}) AS a FROM l WHERE level <= full_at)),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM k),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS til FROM g),
x AS (SELECT c.source, c.h, rest > 0 AND (til <= rest OR (til - n <= rest AND til - rest < rest - (til - n))) AS once FROM c JOIN r ON r.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, d.source, d.size::BIGINT AS size, r.source_size, r.target, (r.whole + x.once::INT)::BIGINT AS copies, ((r.whole + x.once::INT) * d.size)::BIGINT AS taken
FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source JOIN x ON x.source IS NOT DISTINCT FROM d.source AND x.h = d.h"""


@query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_folder(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_digests(spark, path)


JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
c AS (SELECT min(doc_id) AS rep, len(g) AS n, g FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT rep, n, unnest(g[1:n - (n * 85 + 99) // 100 + 1]) AS t FROM c),
p AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
e AS (SELECT a, b FROM (SELECT a, b, ca.n AS n, cb.n AS m, len(list_intersect(ca.g, cb.g)) AS o FROM p JOIN c ca ON ca.rep = a JOIN c cb ON cb.rep = b) WHERE 100 * o >= 85 * (n + m - o)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen),
k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN k ON k.node = c.rep"""


@query("op3_near_copies", JACCARD_SQL)
def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


LEAK_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, greatest(0, len(w) - least(10, len(w)) + 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
sizes AS (SELECT DISTINCT n FROM win),
di AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
occ AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM di) x JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op4_benchmark_leaks", LEAK_SQL)
def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


RULES_SQL = """
WITH r(rule, verdict, host, path) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
n AS (SELECT DISTINCT host, path FROM v),
m AS (SELECT n.host, n.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM n JOIN r
  ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY ALL)
SELECT page_id, v.host, v.path, rule, coalesce(verdict, CASE WHEN regexp_matches(v.host, '(^|[.-])(""" + "|".join(
    ("spam-farm", "cheap-pills", "casino", "free-money", "adult", "malware", "phishing", "warez")) + """)([.:-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN m ON m.host = v.host AND m.path = v.path"""


@query("op5_url_filters", RULES_SQL)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rule_table(spark, urls.CONTRACT_RULES + urls.WORD_RULES)
    return urls.judge(table(spark, sf_dir, "pages"), rules)


@query("op6_repeated_substrings")
def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~F.coalesce(langid.held_out(), F.lit(False))))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"),
                        F.col("_language.loss").alias("loss"), F.col("_language.rejected").alias("rejected"))


#: Documents as files: a directory per source, one per thousand ids and one per hundred; every twentieth id is a license file.
FILE_PATH = "concat(coalesce(source, 'none'), '/', cast(floor(doc_id / 1000) as int), '/', cast(floor(doc_id / 100) as int), '/', CASE WHEN doc_id % 20 = 0 THEN 'LICENSE.' ELSE 'file.' END, doc_id)"

LICENSE_SQL = r"""
WITH f AS (SELECT doc_id, """ + FILE_PATH + r""" AS path, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t(license, said) AS (VALUES """ + ", ".join(f"('{k}', '{v.lower()}')" for k, v in licenses.TEMPLATES.items()) + r"""),
tt AS (SELECT license, term, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(said, '[a-z0-9]+')) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z0-9]+'))) AS term FROM f) WHERE term IN (SELECT term FROM tt) GROUP BY 1),
n AS (SELECT count(*) AS n FROM f),
idf AS (SELECT DISTINCT tt.term, ln((1 + n.n) / (1 + coalesce(df.n, 0))) + 1 AS idf FROM n, tt LEFT JOIN df USING (term)),
tw AS (SELECT license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT license, sqrt(sum(w * w)) AS norm FROM tw GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM f),
lt AS (SELECT doc_id, no, term, count(*) AS tf FROM (SELECT doc_id, no, unnest(regexp_extract_all(line, '[a-z0-9]+')) AS term FROM l) GROUP BY ALL),
lw AS (SELECT doc_id, no, term, tf * coalesce(idf, ln(1 + (SELECT n FROM n)) + 1) AS w FROM lt LEFT JOIN idf USING (term)),
ln_ AS (SELECT doc_id, no, sqrt(sum(w * w)) AS norm FROM lw GROUP BY ALL),
s AS (SELECT doc_id, no, license, sum(lw.w * tw.w) AS dot FROM lw JOIN tw USING (term) GROUP BY ALL),
c AS (SELECT doc_id, license, round(dot / ln_.norm / tn.norm, 6) AS score FROM s JOIN ln_ USING (doc_id, no) JOIN tn USING (license) WHERE round(dot / ln_.norm / tn.norm, 6) >= 0.75),
own AS (SELECT doc_id, license, score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
o AS (SELECT f.doc_id, f.path, own.license, own.score, regexp_extract(f.path, '^(.*)/', 1) AS dir FROM f LEFT JOIN own USING (doc_id)),
d AS (SELECT dir, license, score, path FROM o WHERE license IS NOT NULL AND contains(path, '/LICENSE.') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
i AS (SELECT o.doc_id, d.license, d.score, d.path FROM o JOIN d ON o.license IS NULL AND (d.dir = o.dir OR starts_with(o.dir, d.dir || '/')) QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(d.dir) DESC) = 1)
SELECT o.doc_id, o.path, coalesce(o.license, i.license) AS license, CASE WHEN o.license IS NOT NULL THEN 'own' WHEN i.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  coalesce(o.score, i.score) AS score, CASE WHEN o.license IS NOT NULL THEN o.path ELSE i.path END AS from_path FROM o LEFT JOIN i USING (doc_id)"""


@query("op8_license_scan", LICENSE_SQL)
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; the tables have no paths, so these are made from source and id."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", F.expr(FILE_PATH).alias("path"), "text"))


def _escaped_sql(text: str) -> str:
    pieces = "<\\|", "<s>", "</s>", "\\[INST\\]", "\\[/INST\\]", "<<SYS>>", "<</SYS>>"
    return f"len(regexp_extract_all({text}, '\\\\')) + len(regexp_extract_all({text}, '{'|'.join(pieces)}'))"


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, row_number() OVER w AS place, len(regexp_extract_all(text, '[^ \t\n\f\r\x0B]+')) + 4 AS tokens,
  23 + length(role) + """ + _escaped_sql("role") + " + length(text) + " + _escaped_sql("text") + r""" AS chars FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS til FROM t),
b AS (SELECT *, ((til - tokens) // 1536)::BIGINT AS b1, ((til - 1) // 1536)::BIGINT AS b2 FROM u),
n AS (SELECT *, b1 * 2 + (b1 <> b2)::INT AS window_no FROM b),
s AS (SELECT conv_id, window_no, min(place) AS at, 2048 - sum(tokens) AS room FROM n GROUP BY ALL HAVING min(place) > 1),
h AS (SELECT s.conv_id, s.window_no, s.room, n.chars, sum(n.tokens) OVER (PARTITION BY s.conv_id, s.window_no ORDER BY n.place = 1 AND n.role = 'system' DESC, n.place DESC) AS used
  FROM s JOIN n ON n.conv_id = s.conv_id AND CASE WHEN n.place = 1 AND n.role = 'system' THEN n.tokens <= s.room ELSE n.place BETWEEN s.at - 2 AND s.at - 1 END),
o AS (SELECT conv_id, sum(chars) AS again FROM h WHERE used <= room GROUP BY 1)
SELECT n.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + coalesce(any_value(again), 0))::BIGINT AS formatted_chars
FROM n LEFT JOIN o ON o.conv_id = n.conv_id GROUP BY n.conv_id"""


@query("op9_chat_windows", CHAT_SQL)
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chats.digest(chats.windows(turns))


@query("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the ids is the snapshot, the newer half the incoming batch."""
    docs = table(spark, sf_dir, "documents")
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()  # two numbers
    middle = 0 if ends["a"] is None else (ends["a"] + ends["b"]) // 2
    found = exact.exact_groups(docs, F.col("doc_id") <= middle)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS ws FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) x(k) WHERE len(w) >= k)),
f AS (SELECT lang, ws, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
s AS (SELECT c.lang, c.ws, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score FROM c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:c.k]
  JOIN f y ON y.lang = c.lang AND y.ws = c.ws[c.k + 1:len(c.ws)] JOIN t ON t.lang = c.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
i AS (SELECT f.lang, f.ws[z0:z0 + size - 1] AS ws, max(f.f) AS f FROM f, range(2, 5) z(size), range(1, 5) y(z0) WHERE size < len(f.ws) AND z0 + size - 1 <= len(f.ws) GROUP BY ALL),
o AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.ws = m.ws WHERE i.f IS NULL OR i.f < m.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(ws, ' '))) AS rank, array_to_string(ws, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
  n::BIGINT AS n, score::BIGINT AS score FROM o QUALIFY rank <= 2000"""


@query("op11_phrases", PHRASE_SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_html_text")
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).drop("host", "wrapper")


def _crc32_sql(text: str) -> str:
    """``crc32`` of an ASCII string, half a byte at a time; DuckDB has no such function."""
    def shifted(half: int) -> int:
        for _ in range(4):
            half = half >> 1 ^ (0xEDB88320 if half & 1 else 0)
        return half

    half = "[" + ", ".join(str(shifted(i)) for i in range(16)) + "]::BIGINT[]"
    low = f"xor(({half})[1 + (xor(c, b) & 15)], c >> 4)"
    both = f"xor(({half})[1 + (xor({low}, b >> 4) & 15)], ({low}) >> 4)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {both}), 4294967295)"


REPAIR_SQL = r"""
WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT conv_id, turn, role, text, """ + _crc32_sql("key") + r""" % 20 AS code FROM z),
e AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p,
  NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS broken FROM e),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS again FROM o),
g AS (SELECT *, blank OR again > 1 AS forced, left(lag(role) OVER (PARTITION BY conv_id ORDER BY p), 1) || left(role, 1) AS two FROM h),
ins(x, y, c, s, l) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']),
  (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
mv(y, s, role, z, c, who) AS (VALUES (0, 'D', '', 0, 3, ''), (1, 'D', '', 1, 3, ''), (2, 'D', '', 2, 3, ''), (3, 'D', '', 3, 3, ''), (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''),
  (2, 'K', 'a', 3, 0, ''), (3, 'K', 'u', 2, 0, ''), (0, 'R', '', 2, 2, 'user'), (1, 'R', '', 2, 2, 'user'), (2, 'R', '', 3, 2, 'assistant'), (3, 'R', '', 2, 2, 'user')),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS p, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM g
  UNION ALL SELECT conv_id, p, state, b.c, b.a, b.l FROM (SELECT conv_id, p, state, arg_min({'c': cost, 'a': audit, 'l': lines}, {'c': cost, 'a': audit}) AS b FROM (
    SELECT r.conv_id, g.p, mv.z AS state, r.cost + ins.c + mv.c + CASE WHEN mv.s <> 'D' AND g.broken THEN 1 ELSE 0 END AS cost, r.audit || ins.s || mv.s AS audit,
      list_concat(list_concat(r.lines, ins.l), CASE mv.s WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [g.role || ':' || g.text] ELSE [mv.who || ':' || g.text] END) AS lines
    FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.p = r.p + 1 JOIN ins ON ins.x = r.state
    JOIN mv ON mv.y = ins.y AND (mv.s = 'D' OR NOT g.forced AND (mv.s = 'R' OR mv.role = left(g.role, 1)))) GROUP BY conv_id, p, state)),
n AS (SELECT conv_id, count(*) AS n, (max(turn) - min(turn) + 1 - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again > 1) AS duplicate,
  count(*) FILTER (NOT blank AND again = 1 AND broken) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
f AS (SELECT r.conv_id, arg_min({'c': r.cost + l.c, 'a': r.audit || l.s, 'l': list_concat(r.lines, l.l)}, {'c': r.cost + l.c, 'a': r.audit || l.s}) AS b FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.n = r.p
  JOIN (VALUES (0, 0, '', []::VARCHAR[]), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']), (3, 0, '', [])) l(state, c, s, l) ON l.state = r.state GROUP BY r.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id"""


@query("op13_repairs", REPAIR_SQL)
def op13_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return repairs.repair(repairs.damaged(said), said)
