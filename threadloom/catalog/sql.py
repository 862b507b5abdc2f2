"""SQL building blocks shared by the oracles; each is one or more CTEs without the leading WITH."""

MSGS = """
ev AS (
  SELECT event_id, epoch_us(ts) AS ts_us, event_type, user_id AS uid,
    CASE WHEN user_id%10=9 THEN 'D' WHEN user_id%10=8 THEN 'G' ELSE 'C' END || (user_id%10) AS channel,
    CASE WHEN event_type='signup' AND event_id%3=0 THEN NULL ELSE 'U'||user_id END AS user_id,
    CASE WHEN event_type='signup' THEN 'bot_message' END AS subtype,
    CASE event_type
      WHEN 'purchase' THEN 'Reviewed #'||(event_id%40)||' for PROJ-'||(event_id%25)
      WHEN 'error' THEN '<@U'||((user_id*7)%150)||'> TimeoutError in payments-api, 500 error on #'||(event_id%40)
      WHEN 'signup' THEN 'Build #'||(event_id%40)||' passed'
      WHEN 'click' THEN CASE WHEN event_id%2=0 THEN 'ok' ELSE 'confirmed' END
      ELSE 'Planning notes '||(event_id%97) END AS text
  FROM events),
msgs AS (
  SELECT event_id AS msg_id, channel, ts_us, user_id, subtype, text, event_type,
    CASE WHEN event_type='view' THEN
      first_value(ts_us) OVER (PARTITION BY channel, ts_us // 86400000000 ORDER BY ts_us, event_id) END AS thread_us
  FROM ev)"""

MAIN = """
main AS (SELECT * FROM msgs WHERE thread_us IS NULL OR thread_us = ts_us),
flagged AS (
  SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w >= 3600000000 THEN 1 ELSE 0 END AS opens
  FROM main WINDOW w AS (PARTITION BY channel ORDER BY ts_us, msg_id)),
seg AS (
  SELECT *, sum(opens) OVER (PARTITION BY channel ORDER BY ts_us, msg_id) AS seg_no FROM flagged)"""

WORK = ("'(?i)\\b(confirm(ed|ing)?|verif(y|ied|ying)|test(ed|ing)?|check(ed|ing)?|fix(ed|ing)?|done|complete[d]?|approve[d]?"
        "|review(ed|ing)?|resolve[d]?|merge[d]?|deploy(ed|ing)?|update[d]?|ship(ped|ping)?|launch(ed|ing)?|release[d]?)\\b'")

THREADS = """
tkeys AS (SELECT DISTINCT channel, thread_us FROM msgs WHERE thread_us IS NOT NULL),
tmsg AS (
  SELECT k.thread_us AS t_us, m.* EXCLUDE (thread_us) FROM tkeys k JOIN msgs m
    ON m.channel = k.channel AND coalesce(m.thread_us, m.ts_us) = k.thread_us)"""

ROLL = """count(*) AS message_count, min(ts_us) AS start_us, max(ts_us) AS end_us, count(DISTINCT user_id) AS participant_count,
  bool_and(coalesce(subtype='bot_message', false) OR user_id IS NULL AND text <> '') AS is_bot,
  sum(length(text)) AS chars, bool_or(regexp_matches(text, """ + WORK + """)) AS has_work"""

CONV = f"""
conv0 AS (
  SELECT channel, 'm' AS kind, seg_no AS grp, {ROLL} FROM seg GROUP BY channel, seg_no
  UNION ALL
  SELECT channel, 't' AS kind, t_us AS grp, {ROLL} FROM tmsg GROUP BY channel, t_us),
conv AS (
  SELECT *, channel||':'||kind||':'||(CASE WHEN kind='m' THEN start_us ELSE grp END) AS conv_id FROM conv0)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"
