"""Queries over pairs and topics: the knowledge queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions import topics as t
from tracefold.operators import queue as q
from tracefold.operators.sequence import RANGE, range_blocks, running_total
from tracefold.operators.turns import build_pairs
from tracefold.plans.catalog import query, with_ctes
from tracefold.plans.catalog.conversations import PAIRS
from tracefold.plans.catalog.given_sql import REC, TITLES
from tracefold.plans.catalog.outcomes import FAMILIES, PROJECT
from tracefold.session import cut_lineage
from tracefold.sources import given_tables as g

NOW = "2024-01-05 12:00:00"
TOPIC_HASH = "'topic:' || left(sha256(anchor), 24)"
CLASS = """CASE WHEN starts_with(prompt_content, '[no-obsidian]') THEN 'no-op' WHEN NOT starts_with(prompt_content, 'Automation ID: ') THEN 'ordinary'
  WHEN contains(stop_content, 'message_id') THEN 'substantive' WHEN contains(stop_content, '队列为空') THEN 'no-op' ELSE 'substantive' END"""

# Processed and settled events: by the pair's own numbers.
SORTED = f"""
sorted_pairs AS (SELECT pairs.*, {CLASS} AS automation, conv_id % 3 <> 1 AS pending, length(prompt_content) + length(stop_content) AS chars FROM pairs)"""
SEGMENTS = f"""
seg0 AS (
  SELECT p.*, source || ':' || session_id AS session_key, lower({PROJECT}) AS project_path, fam.family_anchor, titles.title AS index_title,
    CASE WHEN source = 'chatgpt_web' THEN 'chatgpt:' || session_id
      WHEN automation = 'substantive' THEN 'automation:自动化:' || date
      WHEN regexp_matches(prompt_content || chr(10) || stop_content, '\\b(?:issue|议题|问题单)\\s*#?(\\d{{1,8}})\\b', 'i')
        THEN 'codex:' || lower({PROJECT}) || ':issue:' || regexp_extract(prompt_content || chr(10) || stop_content, '\\b(?:issue|议题|问题单)\\s*#?(\\d{{1,8}})\\b', 1, 'i') END AS explicit,
    CASE WHEN starts_with(prompt_content, '新任务：') THEN regexp_extract(string_split(prompt_content, chr(10))[1], '^新任务：\\s*(.+)$', 1) END AS goal_line
  FROM sorted_pairs p LEFT JOIN families fam USING (session_id) LEFT JOIN titles USING (session_id) WHERE automation <> 'no-op'
), seg1 AS (
  SELECT *, left(substr(trim(regexp_replace('新任务：' || goal_line, '[。.]\\s*严格遵循\\s*[:：].*$', '', 'i')), 1, 72), 72) AS goal_title, row_number() OVER w = 1 AS first_row FROM seg0
  WINDOW w AS (PARTITION BY session_key ORDER BY captured_at, id)
), seg2 AS (
  SELECT *, CASE WHEN goal_line IS NOT NULL THEN left(trim(substr(goal_title, 5)), 72) END AS goal FROM seg1
), seg3 AS (
  SELECT *, coalesce(explicit, CASE WHEN first_row THEN coalesce(family_anchor, 'codex:' || project_path || ':session:' || session_id)
      WHEN goal IS NOT NULL THEN 'codex:' || project_path || ':session:' || session_id || ':segment:' || left(sha256(goal), 16) END) AS state FROM seg2
), seg4 AS (
  SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY captured_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM seg3
), segments AS (
  SELECT *, coalesce(state, prev) AS anchor, first_row OR coalesce(explicit <> prev, false) OR goal IS NOT NULL AS opens FROM seg4
)"""
BASE = [REC, TITLES, PAIRS, FAMILIES, SORTED, SEGMENTS]


def _sorted(spark, sf):
    pairs = build_pairs(g.conversations_as_records(spark, sf))
    conv = F.substring("session_id", 2, 12).cast("long")
    return q.sort_pairs(pairs.withColumn("pending", conv % 3 != 1), g.labels_as_index(spark, sf))


def _segments(spark, sf):
    kept = _sorted(spark, sf).where(F.col("queue_class").isin("substantive", "candidate"))
    return q.segment_sessions(kept, g.labels_as_index(spark, sf))


def _ledger(spark, sf):
    """Settlements of every other conversation's first turn: id, status, update time; and their events."""
    pairs = build_pairs(g.conversations_as_records(spark, sf))
    conv = F.substring("session_id", 2, 12).cast("long")
    rows = pairs.where((conv % 2 == 0) & (F.col("turn_id") == "t1"))
    ledger = rows.select(
        F.concat(F.when(conv % 14 == 0, "outcome:backfill:").otherwise("outcome:"), "session_id").alias("id"),
        F.when(conv % 8 == 0, "failed").when(conv % 8 == 2, "pending").when(conv % 8 == 4, "succeeded").otherwise("not-applicable").alias("status"),
        F.timestamp_micros(F.unix_micros("captured_at") + (conv % 5) * 3_600_000_000).alias("updated_at"),
    )
    events = rows.select(
        F.concat(F.when(conv % 14 == 0, "outcome:backfill:").otherwise("outcome:"), "session_id").alias("settlement_id"),
        F.explode("source_event_ids").alias("event_id"),
    )
    return ledger, events


QLEDGER = """
qledger AS (
  SELECT CASE WHEN conv_id % 14 = 0 THEN 'outcome:backfill:' ELSE 'outcome:' END || session_id AS id,
    CASE conv_id % 8 WHEN 0 THEN 'failed' WHEN 2 THEN 'pending' WHEN 4 THEN 'succeeded' ELSE 'not-applicable' END AS status,
    captured_at + to_hours(CAST(conv_id % 5 AS INT)) AS updated_at, prompt_id, stop_id FROM pairs WHERE conv_id % 2 = 0 AND turn_id = 't1'
), qevents AS (SELECT id AS settlement_id, prompt_id AS event_id FROM qledger UNION ALL SELECT id, stop_id FROM qledger)"""
TOPICS = f"""
tp AS (SELECT *, {TOPIC_HASH} AS topic_id FROM segments),
tev AS (SELECT topic_id, prompt_id AS event_id FROM tp UNION SELECT topic_id, stop_id FROM tp),
tm AS (SELECT topic_id, settlement_id, count(*) AS shared FROM tev JOIN qevents USING (event_id) GROUP BY ALL),
tatt AS (
  SELECT topic_id, count(*) FILTER (status IN ('pending', 'failed') AND NOT starts_with(settlement_id, 'outcome:backfill:')) AS attempt_count,
    max(updated_at) FILTER (status IN ('pending', 'failed') AND NOT starts_with(settlement_id, 'outcome:backfill:')) AS last_attempt_at,
    bool_or(status IN ('succeeded', 'not-applicable')) AS settled_before FROM tm JOIN qledger ON qledger.id = settlement_id GROUP BY topic_id
), treuse AS (SELECT topic_id, min(settlement_id) AS reused_id FROM tm JOIN qledger ON qledger.id = settlement_id WHERE status = 'succeeded' AND shared = 2 GROUP BY topic_id HAVING count(*) = 1),
thead AS (
  SELECT topic_id, any_value(anchor) AS anchor, arg_min(source, (captured_at, id)) AS source,
    CASE arg_min(source, (captured_at, id)) WHEN 'chatgpt_web' THEN 'ChatGPT' ELSE string_split(arg_min(project_path, (captured_at, id)), '/')[-1] END AS project,
    count(*) AS pair_count, count(*) FILTER (pending) AS pending_pair_count, coalesce(sum(chars) FILTER (pending), 0) AS pending_chars, min(captured_at) AS first_seen, max(captured_at) AS last_seen,
    max(captured_at) FILTER (pending) AS last_pending_at, min(date) AS first_date, max(chars) FILTER (pending) AS largest_pending_pair,
    CASE WHEN bool_or(regexp_matches(prompt_content || chr(10) || stop_content, '失败|报错|异常|根因|竞态|权限|受阻|恢复|重试|回滚', 'i')) THEN 5 ELSE 0 END
    + CASE WHEN bool_or(regexp_matches(prompt_content || chr(10) || stop_content, '测试|验证|构建|提交|commit|SHA256|HTTP\\s*200', 'i')) THEN 3 ELSE 0 END
    + CASE WHEN bool_or(regexp_matches(prompt_content || chr(10) || stop_content, '方案|架构|设计|决策|取舍|边界|迁移', 'i')) THEN 2 ELSE 0 END
    + CASE WHEN bool_or(regexp_matches(prompt_content || chr(10) || stop_content, 'message_id|日志\\s*ID', 'i')) THEN 4 ELSE 0 END AS flag_points
  FROM tp GROUP BY topic_id
), topics0 AS (
  SELECT coalesce(reused_id, topic_id) AS id, thead.*, coalesce(attempt_count, 0) AS attempt_count, last_attempt_at, coalesce(settled_before, false) AS settled_before,
    CAST(least(8, pair_count - 1) + flag_points + least(14, date_diff('day', first_date, (SELECT max(date) FROM tp))) AS BIGINT) AS priority
  FROM thead LEFT JOIN tatt USING (topic_id) LEFT JOIN treuse USING (topic_id) WHERE pending_pair_count > 0
), topics1 AS (
  SELECT *, coalesce(attempt_count > 0 AND NOT coalesce(last_pending_at > last_attempt_at, false)
      AND TIMESTAMP '{NOW}' < last_attempt_at + to_hours(CAST(least(72, 12 * pow(2, greatest(0, attempt_count - 1))) AS INT)), false) AS retry_cooling FROM topics0
), topics AS (
  SELECT *, TIMESTAMP '{NOW}' >= last_seen + INTERVAL 2 HOUR AND NOT retry_cooling AS eligible,
    CASE WHEN attempt_count > 0 THEN 'retry' WHEN TIMESTAMP '{NOW}' - last_seen <= INTERVAL 48 HOUR THEN 'recent' ELSE 'backlog' END AS lane FROM topics1
)"""
STATE = "CASE WHEN eligible THEN CASE WHEN settled_before THEN 'reopened' ELSE 'ready' END ELSE 'open' END"


def _topics(spark, sf):
    pairs = cut_lineage(q.with_topics(_segments(spark, sf)))
    ledger, events = _ledger(spark, sf)
    return cut_lineage(q.build_topics(pairs, ledger, events, F.lit(NOW).cast("timestamp"))), pairs


@query("classify_automation", with_ctes(REC, PAIRS, f"SELECT id, {CLASS} AS automation FROM pairs"))
def _classify_automation(spark, sf):
    return q.classify_pairs(build_pairs(g.conversations_as_records(spark, sf))).select("id", "automation")


@query("automation_kind", with_ctes(REC, PAIRS, "SELECT id, '自动化' AS kind FROM pairs WHERE starts_with(prompt_content, 'Automation ID: ')"))
def _automation_kind(spark, sf):
    pairs = build_pairs(g.conversations_as_records(spark, sf)).where(F.col("prompt_content").startswith("Automation ID: "))
    return pairs.select("id", t.automation_kind(F.col("prompt_content"), F.col("stop_content")).alias("kind"))


@query("supporting_pairs", with_ctes(REC, TITLES, PAIRS, """
SELECT id FROM pairs WHERE source = 'codex' AND conv_id % 4 <> 2 AND session_id NOT IN (SELECT session_id FROM titles)"""))
def _supporting_pairs(spark, sf):
    pairs = build_pairs(g.conversations_as_records(spark, sf))
    conv = F.substring("session_id", 2, 12).cast("long")
    signed = F.when(conv % 4 != 2, F.concat(F.lit("系统指令：你是平台 Agent。"), "prompt_content")).otherwise(F.col("prompt_content"))
    return q.supporting_pairs(pairs.withColumn("prompt_content", signed), g.labels_as_index(spark, sf)).select("id")


@query("pending_pairs", with_ctes(REC, PAIRS, """
ev AS (SELECT id, prompt_id AS event_id, conv_id, date FROM pairs UNION ALL SELECT id, stop_id, conv_id, date FROM pairs)""", """
SELECT DISTINCT id FROM ev WHERE date >= DATE '2024-01-02' AND (event_id NOT IN (SELECT event_id FROM rec WHERE turn % 3 <> 0 OR conv_id % 2 = 0))"""))
def _pending_pairs(spark, sf):
    records = g.conversations_as_records(spark, sf)
    turn, conv = F.substring_index("event_id", "-", -1).cast("long"), F.substring("session_id", 2, 12).cast("long")
    processed = records.where((turn % 3 != 0) | (conv % 2 == 0)).select("event_id")
    return q.pending_pairs(build_pairs(records), processed, since="2024-01-02")


@query("pending_pairs_backfill", with_ctes(REC, PAIRS, QLEDGER, """
ev AS (SELECT id, prompt_id AS event_id FROM pairs UNION ALL SELECT id, stop_id FROM pairs),
done AS (SELECT event_id FROM qevents JOIN qledger ON qledger.id = settlement_id WHERE status IN ('succeeded', 'not-applicable'))""", """
SELECT DISTINCT id FROM ev WHERE event_id NOT IN (SELECT event_id FROM done)"""))
def _pending_pairs_backfill(spark, sf):
    records = g.conversations_as_records(spark, sf)
    ledger, events = _ledger(spark, sf)
    return q.pending_pairs(build_pairs(records), records.select("event_id"), ledger, events, backfill=True)


@query("explicit_anchor", with_ctes(*BASE, "SELECT id, explicit AS anchor FROM seg0 WHERE explicit IS NOT NULL"))
def _explicit_anchor(spark, sf):
    kept = _sorted(spark, sf).where(F.col("queue_class").isin("substantive", "candidate"))
    return kept.select("id", t.explicit_anchor(t.substantive_automation(F.col("prompt_content"), F.col("stop_content"))).alias("anchor")).where(F.col("anchor").isNotNull())


@query("segment_sessions", with_ctes(*BASE, """
SELECT id, session_key, anchor, opens, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY captured_at, id) AS segment FROM segments"""))
def _segment_sessions(spark, sf):
    return q.number_segments(_segments(spark, sf)).select("id", "session_key", "anchor", "opens", "segment")


@query("topic_title", None)
def _topic_title(spark, sf):
    return _segments(spark, sf).where("opens").select("id", "segment_title.title", "segment_title.source")


@query("build_topics", with_ctes(*BASE, QLEDGER, TOPICS, f"""
SELECT id, anchor, source, project, pair_count, pending_pair_count, pending_chars, first_seen, last_seen, priority, attempt_count, last_attempt_at, retry_cooling, eligible,
  {STATE} AS eligibility_state, lane FROM topics"""))
def _build_topics(spark, sf):
    topics, _ = _topics(spark, sf)
    return topics.select(
        "id", "anchor", "source", "project", "pair_count", "pending_pair_count", "pending_chars", "first_seen", "last_seen", "priority",
        "attempt_count", "last_attempt_at", "retry_cooling", "eligible", "eligibility_state", "lane",
    )


@query("topic_priority", with_ctes(*BASE, QLEDGER, TOPICS, """
SELECT topic_id, CAST(least(8, pair_count - 1) + flag_points + least(14, date_diff('day', first_date, (SELECT max(date) FROM tp))) AS BIGINT) AS priority FROM thead"""))
def _topic_priority(spark, sf):
    pairs = cut_lineage(q.with_topics(_segments(spark, sf)))
    return q.topic_priority(pairs, pairs.agg(F.max("date")).scalar())


@query("retry_state", """
WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'error') % 5 AS attempt_count, max(ts) FILTER (event_type = 'error') AS last_attempt_at,
    max(ts) FILTER (event_type = 'click') AS last_pending_at, max(ts) AS last_seen, bool_or(event_type = 'purchase') AS settled_before FROM events GROUP BY user_id),
b AS (SELECT *, coalesce(attempt_count > 0 AND NOT coalesce(last_pending_at > last_attempt_at, false) AND TIMESTAMP '2024-01-30 23:00:00' < last_attempt_at + to_hours(CAST(least(72, 12 * pow(2, greatest(0, attempt_count - 1))) AS INT)), false) AS retry_cooling FROM a)
SELECT user_id, retry_cooling, TIMESTAMP '2024-01-30 23:00:00' >= last_seen + INTERVAL 2 HOUR AND NOT retry_cooling AS eligible,
  CASE WHEN attempt_count > 0 THEN 'retry' WHEN TIMESTAMP '2024-01-30 23:00:00' - last_seen <= INTERVAL 48 HOUR THEN 'recent' ELSE 'backlog' END AS lane FROM b""")
def _retry_state(spark, sf):
    kind = F.col("event_type")
    rows = g.read(spark, sf, "events").groupBy("user_id").agg(
        (F.count_if(kind == "error") % 5).alias("attempt_count"), F.max(F.when(kind == "error", F.col("ts"))).alias("last_attempt_at"),
        F.max(F.when(kind == "click", F.col("ts"))).alias("last_pending_at"), F.max("ts").alias("last_seen"), F.bool_or(kind == "purchase").alias("settled_before"),
    )
    return q.retry_state(rows, F.lit("2024-01-30 23:00:00").cast("timestamp")).select("user_id", "retry_cooling", "eligible", "lane")


@query("order_topics", with_ctes(*BASE, QLEDGER, TOPICS, "SELECT id, priority, last_attempt_at FROM topics ORDER BY last_attempt_at NULLS FIRST, priority DESC, first_seen, id"))
def _order_topics(spark, sf):
    return q.order_topics(_topics(spark, sf)[0]).select("id", "priority", "last_attempt_at")


@query("system_outcomes", with_ctes(REC, TITLES, PAIRS, SORTED, f"""
SELECT 'outcome:system:no-op-automation:' || left(sha256(group_key), 20) AS id, group_key, count(*) AS pair_count FROM (
  SELECT CASE WHEN starts_with(prompt_content, '[no-obsidian]') THEN '自动化:' || date ELSE '自动化:' || date END AS group_key FROM sorted_pairs WHERE automation = 'no-op' AND pending)
GROUP BY group_key"""))
def _system_outcomes(spark, sf):
    heads, _ = q.system_outcomes(_sorted(spark, sf))
    return heads.select("id", "group_key", "pair_count")


@query("fit_slice", with_ctes(*BASE, f"""
SELECT topic_id, id, chars_so_far FROM (
  SELECT {TOPIC_HASH} AS topic_id, id, row_number() OVER w AS n, sum(chars) OVER w AS chars_so_far FROM segments WHERE pending WINDOW w AS (PARTITION BY anchor ORDER BY captured_at, id)
) WHERE n <= 3 AND chars_so_far <= 4000"""))
def _fit_slice(spark, sf):
    return q.fit_slice(q.with_topics(_segments(spark, sf)), 3, 4000).select("topic_id", "id", "chars_so_far")


@query("round_robin", """
WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
h AS (SELECT user_id, ts AS head_at, event_id AS head_id FROM r WHERE turn = 1)
SELECT user_id, event_id, turn, row_number() OVER (ORDER BY turn, head_at, head_id) AS place FROM r JOIN h USING (user_id)""")
def _round_robin(spark, sf):
    rows = q.round_robin(g.read(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")])
    ranges = range_blocks(rows.select("user_id", "event_id", "turn", "group_head").withColumn("all", F.lit(0)), ["all"], ["turn", "group_head"])
    placed = running_total(ranges, ["all"], ["turn", "group_head"], F.col(RANGE), F.lit(1), "place")
    return placed.select("user_id", "event_id", "turn", "place")


#: The greedy fit step by step: each step asks the next lane of the rotation for its first topic that has room.
SELECTION = """
offers AS (
  SELECT topic_id, list(chars ORDER BY captured_at, id) AS sizes FROM tp WHERE pending GROUP BY topic_id
), turns AS (
  SELECT t.*, row_number() OVER (PARTITION BY lane, project ORDER BY last_attempt_at NULLS FIRST, priority DESC, first_seen, id) AS turn FROM topics t WHERE eligible
), heads AS (SELECT lane, project, last_attempt_at AS h1, priority AS h2, first_seen AS h3, id AS h4 FROM turns WHERE turn = 1),
places AS (
  SELECT turns.lane, id, topic_id, pending_pair_count, sizes,
    row_number() OVER (PARTITION BY turns.lane ORDER BY turn, h1 NULLS FIRST, h2 DESC, h3, h4) AS place
  FROM turns JOIN heads ON heads.lane = turns.lane AND heads.project = turns.project JOIN offers USING (topic_id)
), board AS (
  SELECT coalesce(list({{'place': place, 'id': id, 'topic_id': topic_id, 'of': pending_pair_count, 'sizes': sizes}} ORDER BY place) FILTER (lane = 'retry'), []) AS retry,
    coalesce(list({{'place': place, 'id': id, 'topic_id': topic_id, 'of': pending_pair_count, 'sizes': sizes}} ORDER BY place) FILTER (lane = 'backlog'), []) AS backlog,
    coalesce(list({{'place': place, 'id': id, 'topic_id': topic_id, 'of': pending_pair_count, 'sizes': sizes}} ORDER BY place) FILTER (lane = 'recent'), []) AS recent,
    greatest(1, least({topics}, count(DISTINCT lane))) AS share FROM places
), steps AS (
  SELECT 0 AS step, 0 AS n, 0 AS pairs, 0::BIGINT AS chars, 0 AS idle, 0 AS p0, 0 AS p1, 0 AS p2, NULL::STRUCT(place BIGINT, id VARCHAR, topic_id VARCHAR, "of" BIGINT, sizes BIGINT[]) AS pick, 0 AS took, 0::BIGINT AS took_chars
  UNION ALL
  SELECT step + 1, n + CASE WHEN fit IS NULL THEN 0 ELSE 1 END, pairs + got, chars + got_chars, CASE WHEN fit IS NULL THEN idle + 1 ELSE 0 END,
    CASE WHEN step % 3 = 0 AND fit IS NOT NULL THEN fit.place ELSE p0 END, CASE WHEN step % 3 = 1 AND fit IS NOT NULL THEN fit.place ELSE p1 END,
    CASE WHEN step % 3 = 2 AND fit IS NOT NULL THEN fit.place ELSE p2 END, fit, got, got_chars
  FROM (
    SELECT *, CASE WHEN fit IS NULL THEN 0 ELSE len(list_filter(range(1, least(len(fit.sizes), room_pairs) + 1), lambda i: list_sum(fit.sizes[1:i]) <= room_chars)) END AS got,
      CASE WHEN fit IS NULL THEN 0 ELSE coalesce(list_sum(fit.sizes[1 : len(list_filter(range(1, least(len(fit.sizes), room_pairs) + 1), lambda i: list_sum(fit.sizes[1:i]) <= room_chars))]), 0) END AS got_chars
    FROM (
      SELECT s.*, room_pairs, room_chars, list_filter(CASE step % 3 WHEN 0 THEN retry WHEN 1 THEN backlog ELSE recent END,
        lambda x: x.place > CASE step % 3 WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AND room_pairs >= 1 AND x.sizes[1] <= room_chars)[1] AS fit
      FROM (SELECT *, least({pairs} - pairs, greatest(1, {pairs} // share)) AS room_pairs, least({chars} - chars, greatest(1, {chars} // share)) AS room_chars FROM steps, board WHERE n < {topics} AND idle < 3) s
    )
  )
), selection AS (
  SELECT pick.id AS id, pick.topic_id AS topic_id, CASE (step - 1) % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'backlog' ELSE 'recent' END AS lane, n AS place, took AS pairs, took_chars AS chars, took < pick."of" AS partial
  FROM steps WHERE pick IS NOT NULL
)"""


def selection(topics: int = fv.SELECTION_TOPICS, pairs: int = fv.SELECTION_PAIRS, chars: int = fv.SELECTION_CHARS) -> str:
    return SELECTION.format(topics=topics, pairs=pairs, chars=chars)


RECURSIVE = lambda *parts: with_ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


@query("select_topics", RECURSIVE(*BASE, QLEDGER, TOPICS, selection(), "SELECT * FROM selection"))
def _select_topics(spark, sf):
    topics, pairs = _topics(spark, sf)
    return q.select_topics(topics, pairs)


@query("select_topics_narrow", RECURSIVE(*BASE, QLEDGER, TOPICS, selection(24, 30, 9000), "SELECT * FROM selection"))
def _select_topics_narrow(spark, sf):
    """Many topics in little room: lanes pass over what does not fit, and are asked again."""
    topics, pairs = _topics(spark, sf)
    return q.select_topics(topics, pairs, 24, 30, 9000)


STATUS = f"""
SELECT unnest(map_entries(m)).key AS counter, unnest(map_entries(m)).value AS value FROM (
  SELECT MAP {{
    'raw_pending_pairs': (SELECT count(*) FILTER (pending) FROM sorted_pairs), 'no_op_automation_pairs': (SELECT count(*) FILTER (pending AND automation = 'no-op') FROM sorted_pairs),
    'substantive_automation_pairs': (SELECT count(*) FILTER (pending AND automation = 'substantive') FROM sorted_pairs), 'supporting_pairs': 0,
    'candidate_pairs': (SELECT count(*) FILTER (pending AND automation IN ('ordinary', 'substantive')) FROM sorted_pairs),
    'candidate_topics': (SELECT count(*) FROM topics), 'ready_topics': (SELECT count(*) FILTER (eligible) FROM topics),
    'open_topics': (SELECT count(*) FILTER (NOT eligible AND NOT retry_cooling) FROM topics), 'retry_topics': (SELECT count(*) FILTER (lane = 'retry') FROM topics),
    'cooling_retry_topics': (SELECT count(*) FILTER (retry_cooling) FROM topics), 'backlog_topics': (SELECT count(*) FILTER (lane = 'backlog') FROM topics),
    'recent_topics': (SELECT count(*) FILTER (lane = 'recent') FROM topics),
    'deferred_oversize_topics': (SELECT count(*) FILTER (eligible AND (pending_pair_count > {fv.SELECTION_PAIRS} OR pending_chars > {fv.SELECTION_CHARS})) FROM topics),
    'needs_compaction_topics': (SELECT count(*) FILTER (eligible AND largest_pending_pair > {fv.SELECTION_CHARS}) FROM topics),
    'selected_topics': (SELECT count(*) FROM selection), 'selected_pairs': (SELECT coalesce(sum(pairs), 0) FROM selection), 'selected_chars': (SELECT coalesce(sum(chars), 0) FROM selection),
    'partial_topics': (SELECT count(*) FILTER (partial) FROM selection),
    'deferred_topics': (SELECT count(*) FROM topics WHERE topic_id NOT IN (SELECT topic_id FROM selection WHERE NOT partial))
  }} AS m)"""


@query("queue_status", RECURSIVE(*BASE, QLEDGER, TOPICS, selection(), STATUS))
def _queue_status(spark, sf):
    topics, pairs = _topics(spark, sf)
    return q.queue_status(_sorted(spark, sf), topics, q.select_topics(topics, pairs))


@query("queue_pair_counts", with_ctes(REC, TITLES, PAIRS, SORTED, """
SELECT automation AS queue_class, count(*) AS pairs, count(*) FILTER (pending) AS pending FROM (SELECT pending, CASE automation WHEN 'ordinary' THEN 'candidate' ELSE automation END AS automation FROM sorted_pairs) GROUP BY 1"""))
def _queue_pair_counts(spark, sf):
    return _sorted(spark, sf).groupBy("queue_class").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("pending").alias("pending"))


@query("bounded_recent", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(text)) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
WHERE n <= 4 AND total <= 3000""")
def _bounded_recent(spark, sf):
    rows = g.read(spark, sf, "conversations")
    return q.bounded_recent(rows, ["turn"], F.length("text"), count=4, chars=3000, owner=["conv_id"]).select("conv_id", "turn")


@query("bounded_recent_one_queue", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(text)) OVER w AS total FROM conversations WINDOW w AS (ORDER BY conv_id DESC, turn DESC))
WHERE n <= 2000 AND total <= 100000""")
def _bounded_recent_one_queue(spark, sf):
    rows = g.read(spark, sf, "conversations")
    return q.bounded_recent(rows, ["conv_id", "turn"], F.length("text"), chars=100_000).select("conv_id", "turn")


@query("canonical_project", """
WITH folders AS (SELECT n_name AS folder FROM nation WHERE n_nationkey % 2 = 0), asked AS (SELECT c_custkey, 'nation_' || (c_custkey % 30) || CASE WHEN c_custkey % 4 = 0 THEN '?' ELSE '' END AS project FROM customer)
SELECT c_custkey, coalesce(folder, trim(replace(project, '?', ' '))) AS project_directory FROM asked LEFT JOIN folders ON lower(folder) = lower(project)""")
def _canonical_project(spark, sf):
    folders = g.read(spark, sf, "nation").where(F.col("n_nationkey") % 2 == 0).select(F.col("n_name").alias("folder"))
    key = F.col("c_custkey")
    asked = g.read(spark, sf, "customer").select(key, F.concat(F.lit("nation_"), (key % 30).cast("string"), F.when(key % 4 == 0, "?").otherwise("")).alias("project"))
    return q.canonical_project(asked, folders).select("c_custkey", "project_directory")
