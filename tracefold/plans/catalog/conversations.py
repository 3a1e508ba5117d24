"""Queries over transcripts: captures, turns, pairs, automation, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions import topics as t
from tracefold.functions.text import (
    classify_status, concise_summary, concise_title, is_automation, is_direct_completion, meaningful_prompt,
)
from tracefold.operators import turns as u
from tracefold.operators.common import spread
from tracefold.plans.catalog import query, with_ctes
from tracefold.plans.catalog.given_sql import REC, RES, TITLES
from tracefold.sources import captures as c
from tracefold.sources import given_tables as g

SPACE = r"[\s\x{00a0}\x{3000}\x{feff}\x{2028}\x{2029}]"
STATUS = "CASE WHEN starts_with(content, '已完成：') THEN 'completed' WHEN starts_with(content, '无法完成：') THEN 'blocked' ELSE 'progress' END"
AUTOMATED = "regexp_matches(content, '<heartbeat>|<automation_id>|Automation ID:', 'i')"


def squash(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace({expr}, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g'))"


def cut(expr: str, n: int) -> str:
    return f"CASE WHEN length({expr}) <= {n} THEN {expr} ELSE rtrim(substr({expr}, 1, {n - 1})) || '…' END"


TURNS = f"""
turn_rows AS (
  SELECT *, {AUTOMATED} AS automated, CASE WHEN event = 'UserPromptSubmit' AND trim(content) <> '' AND NOT {AUTOMATED} THEN content END AS request,
    {squash('content')} AS flat, {STATUS} AS status FROM rec
), turn_groups AS (
  SELECT source, session_id, turn_id, bool_or(event = 'UserPromptSubmit' AND automated) AS automated, count(request) AS requests,
    arg_min(event_id, (captured_at, event_id)) FILTER (request IS NOT NULL) AS prompt_id,
    min(captured_at) FILTER (request IS NOT NULL) AS prompt_at, arg_min(date, (captured_at, event_id)) FILTER (request IS NOT NULL) AS prompt_date,
    arg_min(flat, (captured_at, event_id)) FILTER (request IS NOT NULL) AS prompt_flat,
    arg_max(event_id, (captured_at, event_id)) FILTER (event = 'Stop') AS stop_id, max(captured_at) FILTER (event = 'Stop') AS stop_at,
    arg_max(date, (captured_at, event_id)) FILTER (event = 'Stop') AS stop_date, arg_max(flat, (captured_at, event_id)) FILTER (event = 'Stop') AS stop_flat,
    arg_max(status, (captured_at, event_id)) FILTER (event = 'Stop') AS status, min(captured_at) AS first_at, any_value(conv_id) AS conv_id
  FROM turn_rows GROUP BY source, session_id, turn_id
), kept AS (
  SELECT t.*, titles.title AS index_title, CASE WHEN source = 'chatgpt_web' THEN 'chatgpt' ELSE 'codex' END AS source_type,
    CASE WHEN source = 'chatgpt_web' THEN '未归属' ELSE 'proj' || (conv_id % 5) END AS project_key
  FROM turn_groups t LEFT JOIN titles USING (session_id)
  WHERE NOT automated AND requests > 0 AND (source = 'chatgpt_web' OR titles.title IS NOT NULL)
), described AS (
  SELECT *, source_type || ':' || project_key || ':' || session_id AS task_key FROM kept
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY first_at, session_id, turn_id) = 1 AS first_turn FROM described
)"""
TURN_EVENTS = f"""
SELECT 'turn:' || source_type || ':' || session_id || ':' || turn_id AS id,
  CASE WHEN source = 'chatgpt_web' THEN 'research_activity' WHEN first_turn THEN 'task_started' ELSE 'task_progress' END AS kind,
  prompt_at AS occurred_at, coalesce(stop_at, prompt_at) AS observed_at, prompt_date AS local_date,
  {cut('prompt_flat', 180)} || CASE WHEN requests > 1 THEN '（同一 turn 共 ' || requests || ' 条指令）' ELSE '' END AS summary, project_key,
  CASE WHEN source <> 'chatgpt_web' THEN task_key END AS task_key, CASE WHEN stop_id IS NULL THEN 'inferred' ELSE 'observed' END AS confidence
FROM marked"""
COMPLETIONS = f"""
SELECT 'turn-outcome:' || source_type || ':' || session_id || ':' || turn_id AS id,
  CASE status WHEN 'blocked' THEN 'task_blocked' ELSE 'task_completed' END AS kind, stop_at AS occurred_at, stop_at AS observed_at,
  stop_date AS local_date, {cut('stop_flat', 180)} AS summary, project_key, task_key, 'reported' AS confidence
FROM marked WHERE source <> 'chatgpt_web' AND status IN ('blocked', 'completed')"""
EVENT_COLUMNS = ["id", "kind", "occurred_at", "observed_at", "local_date", "summary", "project_key", "task_key", "confidence"]


@query("build_turns", with_ctes(REC, TITLES, TURNS, f"{TURN_EVENTS} UNION ALL {COMPLETIONS}"))
def _build_turns(spark, sf):
    events = u.build_turns(g.conversations_as_records(spark, sf), g.labels_as_index(spark, sf))
    return events.select(*EVENT_COLUMNS)


@query("completion_events", with_ctes(REC, TITLES, TURNS, COMPLETIONS))
def _completion_events(spark, sf):
    turns = u.described_turns(g.conversations_as_records(spark, sf), g.labels_as_index(spark, sf))
    return u.completion_events(turns).select(*EVENT_COLUMNS)


@query("mark_first_turn", with_ctes(REC, TITLES, TURNS, "SELECT task_key, session_id, turn_id, first_turn FROM marked"))
def _mark_first_turn(spark, sf):
    turns = u.described_turns(g.conversations_as_records(spark, sf), g.labels_as_index(spark, sf))
    return turns.select("task_key", "session_id", "turn_id", "first_turn")


@query("resource_events", with_ctes(RES, """
SELECT 'feishu:' || event_id AS id, CASE WHEN resource_type IN ('tasks', 'base') THEN
    CASE resource_status WHEN 'done' THEN 'task_completed' WHEN 'blocked' THEN 'task_blocked' ELSE 'task_progress' END
  WHEN resource_type = 'documents' THEN 'knowledge_updated' WHEN resource_type = 'approvals' THEN 'output_created' ELSE 'research_activity' END AS kind,
  date AS local_date, title, lower(replace(project_hint, ' ', '-')) AS project_key,
  CASE WHEN resource_type IN ('tasks', 'base') THEN 'feishu:' || lower(replace(project_hint, ' ', '-')) || ':' || resource_type || ':' || resource_id END AS task_key,
  'feishu:' || resource_type || ':' || resource_id AS object_key, CASE access_status WHEN 'available' THEN 'observed' ELSE 'reported' END AS confidence FROM res"""))
def _resource_events(spark, sf):
    return u.resource_events(g.orders_as_resources(spark, sf)).select(
        "id", "kind", "local_date", "title", "project_key", "task_key", "object_key", "confidence"
    )


PAIRS = """
pairs AS (
  SELECT left(sha256(source || chr(0) || prompt_id || chr(0) || stop_id), 24) AS id, * FROM (
    SELECT source, session_id, turn_id, arg_min(event_id, ingest_seq) FILTER (event = 'UserPromptSubmit') AS prompt_id,
      arg_max(event_id, ingest_seq) FILTER (event = 'Stop') AS stop_id, arg_min(captured_at, ingest_seq) FILTER (event = 'UserPromptSubmit') AS captured_at,
      arg_min(date, ingest_seq) FILTER (event = 'UserPromptSubmit') AS date, arg_min(cwd, ingest_seq) FILTER (event = 'UserPromptSubmit') AS cwd,
      arg_min(content, ingest_seq) FILTER (event = 'UserPromptSubmit') AS prompt_content, arg_max(content, ingest_seq) FILTER (event = 'Stop') AS stop_content,
      any_value(conv_id) AS conv_id
    FROM rec GROUP BY source, session_id, turn_id
  ) WHERE prompt_id IS NOT NULL AND stop_id IS NOT NULL
)"""


@query("build_pairs", with_ctes(REC, PAIRS, """
SELECT id, source, session_id, turn_id, captured_at, date, cwd, prompt_id, stop_id, length(prompt_content) + length(stop_content) AS chars,
  'raw/' || CASE source WHEN 'chatgpt_web' THEN 'chatgpt' ELSE 'codex' END || '/daily/' || date || '.md' AS daily_path FROM pairs"""))
def _build_pairs(spark, sf):
    return u.build_pairs(g.conversations_as_records(spark, sf)).select(
        "id", "source", "session_id", "turn_id", "captured_at", "date", "cwd", F.get("source_event_ids", F.lit(0)).alias("prompt_id"),
        F.get("source_event_ids", F.lit(1)).alias("stop_id"), t.pair_chars().alias("chars"), "daily_path",
    )


@query("resource_pairs", with_ctes(RES, """
SELECT left(sha256('feishu' || chr(0) || event_id), 24) AS id, 'feishu:' || resource_type || ':' || resource_id AS session_id, project_hint AS cwd, title,
  'raw/feishu/daily/' || date || '.md' AS daily_path, content AS stop_content FROM res"""))
def _resource_pairs(spark, sf):
    return u.build_pairs(g.orders_as_resources(spark, sf)).select("id", "session_id", "cwd", "title", "daily_path", "stop_content")


@query("pair_messages", """
WITH n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ask FROM conversations)
SELECT conv_id, min(turn) FILTER (role = 'user') AS user_turn, min(turn) FILTER (role = 'assistant') AS assistant_turn
FROM n WHERE ask > 0 GROUP BY conv_id, ask HAVING count(*) FILTER (role = 'assistant') > 0""")
def _pair_messages(spark, sf):
    return u.pair_messages(g.read(spark, sf, "conversations"))


@query("exclude_automation", with_ctes(REC, f"""
SELECT event_id FROM rec r WHERE NOT EXISTS (SELECT 1 FROM rec p WHERE p.source = r.source AND p.session_id = r.session_id AND p.turn_id = r.turn_id
  AND p.event = 'UserPromptSubmit' AND {AUTOMATED.replace('content', 'p.content')})"""))
def _exclude_automation(spark, sf):
    return u.exclude_automation(g.conversations_as_records(spark, sf)).select("event_id")


@query("opt_out_turns", with_ctes(REC, r"""
SELECT event_id FROM rec r WHERE NOT EXISTS (SELECT 1 FROM rec p WHERE p.session_id = r.session_id AND p.turn_id = r.turn_id
  AND p.event = 'UserPromptSubmit' AND regexp_matches(p.content, '^\s*\[no-obsidian\]', 'i'))"""))
def _opt_out_turns(spark, sf):
    return u.opt_out_turns(g.conversations_as_records(spark, sf)).select("event_id")


@query("is_automation", with_ctes(REC, f"SELECT event_id, {AUTOMATED} AS automation FROM rec"))
def _is_automation(spark, sf):
    return g.conversations_as_records(spark, sf).select("event_id", is_automation(F.col("content")).alias("automation"))


@query("meaningful_prompts", with_ctes(REC, f"""
SELECT event_id, regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g') AS request FROM rec
WHERE event = 'UserPromptSubmit' AND NOT {AUTOMATED} AND regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g') <> ''"""))
def _meaningful_prompts(spark, sf):
    return u.meaningful_prompts(g.conversations_as_records(spark, sf)).select("event_id", "request")


@query("classify_status", with_ctes(REC, f"SELECT event_id, {STATUS} AS status FROM rec WHERE event = 'Stop'"))
def _classify_status(spark, sf):
    stops = g.conversations_as_records(spark, sf).where(F.col("event") == "Stop")
    return stops.select("event_id", classify_status(F.col("content")).alias("status"))


@query("is_direct_completion", with_ctes(REC, """
SELECT event_id, starts_with(content, '已完成：') AS direct FROM rec"""))
def _is_direct_completion(spark, sf):
    return g.conversations_as_records(spark, sf).select("event_id", is_direct_completion(F.col("content")).alias("direct"))


@query("title_lookup", with_ctes(REC, TITLES, """
SELECT event_id, titles.title AS index_title FROM rec LEFT JOIN titles USING (session_id) WHERE source = 'chatgpt_web' OR titles.title IS NOT NULL"""))
def _title_lookup(spark, sf):
    records = g.conversations_as_records(spark, sf).drop("title")
    return u.title_lookup(records, g.labels_as_index(spark, sf)).select("event_id", "index_title")


ELIGIBLE = f"""
eligible AS (SELECT DISTINCT session_id, turn_id FROM rec JOIN titles USING (session_id)
  WHERE source = 'codex' AND event = 'UserPromptSubmit' AND NOT {AUTOMATED} AND trim(content) <> '')"""


@query("eligible_turns", with_ctes(REC, TITLES, ELIGIBLE, "SELECT * FROM eligible"))
def _eligible_turns(spark, sf):
    return u.eligible_turns(g.conversations_as_records(spark, sf), g.labels_as_index(spark, sf))


@query("eligible_stops", with_ctes(REC, TITLES, ELIGIBLE, f"""
SELECT event_id FROM rec SEMI JOIN eligible USING (session_id, turn_id) WHERE source = 'codex' AND event = 'Stop' AND {STATUS} = 'completed'"""))
def _eligible_stops(spark, sf):
    records = g.conversations_as_records(spark, sf)
    return u.eligible_stops(records, u.eligible_turns(records, g.labels_as_index(spark, sf))).select("event_id")


@query("latest_stop", with_ctes(REC, TITLES, TURNS, f"events AS ({TURN_EVENTS.replace('SELECT', 'SELECT session_id, turn_id,', 1)})", """
SELECT id, stop_event_id FROM events JOIN (SELECT session_id, turn_id, arg_max(event_id, (captured_at, event_id)) AS stop_event_id
  FROM rec WHERE event = 'Stop' GROUP BY ALL) USING (session_id, turn_id)"""))
def _latest_stop(spark, sf):
    records = g.conversations_as_records(spark, sf)
    events = u.turn_events(u.described_turns(records, g.labels_as_index(spark, sf)))
    return u.latest_stop(events, records).select("id", "stop_event_id")


@query("turn_problem", with_ctes(REC, TITLES, TURNS, f"""
SELECT 'turn-outcome:' || source_type || ':' || session_id || ':' || turn_id AS id, 'turn:' || source_type || ':' || session_id || ':' || turn_id AS problem_id
FROM marked WHERE source <> 'chatgpt_web' AND status = 'completed'"""))
def _turn_problem(spark, sf):
    events = u.build_turns(g.conversations_as_records(spark, sf), g.labels_as_index(spark, sf))
    return u.turn_problem(events).select("id", "problem_id")


# --- capture files: lines as the capture hook writes them, some damaged ---------------------------
def capture_lines(spark, sf):
    r = g.conversations_as_records(spark, sf)
    conv = F.substring_index(F.substring_index("event_id", "-", 2), "-", -1).cast("int")
    session = F.when(conv % 23 == 7, F.to_variant_object(F.struct(conv.alias("n")))).otherwise(F.parse_json(F.concat(F.lit('"'), "session_id", F.lit('"'))))
    fields = F.struct(
        "event_id", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"), session.alias("session_id"), "turn_id", "event",
        "content", "source", "cwd", F.when(conv % 5 == 0, "not-a-day").otherwise(F.col("date").cast("string")).alias("date"),
    )
    text = F.when(conv % 29 == 8, F.lit('{"cut": ')).when(conv % 31 == 9, F.lit("   ")).otherwise(F.to_json(fields))
    return r.select(text.alias("value"), "source_path", "source_line")


@query("read_capture_log", with_ctes(REC, """
SELECT event_id, captured_at, date, source, event, session_id, turn_id, cwd, source_line FROM (SELECT *, CAST(turn + 1 AS INT) AS source_line FROM rec)
WHERE conv_id % 29 <> 8 AND conv_id % 31 <> 9 AND conv_id % 23 <> 7"""))
def _read_capture_log(spark, sf):
    records, _ = c.parse_capture_lines(capture_lines(spark, sf))
    return records.select("event_id", "captured_at", "date", "source", "event", "session_id", "turn_id", "cwd", "source_line")


@query("malformed_report", with_ctes(REC, """
SELECT 'raw/' || date || '.jsonl' AS source_path, CASE WHEN conv_id % 29 = 8 THEN 'not-json' ELSE 'missing-session_id' END AS reason, count(*) AS lines,
  CAST(min(turn) + 1 AS INT) AS first_line FROM rec WHERE conv_id % 29 = 8 OR (conv_id % 31 <> 9 AND conv_id % 23 = 7) GROUP BY 1, 2"""))
def _malformed_report(spark, sf):
    _, rejects = c.parse_capture_lines(capture_lines(spark, sf))
    return c.malformed_report(rejects)


@query("build_diagnostics", with_ctes(REC, TITLES, TURNS, """
all_turns AS (SELECT t.*, titles.title IS NOT NULL AS indexed FROM turn_groups t LEFT JOIN titles USING (session_id))""", """
SELECT 'malformed_lines' AS counter, count(*) AS n FROM rec WHERE conv_id % 29 = 8 OR (conv_id % 31 <> 9 AND conv_id % 23 = 7)
UNION ALL SELECT 'duplicate_records', count(*) - count(DISTINCT event_id) FROM rec
UNION ALL SELECT 'excluded_automations', count(*) FROM all_turns WHERE automated
UNION ALL SELECT 'excluded_supporting_sessions', count(*) FROM all_turns WHERE NOT automated AND requests > 0 AND source <> 'chatgpt_web' AND NOT indexed
UNION ALL SELECT 'codex_sessions', count(DISTINCT session_id) FROM all_turns WHERE NOT automated AND requests > 0 AND source <> 'chatgpt_web' AND indexed
UNION ALL SELECT 'chatgpt_conversations', count(DISTINCT session_id) FROM all_turns WHERE NOT automated AND requests > 0 AND source = 'chatgpt_web'
UNION ALL SELECT 'collab_records', 0"""))
def _build_diagnostics(spark, sf):
    _, rejects = c.parse_capture_lines(capture_lines(spark, sf))
    return u.build_diagnostics(g.conversations_as_records(spark, sf), g.labels_as_index(spark, sf), rejects)


@query("last_event_at", "SELECT event_type AS capture_source, max(ts) AS last_event_at FROM events GROUP BY event_type")
def _last_event_at(spark, sf):
    events = g.read(spark, sf, "events").select(F.col("event_type").alias("capture_source"), F.col("ts").alias("captured_at"))
    return c.last_event_at(events)


@query("read_session_index", """
SELECT 's' || user_id AS session_id, 'Title ' || arg_max(event_id, (date_trunc('second', ts), event_id)) AS title, date_trunc('second', max(ts)) AS updated_at
FROM events WHERE event_id % 7 <> 3 GROUP BY user_id""")
def _read_session_index(spark, sf):
    e = g.read(spark, sf, "events")
    line = F.to_json(F.struct(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit(" Title "), F.col("event_id").cast("string")).alias("thread_name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    ))
    text = F.when(F.col("event_id") % 7 == 3, F.lit('{"id": 5}')).otherwise(line)
    return c.parse_session_index(e.select(text.alias("value"), F.col("event_id").cast("int").alias("source_line")))


# --- producer logs: one file per user, rows in time order -----------------------------------------
PRODUCER = """
log AS (
  SELECT user_id, event_id AS line, ts, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 't' || (event_id % 6) END AS turn FROM events
), meta AS (
  SELECT *, last_value(CASE WHEN event_type = 'signup' THEN line END IGNORE NULLS) OVER w AS meta_line FROM log
  WINDOW w AS (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ctx AS (
  SELECT *, last_value(CASE WHEN event_type = 'view' AND turn IS NOT NULL AND meta_line % 5 <> 2 THEN line END IGNORE NULLS) OVER w AS begun_line
  FROM meta WINDOW w AS (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), named AS (
  SELECT ctx.*, CASE WHEN begun_line IS NOT NULL THEN 't' || (begun_line % 6) END AS begun FROM ctx
), closed AS (
  SELECT *, last_value(CASE WHEN event_type IN ('purchase', 'error') AND meta_line % 5 <> 2 AND (turn IS NULL OR turn = begun) THEN line END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed_line FROM named
), active AS (
  SELECT *, CASE WHEN closed_line IS NULL OR closed_line < begun_line THEN begun END AS active_turn FROM closed
), placed AS (
  SELECT *, CASE WHEN event_type = 'click' THEN active_turn ELSE coalesce(turn, active_turn) END AS turn_id
  FROM active WHERE meta_line IS NOT NULL AND meta_line % 5 <> 2 AND event_type IN ('click', 'purchase', 'error')
)"""


def producer_rows(spark, sf):
    e = g.read(spark, sf, "events")
    kind, line = F.col("event_type"), F.col("event_id")
    turn = F.when(line % 4 != 0, F.concat(F.lit("t"), (line % 6).cast("string")))
    meta = kind == "signup"
    payload = F.struct(
        F.when(kind == "click", "user_message").when(kind == "purchase", "task_complete").when(kind == "error", "turn_aborted").alias("type"),
        turn.alias("turn_id"), F.when(meta, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("id"),
        F.when(meta | (kind == "view"), F.concat(F.lit("/home/p"), (line % 3).cast("string"))).alias("cwd"),
        F.when(meta, "Codex Desktop").alias("originator"), F.when(meta, F.when(line % 5 == 2, "0.150.1").otherwise("0.144.2")).alias("cli_version"),
        F.when(kind == "click", F.concat(F.lit("ask "), line.cast("string"))).alias("message"),
        F.when(kind == "purchase", F.concat(F.lit("answer "), line.cast("string"))).alias("last_agent_message"),
    )
    text = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(meta, "session_meta").when(kind == "view", "turn_context").otherwise("event_msg").alias("type"), payload.alias("payload"),
    ))
    lines = e.select(text.alias("value"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source_path"), line.alias("source_line"))
    return c.parse_producer_lines(lines)


@query("read_producer_sessions", with_ctes(PRODUCER, """
SELECT 'f' || user_id AS file, line, CASE event_type WHEN 'click' THEN 'UserPromptSubmit' ELSE 'Stop' END AS event, ts AS captured_at, 's' || user_id AS session_id,
  turn_id, CASE event_type WHEN 'click' THEN 'ask ' || line WHEN 'purchase' THEN 'answer ' || line ELSE '本轮任务已中止' END AS content
FROM placed WHERE turn_id IS NOT NULL"""))
def _read_producer_sessions(spark, sf):
    captures, _ = c.read_producer_sessions(producer_rows(spark, sf))
    return captures.select("file", "line", "event", "captured_at", "session_id", "turn_id", "content")


@query("producer_errors", with_ctes(PRODUCER, """
SELECT 'f' || user_id AS file, line, CASE event_type WHEN 'click' THEN '用户消息缺少可关联的 turn_id' ELSE '完成事件缺少 turn_id' END AS error FROM placed WHERE turn_id IS NULL"""))
def _producer_errors(spark, sf):
    _, errors = c.read_producer_sessions(producer_rows(spark, sf))
    return errors.select("file", "line", "error")


@query("supported_versions", """
SELECT event_id AS line, CASE WHEN event_id % 5 = 2 THEN '不支持的数据版本 0.150.1' END AS error FROM events WHERE event_type = 'signup'""")
def _supported_versions(spark, sf):
    good, held = c.supported_versions(producer_rows(spark, sf).where(F.col("type") == "session_meta"))
    return good.select("line", F.lit(None).cast("string").alias("error")).unionByName(held.select("line", "error"))


# --- text of documents ---------------------------------------------------------------------------
@query("concise_summary", f"SELECT doc_id, {cut(squash('text'), 180)} AS summary FROM documents")
def _concise_summary(spark, sf):
    return g.read(spark, sf, "documents").select("doc_id", concise_summary(F.col("text")).alias("summary"))


MARK = rf"^{SPACE}*(?:#{{1,6}}|[-*]|\d+\.){SPACE}*"


@query("concise_title", f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\r?\\n'),
    lambda x: regexp_replace(regexp_replace(x, '{MARK}', ''), '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') AS lines FROM documents),
f AS (SELECT doc_id, regexp_replace(coalesce(lines[1], 'Untitled'), '{SPACE}+', ' ', 'g') AS v FROM l)
SELECT doc_id, {cut('v', 72)} AS title FROM f""")
def _concise_title(spark, sf):
    return g.read(spark, sf, "documents").select("doc_id", concise_title(F.col("text"), "Untitled").alias("title"))


@query("meaningful_prompt_text", f"""
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(nullif(regexp_replace(replace(text, chr(10), ' '), '^{SPACE}+|{SPACE}+$', '', 'g'), ''), 'ask') END AS request FROM documents""")
def _meaningful_prompt_text(spark, sf):
    marked = F.concat(F.lit("# Browser comments:\n## Comment 1\nComment:\n"), F.translate("text", "\n", " "), F.lit("\n\n## My request for Codex:\nask"))
    return spread(g.read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", meaningful_prompt(marked).alias("request"))


__all__ = ["fv", "PAIRS", "TURNS", "STATUS", "SPACE", "cut", "squash"]
