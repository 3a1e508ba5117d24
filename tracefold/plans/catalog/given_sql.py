"""The adapters of ``sources.given_tables`` in SQL, shared by the oracle queries."""

ACT = """
act0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
), act1 AS (
  SELECT *, CASE event_type WHEN 'signup' THEN 'task_started' WHEN 'click' THEN 'task_progress'
      WHEN 'purchase' THEN 'task_completed' WHEN 'error' THEN 'task_blocked'
      ELSE CASE k % 5 WHEN 0 THEN 'research_activity' WHEN 1 THEN 'output_created' WHEN 2 THEN 'knowledge_created'
        WHEN 3 THEN 'knowledge_updated' ELSE 'knowledge_reused' END END AS kind,
    CASE WHEN user_id % 10 = 0 THEN 'unassigned' ELSE 'p' || CAST(user_id % 10 AS VARCHAR) END AS project_key,
    CASE event_id % 3 WHEN 0 THEN 'git' WHEN 1 THEN 'codex' ELSE 'chatgpt' END AS own_source
  FROM act0
), act AS (
  SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'u' || user_id AS owner, kind, ts AS occurred_at,
    ts + to_minutes(k % 7) AS observed_at, CAST(ts AS DATE) AS local_date,
    'Task ' || (k % 5) || CASE WHEN event_id % 3 = 0 THEN ' (2)' ELSE '' END AS title,
    'issue #' || (k % 9) || ' of ' || project_key AS summary, project_key,
    upper(project_key) || '-' || own_source AS project_label,
    CASE WHEN kind LIKE 'task\\_%' ESCAPE '\\' THEN project_key || ':' || user_id || ':' || (k % 5) END AS task_key,
    CASE kind WHEN 'output_created' THEN 'o:' || project_key || ':' || (k % 25)
      WHEN 'knowledge_reused' THEN 'l:' || project_key || ':' || (k % 10) END AS object_key,
    'u' || user_id AS session_id, 't' || (event_id % 50) AS turn_id,
    CASE event_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'observed' WHEN 2 THEN 'reported' ELSE 'inferred' END AS confidence,
    CASE WHEN kind IN ('knowledge_created', 'knowledge_updated') THEN 'wiki/' || project_key || '/n' || (k % 20) || '.md' END AS note_path,
    event_id % 3 = 0 AS git_ref, event_id % 3 = 1 AS codex_ref, event_id, user_id, k
  FROM act1
)"""

TASKS = "('task_started','task_progress','task_completed','task_blocked')"

REC = """
rec0 AS (
  SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ask
  FROM conversations WHERE role <> 'system'
), rec AS (
  SELECT 'c-' || conv_id || '-' || turn AS event_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INT)) + to_minutes(CAST(turn AS INT)) AS captured_at,
    CAST(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INT)) + to_minutes(CAST(turn AS INT)) AS DATE) AS date,
    CASE WHEN conv_id % 4 = 3 THEN 'chatgpt_web' ELSE 'codex' END AS source,
    CASE WHEN role = 'user' THEN 'UserPromptSubmit' ELSE 'Stop' END AS event,
    's' || conv_id AS session_id, 't' || CAST(ask AS BIGINT) AS turn_id, conv_id, turn, role, CAST(ask AS BIGINT) AS ask,
    (CASE WHEN conv_id % 7 = 0 THEN '/home/dev/.codex/worktrees/w1/' ELSE '/home/dev/' END) || 'proj' || (conv_id % 5) AS cwd,
    CASE WHEN role = 'user' AND conv_id % 5 = 1 AND ask >= 3 THEN '继续' ELSE
      (CASE WHEN role = 'user' AND conv_id % 11 = 5 THEN 'Automation ID: nightly' || chr(10)
        WHEN role = 'user' AND conv_id % 19 = 4 THEN '[no-obsidian] '
        WHEN role = 'user' AND conv_id % 13 = 6 AND ask >= 2 THEN '新任务：'
        WHEN role = 'user' AND conv_id % 17 = 3 THEN 'issue #' || (conv_id % 23) || ' '
        WHEN role <> 'user' AND conv_id % 11 = 5 AND conv_id % 2 = 0 THEN '队列为空' || chr(10)
        WHEN role <> 'user' AND conv_id % 11 = 5 THEN 'message_id 42' || chr(10)
        WHEN role <> 'user' AND conv_id % 3 = 0 THEN '已完成：收尾' || chr(10) || '测试全部通过' || chr(10)
        WHEN role <> 'user' AND conv_id % 7 = 2 THEN '无法完成：缺少权限' || chr(10)
        ELSE '' END) || text END AS content,
    conv_id * 1000000 + turn AS ingest_seq
  FROM rec0
)"""

TITLES = """
titles AS (
  SELECT 's' || doc_id AS session_id,
    'Topic ' || (doc_id % 12) || CASE WHEN doc_id % 3 = 0 THEN ' (' || (2 + doc_id % 4) || ')' ELSE '' END AS title
  FROM labels
)"""

RES = """
res AS (
  SELECT 'f' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS event_id, o_orderdate AS captured_at, CAST(o_orderdate AS DATE) AS date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'tasks' WHEN '2-HIGH' THEN 'base' WHEN '3-MEDIUM' THEN 'documents'
      WHEN '5-LOW' THEN 'approvals' ELSE 'messages' END AS resource_type,
    'r' || (o_custkey % 500) AS resource_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS resource_version,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'blocked' ELSE 'open' END AS resource_status,
    'Team ' || (o_custkey % 7) AS project_hint, CASE WHEN o_orderkey % 10 = 0 THEN 'revoked' ELSE 'available' END AS access_status,
    'Order ' || o_orderkey AS title, o_orderkey, o_custkey,
    'Order ' || o_orderkey || ' is ' || CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'blocked' ELSE 'open' END AS content
  FROM orders
)"""

ART = """
art AS (
  SELECT 'a' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS local_date,
    o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)) AS occurred_at, 'p' || (o_custkey % 10) AS project_key,
    'Project ' || (o_custkey % 10) AS project_label,
    CASE WHEN o_orderkey % 5 = 0 THEN 'task:' || (o_custkey % 50) END AS task_key,
    CASE o_orderkey % 4 WHEN 0 THEN 'git-commit' WHEN 1 THEN 'knowledge-note' WHEN 2 THEN 'file-deliverable' ELSE 'completion-report' END AS kind,
    'fix: ' || lower(substr(o_orderpriority, 3, 20)) || ' item ' || (o_orderkey % 40) AS title,
    CASE WHEN o_orderkey % 6 = 0 THEN 'Problem ' || (o_orderkey % 30) END AS problem,
    'Result ' || (o_orderkey % 100) || CASE WHEN o_orderkey % 9 = 0 THEN ' issue #' || (o_orderkey % 8) ELSE '' END AS result,
    CASE o_orderkey % 4 WHEN 0 THEN 'independent' WHEN 2 THEN 'target-present' ELSE 'report-only' END AS proof, o_orderkey AS k
  FROM orders
), art_files AS (
  SELECT DISTINCT 'a' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS id, 'src/f' || (l_partkey % 60) || '.py' AS file FROM lineitem
), art_events AS (
  SELECT DISTINCT 'a' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS id, 'x' || (l_orderkey * 10 + l_linenumber) AS event_id FROM lineitem
)"""

LEDGER = """
ledger AS (
  SELECT CASE WHEN o_orderkey % 21 = 0 THEN 'outcome:backfill:' ELSE 'outcome:' END || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id,
    CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'succeeded' ELSE 'not-applicable' END AS status,
    o_orderdate + to_days(1) AS updated_at, CASE WHEN o_orderkey % 2 = 0 THEN 'durable-output' ELSE 'knowledge-topic' END AS category,
    'Settled ' || o_orderkey AS title, o_orderkey AS k
  FROM orders
), ledger_events AS (
  SELECT DISTINCT id AS settlement_id, 'x' || (l_orderkey * 10 + l_linenumber) AS event_id
  FROM ledger JOIN lineitem ON l_orderkey = k OR (k % 4 = 0 AND l_orderkey = k + 1)
)"""

NOTES = """
notes AS (
  SELECT 'wiki/' || source || '/d' || doc_id || '.md' AS path, doc_id, text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INT)) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INT)) + to_days(CAST(doc_id % 3 AS INT)) AS modified_at, source, lang
  FROM documents
)"""
