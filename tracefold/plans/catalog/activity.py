"""Queries over the activity table: tasks, calendar, metrics, focus, projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions import dates
from tracefold.functions.text import event_dimension
from tracefold.operators import metrics as m
from tracefold.plans.catalog import query, with_ctes
from tracefold.plans.catalog.given_sql import ACT, TASKS
from tracefold.sources import given_tables as g

START, END = "2024-01-08", "2024-01-21"
SCOPED = f"scoped AS (SELECT * FROM act WHERE local_date BETWEEN DATE '{START}' AND DATE '{END}')"
UNITS = f"""
unit_rows AS (
  SELECT *, coalesce(task_key, 'research:' || coalesce(session_id, id)) AS identity,
    CASE kind WHEN 'task_blocked' THEN 4 WHEN 'task_completed' THEN 3 WHEN 'task_progress' THEN 2 WHEN 'task_started' THEN 1 ELSE 0 END AS prio
  FROM {{src}} WHERE kind IN {TASKS} OR kind = 'research_activity'
), units AS (
  SELECT *, row_number() OVER (PARTITION BY owner, local_date, identity ORDER BY occurred_at, id) AS first_rn,
    row_number() OVER (PARTITION BY owner, local_date, identity ORDER BY prio DESC, occurred_at DESC, id DESC) AS best_rn
  FROM unit_rows
), anchors AS (SELECT * FROM units WHERE first_rn = 1),
representatives AS (SELECT * FROM units WHERE best_rn = 1),
switches AS (
  SELECT * FROM (
    SELECT owner, local_date, id, occurred_at, project_key,
      lag(occurred_at) OVER w AS prev_at, lag(project_key) OVER w AS from_project
    FROM anchors WHERE project_key <> 'unassigned' WINDOW w AS (PARTITION BY owner, local_date ORDER BY occurred_at, id)
  ) WHERE from_project <> project_key AND occurred_at - prev_at <= INTERVAL 90 MINUTE
)"""
NOTE_KEY = "coalesce(note_path, object_key, id)"


@query("filter_events", with_ctes(ACT, f"""
SELECT id, local_date, project_key, confidence FROM act
WHERE local_date BETWEEN DATE '{START}' AND DATE '{END}' AND project_key = 'p3' AND confidence = 'observed'"""))
def _filter_events(spark, sf):
    df = m.filter_events(g.events_as_activity(spark, sf), START, END, project="p3", confidence="observed")
    return df.select("id", "local_date", "project_key", "confidence")


@query("aggregate_tasks", with_ctes(ACT, f"""
SELECT task_key, arg_max(project_key, (occurred_at, id)) AS project_key, arg_max(project_label, (occurred_at, id)) AS project_label,
  arg_min(title, (occurred_at, id)) AS title,
  CASE arg_max(kind, (occurred_at, id)) WHEN 'task_completed' THEN 'completed' WHEN 'task_blocked' THEN 'blocked' ELSE 'active' END AS status,
  arg_max(confidence, (occurred_at, id)) AS status_confidence, min(occurred_at) AS first_observed_at,
  arg_max(observed_at, (occurred_at, id)) AS last_activity_at,
  array_to_string(list_sort(list_distinct(list(CAST(local_date AS VARCHAR)))), '|') AS active_dates,
  count(*) AS event_count, count(DISTINCT session_id || ':' || turn_id) AS turn_count
FROM act WHERE task_key IS NOT NULL AND kind IN {TASKS} GROUP BY task_key"""))
def _aggregate_tasks(spark, sf):
    tasks = m.aggregate_tasks(g.events_as_activity(spark, sf))
    return tasks.withColumn("active_dates", F.array_join(F.transform("active_dates", lambda d: d.cast("string")), "|"))


@query("task_events", with_ctes(ACT, f"SELECT task_key, id AS event_id, occurred_at FROM act WHERE kind IN {TASKS}"))
def _task_events(spark, sf):
    return m.task_events(g.events_as_activity(spark, sf))


@query("task_sources", with_ctes(ACT, f"""
SELECT DISTINCT task_key, CASE WHEN git_ref THEN 'git:repo/' || project_key ELSE 'codex:raw/codex' END || ':' AS ref_key
FROM act WHERE kind IN {TASKS} AND (git_ref OR codex_ref)"""))
def _task_sources(spark, sf):
    return m.task_sources(g.events_as_activity(spark, sf)).select("task_key", "ref_key")


@query("order_tasks", with_ctes(ACT, f"""
SELECT task_key, arg_max(observed_at, (occurred_at, id)) AS last_activity_at FROM act WHERE kind IN {TASKS}
GROUP BY task_key ORDER BY last_activity_at DESC, task_key"""))
def _order_tasks(spark, sf):
    return m.order_tasks(m.aggregate_tasks(g.events_as_activity(spark, sf))).select("task_key", "last_activity_at")


@query("order_events", with_ctes(ACT, "SELECT id, occurred_at, kind FROM act ORDER BY occurred_at, id"))
def _order_events(spark, sf):
    return m.order_events(g.events_as_activity(spark, sf)).select("id", "occurred_at", "kind")


@query("group_by_project", with_ctes(ACT, f"""
SELECT project_label, count(*) AS tasks FROM (
  SELECT task_key, arg_max(project_label, (occurred_at, id)) AS project_label FROM act WHERE kind IN {TASKS} GROUP BY task_key
) GROUP BY project_label"""))
def _group_by_project(spark, sf):
    return m.group_by_project(m.aggregate_tasks(g.events_as_activity(spark, sf)))


CALENDAR = f"""
SELECT local_date, count(DISTINCT CASE WHEN kind IN {TASKS} THEN task_key END) AS tasks,
  count(DISTINCT CASE WHEN kind = 'output_created' THEN coalesce(object_key, id) END) AS outputs,
  count(DISTINCT CASE WHEN kind IN ('knowledge_created', 'knowledge_updated') THEN {NOTE_KEY} END) AS knowledge
FROM act WHERE kind IN {TASKS} OR kind IN ('output_created', 'knowledge_created', 'knowledge_updated') GROUP BY local_date"""


@query("calendar_days", with_ctes(ACT, CALENDAR))
def _calendar_days(spark, sf):
    return m.calendar_days(g.events_as_activity(spark, sf))


@query("daily_distribution", with_ctes(ACT, f"days AS ({CALENDAR})", f"""
dense AS (SELECT CAST(d AS DATE) AS local_date, coalesce(tasks, 0) AS tasks, coalesce(outputs, 0) AS outputs, coalesce(knowledge, 0) AS knowledge
  FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) s(d) LEFT JOIN days ON days.local_date = CAST(d AS DATE))""", """
SELECT *, greatest(1, max(greatest(tasks, outputs, knowledge)) OVER ()) AS largest FROM dense"""))
def _daily_distribution(spark, sf):
    return m.daily_distribution(g.events_as_activity(spark, sf), "2023-12-25", "2024-02-05")


@query("activity_units", with_ctes(ACT, UNITS.format(src="act"), """
SELECT a.owner, a.local_date, a.identity, a.id AS anchor_id, r.id AS representative_id, r.kind AS representative_kind
FROM anchors a JOIN representatives r USING (owner, local_date, identity)"""))
def _activity_units(spark, sf):
    return m.activity_units(g.events_as_activity(spark, sf)).select(
        "owner", "local_date", "identity", F.col("anchor.id").alias("anchor_id"),
        F.col("representative.id").alias("representative_id"), F.col("representative.kind").alias("representative_kind"),
    )


@query("focus_switches", with_ctes(ACT.replace("'u' || user_id AS owner", "'all' AS owner"), UNITS.format(src="act"), """
SELECT owner, local_date, id, occurred_at, project_key, from_project FROM switches"""))
def _focus_switches(spark, sf):
    # One owner for everything: the reference's single-user table, and the hottest group there can be.
    return m.focus_switches(m.activity_units(g.events_as_activity(spark, sf).withColumn("owner", F.lit("all"))))


KNOWN = f"""
known AS (SELECT local_date, {NOTE_KEY} AS note, arg_min(id, (occurred_at, id)) AS event_id, arg_min(codex_ref, (occurred_at, id)) AS sourced
  FROM scoped WHERE kind IN ('knowledge_created', 'knowledge_updated') GROUP BY ALL)"""


@query("metrics_for_range", with_ctes(ACT, SCOPED, UNITS.format(src="scoped"), KNOWN, """
made AS (SELECT DISTINCT coalesce(object_key, id) AS o FROM scoped WHERE kind = 'output_created'),
reused AS (SELECT DISTINCT coalesce(object_key, id) AS o FROM scoped WHERE kind = 'knowledge_reused'),
note_rows AS (SELECT note, bool_or(sourced) AS sourced FROM known GROUP BY note)""", """
SELECT 'activity' AS dimension, '任务推进' AS label, count(*) AS value,
  count(DISTINCT identity) || ' 项任务或对话 · ' || count(DISTINCT CASE WHEN project_key <> 'unassigned' THEN project_key END) || ' 个已归属项目 · 每项每日计 1 次' AS note FROM representatives
UNION ALL SELECT 'output', '产出', count(*), '以 Git commit 等可核对事实计数' FROM made
UNION ALL SELECT 'knowledge', '知识', (SELECT count(*) FROM known), '来源覆盖 ' || count(*) FILTER (sourced) || '/' || count(*) FROM note_rows
UNION ALL SELECT 'reuse', '积累', count(*), '显式 Wiki 引用 · 日期按修改时间估算' FROM reused
UNION ALL SELECT 'focus', '项目切换', (SELECT count(*) FROM switches), '按任务首次活动估算 · ' || count(DISTINCT local_date) || ' 个活跃日 · 90 分钟内' FROM anchors"""))
def _metrics_for_range(spark, sf):
    return m.metrics_for_range(g.events_as_activity(spark, sf), START, END)


@query("metric_evidence", with_ctes(ACT, SCOPED, UNITS.format(src="scoped"), KNOWN, """
SELECT 'activity' AS dimension, id AS event_id FROM representatives
UNION ALL SELECT 'output', arg_min(id, (occurred_at, id)) FROM scoped WHERE kind = 'output_created' GROUP BY coalesce(object_key, id)
UNION ALL SELECT 'knowledge', event_id FROM known
UNION ALL SELECT 'reuse', arg_min(id, (occurred_at, id)) FROM scoped WHERE kind = 'knowledge_reused' GROUP BY coalesce(object_key, id)
UNION ALL SELECT 'focus', id FROM switches"""))
def _metric_evidence(spark, sf):
    return m.metric_evidence(g.events_as_activity(spark, sf), START, END)


@query("knowledge_coverage", with_ctes(ACT, f"""
SELECT count(*) FILTER (sourced) AS sourced_notes, count(*) AS notes, round(count(*) FILTER (sourced) / count(*), 6) AS coverage
FROM (SELECT {NOTE_KEY} AS note, bool_or(codex_ref) AS sourced FROM act WHERE kind IN ('knowledge_created', 'knowledge_updated') GROUP BY 1)"""))
def _knowledge_coverage(spark, sf):
    return m.knowledge_coverage(g.events_as_activity(spark, sf))


@query("project_options", with_ctes(ACT, """
SELECT project_key, arg_max(project_label, (occurred_at, id)) AS label FROM act GROUP BY project_key"""))
def _project_options(spark, sf):
    return m.project_options(g.events_as_activity(spark, sf))


@query("reconcile_project_labels", with_ctes(ACT, """
best AS (SELECT project_key, arg_min(project_label, (CASE WHEN codex_ref THEN -3.0 WHEN note_path IS NOT NULL THEN -2.0 WHEN git_ref THEN -1.0 ELSE 0 END, occurred_at, id)) AS label
  FROM act GROUP BY project_key)""", "SELECT id, project_key, label AS project_label FROM act JOIN best USING (project_key)"))
def _reconcile_project_labels(spark, sf):
    return m.reconcile_project_labels(g.events_as_activity(spark, sf)).select("id", "project_key", "project_label")


@query("first_by_key", with_ctes(ACT, f"""
SELECT note, id FROM (SELECT {NOTE_KEY} AS note, id, row_number() OVER (PARTITION BY {NOTE_KEY} ORDER BY occurred_at, id) AS rn
  FROM act WHERE kind IN ('knowledge_created', 'knowledge_updated')) WHERE rn = 1"""))
def _first_by_key(spark, sf):
    events = g.events_as_activity(spark, sf).where(F.col("kind").isin("knowledge_created", "knowledge_updated"))
    return m.first_by_key(events.withColumn("note", m.note_identity()), ["note"]).select("note", "id")


@query("event_dimension", with_ctes(ACT, f"""
SELECT CASE WHEN kind IN {TASKS} THEN 'task' WHEN kind = 'output_created' THEN 'output' WHEN kind = 'knowledge_reused' THEN 'reuse'
  WHEN kind = 'research_activity' THEN 'research' ELSE 'knowledge' END AS dimension, count(*) AS events FROM act GROUP BY 1"""))
def _event_dimension(spark, sf):
    events = g.events_as_activity(spark, sf)
    return events.groupBy(event_dimension(F.col("kind")).alias("dimension")).agg(F.count(F.lit(1)).alias("events"))


@query("backoff_until", """
WITH n AS (SELECT user_id, count(*) AS attempts, date_trunc('millisecond', max(ts)) AS now, CASE WHEN user_id % 3 = 0 THEN 5000 ELSE 0 END AS asked FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, attempts, epoch_ms(CAST(epoch_ms(now) + CASE WHEN asked > 0 THEN asked ELSE least(86400000, 60000 * pow(2, least(8, attempts - 1))) END AS BIGINT)) AS retry_at FROM n""")
def _backoff_until(spark, sf):
    errors = g.read(spark, sf, "events").where(F.col("event_type") == "error")
    tries = errors.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("now"))
    asked = F.when(F.col("user_id") % 3 == 0, 5000).otherwise(0)
    return tries.select("user_id", "attempts", dates.backoff_until(F.col("now"), F.col("attempts"), asked).alias("retry_at"))


@query("staleness", """
WITH l AS (SELECT user_id, max(ts) AS last_event_at FROM events GROUP BY user_id)
SELECT user_id, last_event_at, TIMESTAMP '2024-01-31 00:00:00' - last_event_at > INTERVAL 36 HOUR AS stale FROM l""")
def _staleness(spark, sf):
    last = g.read(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_event_at"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return last.withColumn("stale", dates.is_stale(F.col("last_event_at"), now))
