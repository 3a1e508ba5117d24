"""Queries over identities, artifacts, outcomes and settlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import artifacts as a
from tracefold.operators import identity as i
from tracefold.operators import outcomes as o
from tracefold.operators.metrics import filter_outcomes, outcome_metric_events
from tracefold.plans.catalog import query, with_ctes
from tracefold.plans.catalog.conversations import PAIRS
from tracefold.plans.catalog.given_sql import ACT, ART, LEDGER, REC, TASKS, TITLES
from tracefold.sources import given_tables as g

# --- identity ------------------------------------------------------------------------------------
COPIES = f"""
tasks AS (
  SELECT task_key, arg_min(project_key, (occurred_at, id)) AS project_key, min(occurred_at) AS first_at, arg_min(session_id, (occurred_at, id)) AS session,
    min((occurred_at, id)) FILTER (kind = 'task_started') AS start, regexp_replace(arg_min(title, (occurred_at, id)), '\\s*\\(\\d+\\)$', '') AS title,
    arg_min(title, (occurred_at, id)) LIKE '% (2)' AS numbered
  FROM act WHERE kind IN {TASKS} GROUP BY task_key
), gaps AS (
  SELECT *, lower(title) AS family, CASE WHEN first_at - lag(first_at) OVER (PARTITION BY project_key, lower(title) ORDER BY first_at, task_key) <= INTERVAL {{gap}} THEN 0 ELSE 1 END AS broke FROM tasks
), islands AS (
  SELECT *, sum(broke) OVER (PARTITION BY project_key, family ORDER BY first_at, task_key) AS island FROM gaps
), clusters AS (
  SELECT project_key, family, island, arg_min(title, (numbered, first_at, task_key)) AS new_title,
    'codex:' || project_key || ':' || replace(family, ' ', '%20') || ':' || arg_min(session, (numbered, first_at, task_key)) AS new_key, min(start) AS first_started
  FROM islands GROUP BY project_key, family, island HAVING count(*) >= 2 AND bool_or(numbered) AND count(DISTINCT session) >= 2
), replaced AS (SELECT task_key, new_key, new_title, first_started[2] AS first_start FROM islands JOIN clusters USING (project_key, family, island))"""
RENAMED = """
SELECT id, CASE WHEN kind = 'task_started' AND new_key IS NOT NULL AND id IS DISTINCT FROM first_start THEN 'task_progress' ELSE kind END AS kind,
  coalesce(new_key, task_key) AS task_key, coalesce(new_title, title) AS title FROM act LEFT JOIN replaced USING (task_key)"""


@query("merge_numbered_copies", with_ctes(ACT, COPIES.format(gap="14 DAY"), RENAMED))
def _merge_numbered_copies(spark, sf):
    return i.merge_numbered_copies(g.events_as_activity(spark, sf)).select("id", "kind", "task_key", "title")


@query("numbered_copies_two_day_gap", with_ctes(ACT, COPIES.format(gap="2 DAY"), "SELECT task_key, new_key, new_title, first_start FROM replaced"))
def _numbered_copies_two_day_gap(spark, sf):
    return i.numbered_copies(g.events_as_activity(spark, sf), gap_days=2)


@query("merge_explicit_identities", with_ctes(ACT, f"""
said AS (SELECT *, project_key || ':issue:' || (k % 9) AS identity, CASE WHEN git_ref THEN 'git' WHEN codex_ref THEN 'codex' END AS ref_type FROM act WHERE kind IN {TASKS}),
grouped AS (
  SELECT identity, (min((occurred_at, id)) FILTER (kind = 'task_started'))[2] AS first_start, arg_min(title, (NOT codex_ref, occurred_at, id)) AS new_title, min((occurred_at, id)) AS first_seen
  FROM said GROUP BY identity HAVING count(DISTINCT task_key) >= 2 AND count(DISTINCT ref_type) >= 2
), replaced AS (
  SELECT task_key, 'work:' || m.identity AS new_key, m.new_title AS new_title, m.first_start AS first_start
  FROM (SELECT task_key, arg_max({{'identity': identity, 'new_title': new_title, 'first_start': first_start}}, (first_seen, identity)) AS m
    FROM (SELECT DISTINCT identity, task_key FROM said) JOIN grouped USING (identity) GROUP BY task_key)
)""", RENAMED))
def _merge_explicit_identities(spark, sf):
    return i.merge_explicit_identities(g.events_as_activity(spark, sf)).select("id", "kind", "task_key", "title")


PROJECT = "CASE WHEN cwd LIKE '%/worktrees/%' THEN regexp_extract(cwd, '/worktrees/[^/]+/(.+)$', 1) ELSE cwd END"
FAMILIES = f"""
families AS (
  WITH heads AS (SELECT session_id, min(captured_at) AS first_seen, arg_min({PROJECT}, (captured_at, id)) AS project FROM pairs WHERE source = 'codex' GROUP BY session_id),
  named AS (SELECT session_id, first_seen, regexp_matches(title, '\\(\\d+\\)$') AS numbered, lower(project) || ':' || lower(regexp_replace(title, '\\s*\\(\\d+\\)$', '')) AS family FROM heads JOIN titles USING (session_id)),
  groups AS (SELECT family, arg_min(session_id, (first_seen, session_id)) FILTER (NOT numbered) AS base FROM named GROUP BY family HAVING count(*) >= 2 AND bool_or(numbered))
  SELECT session_id, 'codex:numbered-family:' || family AS family_anchor FROM named JOIN groups USING (family) WHERE numbered OR session_id = base
)"""


@query("numbered_families", with_ctes(REC, TITLES, PAIRS, FAMILIES, "SELECT * FROM families"))
def _numbered_families(spark, sf):
    from tracefold.operators.turns import build_pairs

    return i.numbered_families(build_pairs(g.conversations_as_records(spark, sf)), g.labels_as_index(spark, sf))


# --- same outcome, components --------------------------------------------------------------------
HEADS = """
heads AS (
  SELECT art.*, lower(regexp_replace(title, '^fix: ', '')) AS norm,
    list_filter(string_split_regex(lower(regexp_replace(title, '^fix: ', '')), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ('fix', 'feat', 'docs', 'test', 'chore')) AS tokens,
    CASE WHEN task_key IS NOT NULL THEN 'task:' || task_key WHEN result LIKE '%issue #%' THEN 'issue:' || regexp_extract(result, 'issue #(\\d+)', 1) END AS anchor,
    coalesce(f.files, []) AS files, coalesce(e.events, []) AS events
  FROM art LEFT JOIN (SELECT id, list(DISTINCT file) AS files FROM art_files GROUP BY id) f USING (id)
  LEFT JOIN (SELECT id, list(DISTINCT event_id) AS events FROM art_events GROUP BY id) e USING (id)
)"""
RULE = """(a.task_key = b.task_key OR list_has_any(a.events, b.events) OR a.anchor = b.anchor OR a.norm = b.norm
  OR (len(list_intersect(a.files, b.files)) > 0 AND (len(list_intersect(a.files, b.files)) >= 2 OR len(list_intersect(a.files, b.files)) / least(len(a.files), len(b.files)) >= 0.6) AND list_has_any(a.tokens, b.tokens)))"""
COMPONENTS = f"""
edges AS MATERIALIZED (
  SELECT a.id AS src, b.id AS dst FROM heads a JOIN heads b ON a.local_date = b.local_date AND a.project_key = b.project_key AND a.id <> b.id WHERE {RULE}
), reach AS (
  SELECT id AS node, id AS root FROM heads
  UNION
  SELECT e.dst, r.root FROM reach r JOIN edges e ON e.src = r.node
), comp AS (SELECT node AS id, min(root) AS component FROM reach GROUP BY node)"""
RECURSIVE = lambda *parts: with_ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _parts(spark, sf):
    return g.order_artifacts(spark, sf), g.line_files(spark, sf), g.line_events(spark, sf)


@query("outcome_components", RECURSIVE(ART, HEADS, COMPONENTS, "SELECT id, component FROM comp"))
def _outcome_components(spark, sf):
    return o.outcome_components(*_parts(spark, sf))


@query("same_outcome_edges", RECURSIVE(ART, HEADS, COMPONENTS, "SELECT id AS src, component AS dst FROM comp WHERE id <> component"))
def _same_outcome_edges(spark, sf):
    return o.same_outcome_edges(*_parts(spark, sf))


@query("same_outcome_rule", with_ctes(ART, HEADS, f"""
SELECT a.id AS left_id, b.id AS right_id FROM heads a JOIN heads b ON a.local_date = b.local_date AND a.project_key = b.project_key AND a.k % 10 = b.k % 10 AND a.id < b.id WHERE {RULE}"""))
def _same_outcome_rule(spark, sf):
    arts, files, events = _parts(spark, sf)
    slotted = arts.withColumn("slot", F.substring("id", 2, 12).cast("long") % 10)
    return o.same_outcome_pairs(slotted, files, events, ["local_date", "project_key", "slot"])


RANK = "(CASE WHEN task_key IS NULL THEN 0 ELSE -1 END, CASE WHEN kind IN ('completion-report', 'file-deliverable') THEN -3 WHEN kind = 'knowledge-note' THEN -2 ELSE -1 END, -epoch_us(occurred_at), id)"
GROUPED = "grouped AS (SELECT heads.*, component FROM heads JOIN comp USING (id))"
IDENTITY = f"""
ident AS (
  SELECT component, 'outcome:' || left(sha256(CAST(arg_min(local_date, {RANK}) AS VARCHAR) || chr(0) || arg_min(project_key, {RANK}) || chr(0) || coalesce(min(anchor), arg_min(norm, {RANK}))), 20) AS generated_id,
    arg_min(title, {RANK}) AS title, count(*) AS artifact_count, max(occurred_at) AS occurred_at, any_value(local_date) AS local_date, any_value(project_key) AS project_key,
    CASE max(CASE proof WHEN 'independent' THEN 3 WHEN 'target-present' THEN 2 ELSE 1 END) WHEN 3 THEN 'independent' WHEN 2 THEN 'target-present' ELSE 'report-only' END AS proof,
    CASE WHEN count(*) > 1 OR bool_or(task_key IS NOT NULL OR problem IS NOT NULL) THEN 'pending' ELSE 'not-applicable' END AS default_status, count(DISTINCT task_key) AS task_count
  FROM grouped GROUP BY component
)"""


def _grouped(spark, sf):
    arts, files, events = _parts(spark, sf)
    return arts.join(o.outcome_components(arts, files, events), "id")


@query("preferred_title", RECURSIVE(ART, HEADS, COMPONENTS, GROUPED, f"SELECT component, arg_min(title, {RANK}) AS title FROM grouped GROUP BY component"))
def _preferred_title(spark, sf):
    return o.preferred_title(_grouped(spark, sf))


@query("default_status", RECURSIVE(ART, HEADS, COMPONENTS, GROUPED, IDENTITY, "SELECT component, default_status FROM ident"))
def _default_status(spark, sf):
    return o.default_status(_grouped(spark, sf))


@query("outcome_identity", RECURSIVE(ART, HEADS, COMPONENTS, GROUPED, IDENTITY, "SELECT component, generated_id FROM ident"))
def _outcome_identity(spark, sf):
    return o.outcome_identity(_grouped(spark, sf))


SETTLED = """
comp_events AS (SELECT DISTINCT component, event_id FROM art_events JOIN comp USING (id)),
matched AS (SELECT DISTINCT component, settlement_id FROM comp_events JOIN ledger_events USING (event_id)),
settled AS (
  SELECT component, arg_max(settlement_id, ord) AS settlement_id, arg_max(status, ord) AS settlement_status FROM (
    SELECT component, settlement_id, status, (updated_at, CASE status WHEN 'failed' THEN 4 WHEN 'pending' THEN 3 WHEN 'succeeded' THEN 2 ELSE 1 END, settlement_id) AS ord
    FROM matched JOIN ledger ON ledger.id = settlement_id) GROUP BY component
)"""
TEXTS = """
texts AS (
  SELECT component, text, min((occurred_at, id, place)) AS pos FROM (
    SELECT component, occurred_at, id, 0 AS place, problem AS text FROM grouped UNION ALL SELECT component, occurred_at, id, 1, result FROM grouped
  ) WHERE text IS NOT NULL GROUP BY component, text
), summaries AS (
  SELECT component, array_to_string(list(text ORDER BY pos), chr(10)) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY pos) AS n FROM texts) WHERE n <= 6 GROUP BY component
), problems AS (
  SELECT component, array_to_string(list(text ORDER BY pos), chr(10)) AS problem FROM (
    SELECT component, problem AS text, min((occurred_at, id)) AS pos, row_number() OVER (PARTITION BY component ORDER BY min((occurred_at, id))) AS n FROM grouped WHERE problem IS NOT NULL GROUP BY component, problem
  ) WHERE n <= 3 GROUP BY component
)"""
OUTCOMES = f"""
outcomes AS (
  SELECT coalesce(settlement_id, generated_id) AS id, component, local_date, occurred_at, project_key, title, problem, summary, proof, artifact_count, task_count,
    (SELECT count(*) FROM comp_events c WHERE c.component = ident.component) AS event_count, coalesce(settlement_status, default_status) AS settlement_status
  FROM ident LEFT JOIN settled USING (component) LEFT JOIN summaries USING (component) LEFT JOIN problems USING (component)
)"""
OUT_COLUMNS = [
    "id", "component", "local_date", "occurred_at", "project_key", "title", "problem", "summary", "proof", "artifact_count", "task_count",
    "event_count", "settlement_status",
]
ALL_OUTCOMES = [ART, HEADS, COMPONENTS, GROUPED, IDENTITY, LEDGER, SETTLED, TEXTS, OUTCOMES]


def _outcomes(spark, sf):
    return o.aggregate_outcomes(*_parts(spark, sf), g.order_ledger(spark, sf), g.ledger_events(spark, sf))


@query("aggregate_outcomes", RECURSIVE(*ALL_OUTCOMES, "SELECT * FROM outcomes"))
def _aggregate_outcomes(spark, sf):
    return _outcomes(spark, sf).select(*OUT_COLUMNS)


@query("filter_outcomes", RECURSIVE(*ALL_OUTCOMES, """
SELECT id, component, occurred_at, proof FROM outcomes WHERE local_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND proof = 'independent' ORDER BY occurred_at DESC, id"""))
def _filter_outcomes(spark, sf):
    return filter_outcomes(_outcomes(spark, sf), "1996-01-01", "1997-12-31", proof="independent").select("id", "component", "occurred_at", "proof")


@query("outcome_metric_events", RECURSIVE(*ALL_OUTCOMES, """
SELECT id, local_date, title, CASE proof WHEN 'independent' THEN 'verified' WHEN 'target-present' THEN 'observed' ELSE 'reported' END AS confidence FROM outcomes"""))
def _outcome_metric_events(spark, sf):
    return outcome_metric_events(_outcomes(spark, sf)).select("id", "local_date", "title", "confidence")


@query("settlement_summary", RECURSIVE(*ALL_OUTCOMES, """
SELECT count(*) AS outcomes, count(*) FILTER (settlement_status = 'succeeded') AS succeeded, count(*) FILTER (settlement_status = 'pending') AS pending,
  count(*) FILTER (settlement_status = 'failed') AS failed,
  (SELECT count(*) FROM ledger SEMI JOIN outcomes ON outcomes.id = ledger.id WHERE ledger.k % 2 = 0) AS created,
  (SELECT count(*) FROM ledger SEMI JOIN outcomes ON outcomes.id = ledger.id WHERE ledger.k % 2 = 1) AS updated FROM outcomes"""))
def _settlement_summary(spark, sf):
    ledger = g.order_ledger(spark, sf)
    changes = ledger.select(F.col("id").alias("settlement_id"), F.when(F.col("k") % 2 == 0, "created").otherwise("updated").alias("action"))
    return o.settlement_summary(_outcomes(spark, sf), changes)


@query("outcome_artifacts", RECURSIVE(ART, HEADS, COMPONENTS, "SELECT component AS outcome_id, id, title FROM comp JOIN art USING (id)"))
def _outcome_artifacts(spark, sf):
    arts, files, events = _parts(spark, sf)
    members = o.outcome_components(arts, files, events).withColumnRenamed("component", "outcome_id")
    return o.outcome_artifacts(members, arts).select("outcome_id", "id", "title")


# --- settlements ---------------------------------------------------------------------------------
@query("match_settlements", with_ctes(ART, LEDGER, """
SELECT id, settlement_id, count(*) AS shared FROM art_events JOIN (SELECT DISTINCT * FROM ledger_events) USING (event_id) GROUP BY id, settlement_id"""))
def _match_settlements(spark, sf):
    return o.match_settlements(g.line_events(spark, sf), g.ledger_events(spark, sf))


@query("reusable_settlement", with_ctes(ART, LEDGER, """
sizes AS (SELECT settlement_id, count(DISTINCT event_id) AS size FROM ledger_events GROUP BY 1),
inside AS (SELECT a.id, settlement_id FROM art_events a JOIN (SELECT DISTINCT * FROM ledger_events) USING (event_id) JOIN sizes USING (settlement_id)
  WHERE settlement_id IN (SELECT id FROM ledger WHERE status = 'succeeded') GROUP BY ALL HAVING count(*) = any_value(size))""", """
SELECT id, min(settlement_id) AS settlement_id FROM inside GROUP BY id HAVING count(*) = 1"""))
def _reusable_settlement(spark, sf):
    return o.reusable_settlement(g.line_events(spark, sf), g.order_ledger(spark, sf), g.ledger_events(spark, sf))


UNCLAIMED = """
unclaimed AS (SELECT * FROM ledger WHERE (status IN ('succeeded', 'failed') OR category = 'durable-output')
  AND id NOT IN (SELECT settlement_id FROM ledger_events SEMI JOIN art_events USING (event_id)))"""


@query("unclaimed_settlements", with_ctes(ART, LEDGER, UNCLAIMED, "SELECT id, status, category FROM unclaimed"))
def _unclaimed_settlements(spark, sf):
    return o.unclaimed_settlements(g.order_ledger(spark, sf), g.ledger_events(spark, sf), g.line_events(spark, sf)).select("id", "status", "category")


@query("select_latest_settlement", with_ctes(ART, LEDGER, """
m AS (SELECT DISTINCT a.id, settlement_id FROM art_events a JOIN ledger_events USING (event_id))""", """
SELECT m.id, arg_max(settlement_id, (updated_at, CASE status WHEN 'failed' THEN 4 WHEN 'pending' THEN 3 WHEN 'succeeded' THEN 2 ELSE 1 END, settlement_id)) AS settlement_id,
  max(updated_at) AS settled_at FROM m JOIN ledger ON ledger.id = settlement_id GROUP BY m.id"""))
def _select_latest_settlement(spark, sf):
    matches = o.match_settlements(g.line_events(spark, sf), g.ledger_events(spark, sf))
    return o.select_latest_settlement(matches, g.order_ledger(spark, sf), "id").select("id", "settlement_id", "settled_at")


# Settlements over activity events: one per user and week, ids in both the plain and the session:turn form.
WEEKLY = """
weekly AS (SELECT 'w:' || owner || ':' || CAST(date_trunc('week', local_date) AS DATE) AS settlement_id, CASE WHEN event_id % 2 = 0 THEN id ELSE session_id || ':' || turn_id || ':Stop' END AS source_id
  FROM act WHERE k % 10 = 0),
links AS (SELECT DISTINCT settlement_id, id AS event_id FROM weekly JOIN act ON act.id = source_id
  UNION SELECT DISTINCT settlement_id, id FROM weekly JOIN act ON source_id = session_id || ':' || turn_id || ':Stop')"""


def _weekly(spark, sf):
    e = g.events_as_activity(spark, sf)
    number = F.substring("id", 2, 12).cast("long")
    k = F.regexp_extract("summary", r"#(\d+)", 1)
    source = F.when(number % 2 == 0, F.col("id")).otherwise(F.concat_ws(":", "session_id", "turn_id", F.lit("Stop")))
    raw = g.read(spark, sf, "events").select(F.format_string("e%012d", "event_id").alias("id"), g.props_k().alias("k"))
    rows = e.join(raw.where(F.col("k") % 10 == 0), "id")
    week = F.to_date(F.date_trunc("week", "local_date")).cast("string")
    del k
    return e, rows.select(F.concat_ws(":", F.lit("w"), "owner", week).alias("settlement_id"), source.alias("event_id"))


@query("settlement_events", with_ctes(ACT, WEEKLY, "SELECT settlement_id, event_id FROM links"))
def _settlement_events(spark, sf):
    events, weekly = _weekly(spark, sf)
    return o.settlement_events(weekly, events)


@query("settlement_outcomes", with_ctes(ACT, WEEKLY, """
led AS (SELECT DISTINCT settlement_id, CASE WHEN settlement_id LIKE '%1:%' THEN 'failed' ELSE 'succeeded' END AS status FROM weekly),
told AS (SELECT settlement_id, arg_max(observed_at, (occurred_at, id)) AS observed_at, arg_max(title, (occurred_at, id)) AS etitle, arg_max(project_key, (occurred_at, id)) AS project_key,
  arg_min(summary, (occurred_at, id)) FILTER (kind IN ('task_started', 'task_progress')) AS problem, count(*) AS event_count FROM links JOIN act ON act.id = links.event_id GROUP BY settlement_id)""", """
SELECT settlement_id AS id, observed_at AS occurred_at, project_key, CASE status WHEN 'failed' THEN '知识沉淀失败：' || etitle ELSE etitle END AS title, problem,
  CASE status WHEN 'succeeded' THEN 'target-present' ELSE 'report-only' END AS proof, event_count, status AS settlement_status FROM led JOIN told USING (settlement_id)"""))
def _settlement_outcomes(spark, sf):
    events, weekly = _weekly(spark, sf)
    ledger = weekly.select(F.col("settlement_id").alias("id")).distinct().select(
        "id", F.when(F.col("id").contains("1:"), "failed").otherwise("succeeded").alias("status"), F.lit("2024-02-01").cast("timestamp").alias("updated_at")
    )
    rows = o.settlement_outcomes(ledger, o.settlement_events(weekly, events), events)
    return rows.select("id", "occurred_at", "project_key", "title", "problem", "proof", "event_count", "settlement_status")


@query("related_task_events", with_ctes(ACT, f"""
g AS (SELECT DISTINCT 'c' || (user_id % 7) AS component, local_date, project_key, task_key FROM act WHERE kind = 'task_started')""", """
SELECT component, id AS event_id FROM act JOIN g USING (local_date, project_key, task_key)"""))
def _related_task_events(spark, sf):
    events = g.events_as_activity(spark, sf)
    grouped = events.where(F.col("kind") == "task_started").withColumn(
        "component", F.concat(F.lit("c"), (F.substring("owner", 2, 9).cast("int") % 7).cast("string"))
    )
    return o.related_task_events(grouped, events).select("component", "event_id")


# --- commits and reports -------------------------------------------------------------------------
@query("attach_reports_to_commits", """
WITH commits AS (SELECT 'k' || o_orderkey AS commit_id, left(sha256(CAST(o_orderkey % 12000 AS VARCHAR)), 40) AS hash, o_orderkey AS k FROM orders),
reports AS (SELECT 'r' || k AS report_id, left(hash, CAST(7 + k % 20 AS INT)) AS prefix FROM commits WHERE k % 3 = 0),
hits AS (SELECT DISTINCT report_id, commit_id, hash FROM reports JOIN commits ON left(hash, 7) = left(prefix, 7) AND starts_with(hash, prefix))
SELECT report_id, min(commit_id) AS commit_id FROM hits GROUP BY report_id HAVING count(*) = 1""")
def _attach_reports_to_commits(spark, sf):
    k = F.col("o_orderkey")
    orders = g.read(spark, sf, "orders").select(k, F.substring(F.sha2((k % 12000).cast("string"), 256), 1, 40).alias("hash"))
    commits = orders.select(F.concat(F.lit("k"), k.cast("string")).alias("commit_id"), "hash")
    prefix = F.expr("substring(hash, 1, cast(7 + o_orderkey % 20 as int))")
    reports = orders.where(k % 3 == 0).select(F.concat(F.lit("r"), k.cast("string")).alias("id"), F.concat(F.lit("已提交 commit: "), prefix).alias("result"))
    return a.attach_reports_to_commits(reports, commits).select("report_id", "commit_id")
