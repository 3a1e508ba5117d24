"""Queries over resources, commits, ledgers, runs, sinks and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions import collab, dates, ids
from tracefold.functions.artifact_titles import display_title
from tracefold.operators import artifacts as a
from tracefold.operators import ledger as ld
from tracefold.operators import managed_notes as mn
from tracefold.operators import messages as ms
from tracefold.operators import sinks as k
from tracefold.operators import turns as u
from tracefold.operators.common import dealt, spread
from tracefold.plans.catalog import query, with_ctes
from tracefold.plans.catalog.conversations import PAIRS
from tracefold.plans.catalog.given_sql import ACT, ART, LEDGER, REC, RES, TITLES
from tracefold.sources import commits as cm
from tracefold.sources import given_tables as g
from tracefold.sources import ledger_files as lf
from tracefold.sources import resources as rs

def KEY():  # noqa: N802 - a column needs a session, so it is made on use
    return F.col("o_orderkey")


def s(col):
    return col.cast("string")


# --- collaboration payloads ----------------------------------------------------------------------
def payloads(spark, sf):
    orders = g.read(spark, sf, "orders")
    module = F.element_at(F.array(*[F.lit(m) for m in fv.COLLAB_MODULES]), (KEY() % 8 + 1).cast("int"))
    own = F.concat(F.lit("r"), s(F.col("o_custkey") % 500))
    seconds = F.unix_seconds("o_orderdate")
    body = F.struct(
        F.when(KEY() % 3 == 0, own).alias("task_id"), F.when(KEY() % 3 == 1, own).alias("id"), F.when(KEY() % 3 == 2, F.struct(F.lit(1).alias("n"))).alias("record_id"),
        F.concat(F.lit("Order "), s(KEY())).alias("name"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"),
        F.when(KEY() % 2 == 0, s(seconds)).otherwise(s(seconds * 1000)).alias("update_time"), F.when(KEY() % 10 == 0, F.lit(True)).alias("deleted"),
        F.when(KEY() % 10 == 1, F.lit(True)).alias("permission_denied"), F.concat(F.lit("worth "), s(F.col("o_totalprice").cast("long"))).alias("summary"),
    )
    return orders.select(KEY(), module.alias("module"), F.to_json(body).alias("payload"))


@query("normalize_resources", f"""
SELECT module || ':r' || (o_custkey % 500) AS resource_id, 'Order ' || o_orderkey AS title, o_orderdate AS updated_at,
  CASE WHEN o_orderkey % 10 = 0 THEN 'deleted' WHEN o_orderkey % 10 = 1 THEN 'revoked' ELSE 'available' END AS access_status, 'worth ' || CAST(trunc(o_totalprice) AS BIGINT) AS content,
  CASE WHEN module IN ('tasks', 'base') THEN CASE WHEN o_orderstatus = 'F' THEN 'task_completed' ELSE 'task_started' END
    WHEN module IN ('minutes', 'documents') THEN 'knowledge_created' WHEN module = 'approvals' THEN 'output_created' ELSE 'research_activity' END AS activity_kind,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT) ELSE CAST(epoch(o_orderdate) AS BIGINT) * 1000 END AS version
FROM (SELECT *, ({fv.COLLAB_MODULES})[o_orderkey % 8 + 1] AS module FROM orders) WHERE o_orderkey % 3 <> 2""")
def _normalize_resources(spark, sf):
    rows = rs.normalize_resources(payloads(spark, sf), captured_at=F.lit("2002-01-01").cast("timestamp"))
    return rows.select("resource_id", "title", "updated_at", "access_status", "content", "activity_kind", F.col("resource_version").cast("long").alias("version"))


@query("version_changed", with_ctes(RES, """
state AS (SELECT resource_type, resource_id, max(resource_version) AS version FROM res WHERE o_orderkey % 2 = 0 GROUP BY ALL)""", """
SELECT event_id, version IS NOT NULL AS seen_before, CASE WHEN version = resource_version THEN 'duplicate' ELSE 'accepted' END AS verdict FROM res LEFT JOIN state USING (resource_type, resource_id)"""))
def _version_changed(spark, sf):
    rows = g.orders_as_resources(spark, sf)
    state = rows.where(F.col("ingest_seq") % 2 == 0).groupBy("identity_scope", "resource_type", "resource_id").agg(F.max("resource_version").alias("version"))
    return rs.version_changed(rows, state).select("event_id", "seen_before", "verdict")


@query("retain_latest", with_ctes(RES, "SELECT event_id FROM res ORDER BY captured_at DESC, event_id LIMIT 500"))
def _retain_latest(spark, sf):
    return rs.retain_latest(g.orders_as_resources(spark, sf), 500, tie="event_id").select("event_id")


@query("infer_resource_kind", with_ctes(RES, """
SELECT event_id, CASE WHEN resource_type IN ('tasks', 'base') THEN CASE resource_status WHEN 'done' THEN 'task_completed' WHEN 'blocked' THEN 'task_blocked' ELSE 'task_progress' END
  WHEN resource_type = 'documents' THEN 'knowledge_updated' WHEN resource_type = 'approvals' THEN 'output_created' ELSE 'research_activity' END AS kind FROM res"""))
def _infer_resource_kind(spark, sf):
    return g.orders_as_resources(spark, sf).select("event_id", collab.infer_resource_kind(F.col("resource_type"), F.col("resource_status")).alias("kind"))


@query("project_fields", "SELECT o_orderkey, o_orderstatus FROM orders")
def _project_fields(spark, sf):
    return rs.project_fields(g.read(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderkey", "missing"])


@query("flatten_human_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS text FROM events")
def _flatten_human_values(spark, sf):
    return g.read(spark, sf, "events").select("event_id", rs.flatten_human_values(F.col("props")).alias("text"))


@query("discover_references", "SELECT DISTINCT 'tok-' || user_id || '-' || (event_id % 40) AS reference FROM events")
def _discover_references(spark, sf):
    token = F.concat_ws("-", F.lit("tok"), s(F.col("user_id")), s(F.col("event_id") % 40))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(token.alias("minute_token"))).alias("links")).alias("data"), token.alias("other")))
    return g.read(spark, sf, "events").select(F.explode(rs.discover_references(body)).alias("reference")).distinct()


@query("chunk_ids", "SELECT count(DISTINCT user_id) AS ids, 50 >= 1 AS bounded FROM events")
def _chunk_ids(spark, sf):
    refs = g.read(spark, sf, "events").select(s(F.col("user_id")).alias("reference"))
    sizes = rs.chunk_ids(refs).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("ids"), (F.max("n") <= 50).alias("bounded"))


def page_payloads(spark, sf):
    """One response page per customer: orders under a known list name, nested deeper, or as record rows."""
    o = g.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    items = F.transform("keys", lambda x: F.struct(x.alias("task_id")))
    more = F.col("page_id") % 2 == 0
    flat = F.to_json(F.struct(F.struct(items.alias("items"), more.alias("has_more"), F.concat(F.lit("n"), s(F.col("page_id"))).alias("page_token")).alias("data")))
    deep = F.to_json(F.struct(F.struct(F.struct(items.alias("records")).alias("inner")).alias("result"), more.alias("has_more"), F.lit("deep").alias("next_cursor")))
    return o.select("page_id", F.when(F.col("page_id") % 5 == 0, deep).otherwise(flat).alias("payload"))


@query("explode_payload_pages", """
SELECT o_custkey AS page_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS pos, o_orderkey AS task_id FROM orders""")
def _explode_payload_pages(spark, sf):
    items, _ = rs.explode_payload_pages(page_payloads(spark, sf))
    return items.select("page_id", "pos", F.get_json_object("item", "$.task_id").cast("long").alias("task_id"))


@query("payload_page_cursors", """
SELECT o_custkey AS page_id, CAST(count(*) AS INT) AS items, CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_custkey % 5 = 0 THEN 'deep' ELSE 'n' || o_custkey END END AS next_page FROM orders GROUP BY o_custkey""")
def _payload_page_cursors(spark, sf):
    return rs.explode_payload_pages(page_payloads(spark, sf))[1]


@query("parse_epoch_or_iso", "SELECT o_orderkey, o_orderdate AS at FROM orders")
def _parse_epoch_or_iso(spark, sf):
    sec = F.unix_seconds("o_orderdate")
    text = F.when(KEY() % 3 == 0, s(sec)).when(KEY() % 3 == 1, s(sec * 1000)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return g.read(spark, sf, "orders").select("o_orderkey", dates.parse_epoch_or_iso(text).alias("at"))


@query("classify_error", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'rate_limit' WHEN 'view' THEN 'auth_expired' WHEN 'error' THEN 'permission' WHEN 'signup' THEN 'missing_scope' ELSE 'odd' END AS category,
  CASE event_type WHEN 'view' THEN 'authorization_expired' WHEN 'error' THEN 'revoked' WHEN 'signup' THEN 'missing_scope' ELSE 'temporarily_unavailable' END AS access FROM events""")
def _classify_error(spark, sf):
    kind = F.col("event_type")
    message = F.when(kind == "click", "HTTP 429").when(kind == "view", "token expired").when(kind == "error", "Forbidden").otherwise("what")
    category = collab.classify_error(F.lit("odd"), message, kind == "signup")
    return g.read(spark, sf, "events").select("event_id", category.alias("category"), collab.access_status(category).alias("access"))


# --- commits -------------------------------------------------------------------------------------
def commit_lines(spark, sf, clones: int = 1):
    """Each order as a commit record, its parts as changed files; the last clone lists one file more."""
    tasks = max(4 * spark.sparkContext.defaultParallelism, g.line_tasks(spark, sf))
    lines = dealt(g.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), tasks, "l_orderkey")  # keys move; texts are made where they arrive
    files = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")).select(
        "l_orderkey", F.array_sort(F.transform("parts", lambda p: F.concat(F.lit("src/f"), s(p), F.lit(".py")))).alias("files"))
    orders = dealt(g.read(spark, sf, "orders").select(KEY(), "o_custkey", "o_orderdate"), tasks, "o_orderkey")
    orders = orders.join(files, F.col("l_orderkey") == KEY(), "left").withColumn("clone", F.explode(F.sequence(F.lit(1), F.lit(clones))))
    listed = F.concat(F.coalesce("files", F.array().cast("array<string>")), F.when(F.col("clone") > 1, F.array(F.lit("extra.md"))).otherwise(F.array().cast("array<string>")))
    head = F.concat_ws("\x1f", F.substring(F.sha2(s(KEY()), 256), 1, 40), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.concat(F.lit("fix: order "), s(KEY())), F.lit("Ann"), F.lit("ann@example.invalid"))
    return orders.select(
        F.concat_ws("\n", head, F.array_join(listed, "\n")).alias("value"), F.concat(F.lit("Repo "), s(F.col("o_custkey") % 10)).alias("repository"),
        F.concat(F.lit("/r/"), s(F.col("clone"))).alias("root"),
    )


def clone_tasks(spark, sf) -> int:
    """Tasks that fold two clones of every commit: each clone is a row for each of its references there."""
    return 4 * g.line_tasks(spark, sf)


LINE_SETS = "sets AS (SELECT l_orderkey, list_sort(list(DISTINCT 'src/f' || l_partkey || '.py')) AS files FROM lineitem GROUP BY 1)"


@query("parse_commit_log", with_ctes(LINE_SETS, """
SELECT 'git:' || left(sha256(CAST(o_orderkey AS VARCHAR)), 40) AS id, o_orderdate AS occurred_at, 'fix: order ' || o_orderkey AS title, 'repo-' || (o_custkey % 10) AS project_key,
  'Ann <ann@example.invalid> · ' || left(sha256(CAST(o_orderkey AS VARCHAR)), 8) || CASE WHEN files IS NULL THEN '' ELSE ' · ' || len(files) || ' 个文件' END AS summary, CAST(1 + least(24, coalesce(len(files), 0)) AS INT) AS refs
FROM orders LEFT JOIN sets ON l_orderkey = o_orderkey"""))
def _parse_commit_log(spark, sf):
    return cm.parse_commit_log(commit_lines(spark, sf)).select("id", "occurred_at", "title", "project_key", "summary", F.size("source_refs").alias("refs"))


@query("commit_artifacts", with_ctes(LINE_SETS, """
SELECT 'artifact:git:' || left(sha256(CAST(o_orderkey AS VARCHAR)), 40) AS id, 'fix: order ' || o_orderkey || CASE WHEN files IS NULL THEN '' ELSE chr(10) || 'Git 提交记录列出 ' || len(files) || ' 个相关文件：' || array_to_string(files[1:8], '、') || CASE WHEN len(files) > 8 THEN '等' ELSE '' END || '。' END AS result,
  '修复 Repo ' || (o_custkey % 10) || ' 功能' || CASE WHEN files IS NULL THEN '并形成提交' ELSE '，更新 ' || len(files) || ' 个文件' END AS title FROM orders LEFT JOIN sets ON l_orderkey = o_orderkey"""))
def _commit_artifacts(spark, sf):
    return a.commit_artifacts(cm.parse_commit_log(commit_lines(spark, sf))).select("id", "result", "title")


@query("merge_commit_artifacts", with_ctes(LINE_SETS, """
t AS (SELECT *, coalesce(len(files), 0) AS n, 'Repo ' || (o_custkey % 10) AS repo FROM orders LEFT JOIN sets ON l_orderkey = o_orderkey),
named AS (SELECT *, least('修复 ' || repo || CASE WHEN n = 0 THEN ' 功能并形成提交' ELSE ' 功能，更新 ' || n || ' 个文件' END,
  '修复 ' || repo || CASE WHEN n = 0 THEN ' 文档' ELSE ' 功能' END || '，更新 ' || (n + 1) || ' 个文件') AS title FROM t)""", """
SELECT 'artifact:git:' || left(sha256(CAST(o_orderkey AS VARCHAR)), 40) AS id, n + 1 AS files, n + 3 AS refs, 2 AS targets, 1 AS events,
  title || chr(10) || 'Git 提交记录列出 ' || (n + 1) || ' 个相关文件：' || array_to_string(list_concat(coalesce(files, []), ['extra.md'])[1:8], '、') || CASE WHEN n + 1 > 8 THEN '等' ELSE '' END || '。' AS result FROM named"""))
def _merge_commit_artifacts(spark, sf):
    made = a.commit_artifacts(cm.parse_commit_log(commit_lines(spark, sf, clones=2)))
    return a.merge_commit_artifacts(made, ["result"], clone_tasks(spark, sf), crowded=False).heads.select("id", "files", "refs", "targets", "events", "result")


NOTE_SQL = """
SELECT id, '---' || chr(10) || 'tracefold_schema: 1' || chr(10) || 'tracefold_generated: true' || chr(10) || 'cssclasses: [tracefold-artifact-note]' || chr(10)
  || 'aliases: ["成果-' || left(sha256(id), 12) || '"]' || chr(10) || 'tracefold_id: "' || id || '"' || chr(10) || 'tracefold_fingerprint: "' || sha256(id) || '"' || chr(10) || 'tracefold_stale: false' || chr(10)
  || 'date: ' || day || chr(10) || 'project: "' || repo || '"' || chr(10) || 'kind: git-commit' || chr(10) || 'proof: independent' || chr(10) || 'curation: auto' || chr(10)
  || 'source_event_ids: ["' || substr(id, 10) || '"]' || chr(10) || 'target_keys: []' || chr(10) || '---' || chr(10) || chr(10)
  || '<!-- tracefold-generated:start -->' || chr(10) || '# ' || title || chr(10) || chr(10) || '> 独立验证 · Git 提交 · 自动整理' || chr(10) || chr(10)
  || '## 解决的问题' || chr(10) || chr(10) || '未从来源中提取到明确问题描述。' || chr(10) || chr(10) || '## 形成的成果' || chr(10) || chr(10) || replace(result, chr(10), chr(10) || chr(10)) || chr(10) || chr(10)
  || '## 验证结果' || chr(10) || chr(10) || '- Git 历史中存在完整提交 ' || hash || '。' || chr(10) || chr(10) || '## 实际入口' || chr(10) || chr(10) || '- 暂无可直接打开的实际入口。' || chr(10) || chr(10)
  || '## 来源证据' || chr(10) || chr(10) || '- ' || repo || ' ' || left(hash, 8) || '：`/r/1`' || coalesce(chr(10) || array_to_string(list_transform(files, lambda f: '- ' || f || '：`/r/1/' || f || '`'), chr(10)), '') || chr(10) || chr(10)
  || '## 已知限制' || chr(10) || chr(10) || '- 未发现额外限制说明。' || chr(10) || '<!-- tracefold-generated:end -->' || chr(10) || chr(10)
  || '<!-- tracefold-user:start -->' || chr(10) || '## 我的补充' || chr(10) || chr(10) || '<!-- tracefold-user:end -->' || chr(10) AS markdown
FROM (
  SELECT 'artifact:git:' || hash AS id, hash, files, 'Repo ' || (o_custkey % 10) AS repo, strftime(o_orderdate, '%Y-%m-%d') AS day,
    'fix: order ' || o_orderkey || CASE WHEN files IS NULL THEN '' ELSE chr(10) || 'Git 提交记录列出 ' || len(files) || ' 个相关文件：' || array_to_string(files[1:8], '、') || CASE WHEN len(files) > 8 THEN '等' ELSE '' END || '。' END AS result,
    '修复 Repo ' || (o_custkey % 10) || ' 功能' || CASE WHEN files IS NULL THEN '并形成提交' ELSE '，更新 ' || len(files) || ' 个文件' END AS title
  FROM (SELECT *, left(sha256(CAST(o_orderkey AS VARCHAR)), 40) AS hash FROM orders) LEFT JOIN sets ON l_orderkey = o_orderkey)"""


@query("render_artifact_notes", with_ctes(LINE_SETS, NOTE_SQL))
def _render_artifact_notes(spark, sf):
    arts = a.commit_artifacts(cm.parse_commit_log(commit_lines(spark, sf)))
    return mn.render_artifact_notes(arts.withColumn("fingerprint", F.sha2("id", 256))).select("id", "markdown")


def _note(note_id, head: str, block, user, generated="<!-- tracefold-generated:{} -->", mine="<!-- tracefold-user:{} -->"):
    """A managed note around a block and a user's text, as columns."""
    lit = F.lit
    return F.concat(
        lit("---\ntracefold_schema: 1\ntracefold_generated: true\ntracefold_id: \""), note_id, lit('"\n' + head + "---\n\n" + generated.format("start") + "\n"), block,
        lit("\n" + generated.format("end") + "\n\n" + mine.format("start") + "\n"), user, lit("\n" + mine.format("end") + "\n"),
    )


STALE_SQL = "'" + fv.STALE_NOTICE.replace("\n", "' || chr(10) || '") + "'"
MERGE_SQL = f"""
WITH d AS (SELECT doc_id % 8 AS c, 'notes/' || doc_id || '.md' AS path, 'doc:' || doc_id AS id, coalesce(text, '') AS mine, 'lang ' || coalesce(lang, '-') AS block FROM documents),
parts AS (
  SELECT *, '---' || chr(10) || 'tracefold_schema: 1' || chr(10) || 'tracefold_generated: true' || chr(10) || 'tracefold_id: "' || id || '"' || chr(10) AS opening,
    '<!-- tracefold-generated:start -->' || chr(10) AS gs, chr(10) || '<!-- tracefold-generated:end -->' || chr(10) || chr(10) || '<!-- tracefold-user:start -->' || chr(10) || mine || chr(10) || '<!-- tracefold-user:end -->' || chr(10) AS tail,
    chr(10) || '---' || chr(10) || chr(10) AS shut, 'date: 2026-01-02' || chr(10) || 'kind: git-commit' AS keys FROM d
)
SELECT path, CASE c WHEN 1 THEN 'refused' WHEN 2 THEN 'refused' WHEN 4 THEN 'stale' WHEN 5 THEN 'unchanged' WHEN 7 THEN 'foreign' ELSE 'write' END AS action,
  CASE c WHEN 1 THEN '{fv.NOTE_ERRORS["foreign"]}' WHEN 2 THEN '{fv.NOTE_ERRORS["other_id"]}' END AS error,
  CASE c
    WHEN 0 THEN opening || keys || chr(10) || 'my_key: [1]' || chr(10) || 'tracefold_stale: false' || chr(10) || 'aliases: ["mine", "theirs"]' || shut || gs || block || tail
    WHEN 1 THEN replace(opening || keys || shut || gs || 'old' || tail, 'generated:end', 'generated:fin')
    WHEN 2 THEN replace(opening || keys || shut || gs || 'old' || tail, 'tracefold_id: "doc:', 'tracefold_id: "pod:')
    WHEN 3 THEN opening || keys || chr(10) || 'tracefold_stale: false' || chr(10) || 'aliases: ["theirs"]' || shut || gs || block || replace(tail, mine, mine || ' kept')
    WHEN 4 THEN opening || keys || chr(10) || 'tracefold_stale: true' || shut || gs || {STALE_SQL} || chr(10) || chr(10) || 'old' || tail
    WHEN 5 THEN opening || 'date: 2026-01-02' || chr(10) || 'kind: git-commit' || chr(10) || 'tracefold_stale: false' || chr(10) || 'aliases: ["theirs"]' || shut || gs || block || tail
    WHEN 6 THEN opening || 'date: 2026-01-02' || chr(10) || 'kind: git-commit' || chr(10) || 'tracefold_stale: false' || chr(10) || 'aliases: ["theirs"]' || shut || gs || block || replace(tail, mine || chr(10), chr(10))
    ELSE mine END AS markdown
FROM parts"""


@query("merge_artifact_notes", MERGE_SQL)
def _merge_artifact_notes(spark, sf):
    """Each document is a user's text in a stored note; its slot says what became of the note since it was generated."""
    docs = g.read(spark, sf, "documents").select(
        (F.col("doc_id") % 8).alias("c"), F.concat(F.lit("notes/"), s(F.col("doc_id")), F.lit(".md")).alias("path"), F.concat(F.lit("doc:"), s(F.col("doc_id"))).alias("id"),
        F.coalesce("text", F.lit("")).alias("mine"), F.concat(F.lit("lang "), F.coalesce("lang", F.lit("-"))).alias("block"),
    )
    head, c, note_id, mine, old = "date: 2026-01-02\nkind: git-commit\n", F.col("c"), F.col("id"), F.col("mine"), F.lit("old")
    own = 'tracefold_stale: false\naliases: ["theirs"]\n'
    wanted = docs.where(~c.isin(4, 7)).select("path", _note(note_id, head + own, F.col("block"), F.when(c == 5, mine).otherwise("")).alias("markdown"))
    stored = docs.where(c != 6).select("path", F.when(c == 0, _note(note_id, head + 'my_key: [1]\ntracefold_stale: true\naliases: ["mine"]\n', old, mine))
        .when(c == 1, F.replace(_note(note_id, head, old, mine), F.lit("generated:end"), F.lit("generated:fin")))
        .when(c == 2, _note(F.concat(F.lit("pod:"), F.substring("id", 5, 40)), head, old, mine))
        .when(c == 3, _note(note_id, head, old, F.concat(mine, F.lit(" kept")), "%% tracefold-generated:{} %%", "%% tracefold-user:{} %%"))
        .when(c == 4, _note(note_id, head, old, mine)).when(c == 5, _note(note_id, head + own, F.col("block"), mine)).otherwise(mine).alias("markdown"))
    return mn.merge_notes(wanted, stored)


@query("display_title", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '新增 Line 文档，更新 1 个文件' WHEN 1 THEN '整理 Line 知识并形成笔记' ELSE '完成：修 ' || p_name END AS title FROM part""")
def _display_title(spark, sf):
    key = F.col("p_partkey")
    title = F.when(key % 3 == 0, F.concat(F.lit("feat(ui): "), "p_name")).when(key % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("修 "), "p_name", F.lit(" (2)")))
    kind = F.when(key % 3 == 0, "git-commit").when(key % 3 == 1, "knowledge-note").otherwise("completion-report")
    return g.read(spark, sf, "part").select("p_partkey", display_title(title, F.lit("Line"), kind, F.array(F.concat(F.lit("docs/"), s(key), F.lit(".md")))).alias("title"))


@query("rank_scan_candidates", """
WITH c AS (SELECT '/w/U' || user_id AS path, ts AS observed_at, CASE WHEN event_type = 'click' THEN 'reported' ELSE 'cwd' END AS kind FROM events),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY observed_at DESC, CASE kind WHEN 'reported' THEN 0 ELSE 1 END, path) = 1)
SELECT path, observed_at, kind FROM b ORDER BY observed_at DESC, CASE kind WHEN 'reported' THEN 0 ELSE 1 END, path LIMIT 32""")
def _rank_scan_candidates(spark, sf):
    c = g.read(spark, sf, "events").select(F.concat(F.lit("/w/U"), s(F.col("user_id")), F.lit("/")).alias("path"), F.col("ts").alias("observed_at"), F.when(F.col("event_type") == "click", "reported").otherwise("cwd").alias("kind"))
    return cm.rank_scan_candidates(c)


@query("allocate_budget", """
WITH r AS (SELECT o_custkey, o_orderkey, least(16, o_orderkey % 20) AS want FROM orders),
w AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT o_custkey, o_orderkey, CAST(least(want, greatest(0, 64 - before)) AS BIGINT) AS allocated FROM w WHERE least(want, greatest(0, 64 - before)) > 0""")
def _allocate_budget(spark, sf):
    rows = g.read(spark, sf, "orders").select("o_custkey", "o_orderkey", KEY().alias("rank"), (KEY() % 20).alias("children"))
    return cm.allocate_budget(rows, group=["o_custkey"]).select("o_custkey", "o_orderkey", "allocated")


@query("repository_identity", """
SELECT page_id, 'remote:' || sha256(regexp_replace(url, '[?#].*$', '')) AS repository_key, list_filter(string_split_regex(regexp_replace(url, '[?#].*$', ''), '[\\\\/:]'), x -> x <> '')[-1] AS repository_label FROM pages""".replace("x -> x", "lambda x: x"))
def _repository_identity(spark, sf):
    secret = F.regexp_replace("url", "^(https?://)", "$1me:pass@")
    return cm.repository_identity(g.read(spark, sf, "pages").select("page_id", secret.alias("remote"))).select("page_id", "repository_key", "repository_label")


@query("top_repositories", "SELECT c_nationkey AS repository, min(c_custkey) AS rank FROM customer GROUP BY 1 ORDER BY rank, repository LIMIT 12")
def _top_repositories(spark, sf):
    return cm.top_repositories(g.read(spark, sf, "customer").select(F.col("c_nationkey").alias("repository"), F.col("c_custkey").alias("rank")))


# --- ledgers and runs ----------------------------------------------------------------------------
def ledger_documents(spark, sf):
    """One ledger document per customer; outcomes with every fault the reader rejects."""
    o = g.read(spark, sf, "orders")
    status = F.when(KEY() % 11 == 0, "lost").when(KEY() % 2 == 0, "succeeded").otherwise("failed")
    item = F.struct(
        F.when(KEY() % 13 != 0, F.concat(F.lit("o"), s(KEY() % 40))).alias("id"), status.alias("status"),
        F.when(KEY() % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), s(KEY())), F.lit(" "))).alias("source_event_ids"),
        F.when(KEY() % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("wiki/a.md"))).alias("wiki_paths"),
        F.when(KEY() % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated_at"),
        F.array(F.struct(F.lit("created").alias("action"), F.lit("wiki/x.md").alias("path")), F.struct(F.lit("dropped").alias("action"), F.lit("p").alias("path"))).alias("knowledge_changes"),
    )
    docs = o.groupBy(F.col("o_custkey").alias("ledger")).agg(F.array_sort(F.collect_list(F.struct(KEY().alias("k"), item.alias("item")))).alias("items"))
    return spread(docs.select("ledger", F.to_json(F.struct(F.transform("items", lambda x: x["item"]).alias("outcomes"))).alias("value")))


LEDGER_DOCS = """
items AS (SELECT o_custkey AS ledger, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS index, o_orderkey AS k, o_orderdate FROM orders),
judged AS (SELECT *, 'o' || (k % 40) AS id, CASE WHEN k % 13 = 0 THEN 'missing-id' WHEN k % 11 = 0 THEN 'unknown-status' WHEN k % 7 = 0 THEN 'no-sources' WHEN k % 17 = 0 THEN 'missing-updated_at'
    WHEN k % 2 = 0 AND k % 4 = 0 THEN 'succeeded-without-wiki' END AS reason FROM items),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ledger, id, reason IS NULL ORDER BY index) AS n FROM judged)"""


@query("parse_settlement_ledger", with_ctes(LEDGER_DOCS, """
SELECT ledger, id, CASE WHEN k % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status, o_orderdate AS updated_at, 1 AS sources, 1 AS changes FROM ranked WHERE reason IS NULL AND n = 1"""))
def _parse_settlement_ledger(spark, sf):
    rows, _ = lf.parse_settlement_ledger(ledger_documents(spark, sf))
    return rows.select("ledger", "id", "status", "updated_at", F.size("source_event_ids").alias("sources"), F.size("knowledge_changes").alias("changes"))


@query("settlement_ledger_errors", with_ctes(LEDGER_DOCS, """
SELECT ledger, index, coalesce(reason, 'duplicate-id') AS reason FROM ranked WHERE reason IS NOT NULL OR n > 1"""))
def _settlement_ledger_errors(spark, sf):
    return lf.parse_settlement_ledger(ledger_documents(spark, sf))[1]


def run_files(spark, sf):
    o = g.read(spark, sf, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    results = F.array(
        F.struct(F.concat(F.lit("t"), s(KEY())).alias("id"), F.lit("succeeded").alias("status"), F.array(F.lit("w")).alias("wiki_paths")),
        F.struct(F.lit("t0").alias("id"), F.lit("odd").alias("status"), F.array(F.lit("w")).alias("wiki_paths")),
    )
    body = F.struct(
        F.when(KEY() % 9 != 0, F.concat(F.lit("run"), s(KEY()))).alias("run_id"), stamp.alias("started_at"), F.when(KEY() % 5 == 0, "failed").otherwise("running").alias("status"),
        F.when(KEY() % 2 == 0, "automatic").otherwise("x").alias("trigger"), (KEY() % 30 - 5).alias("committed"), F.when(KEY() % 3 == 0, F.array(F.lit(1), F.lit(2))).alias("attempts"), results.alias("topic_results"),
    )
    return spread(o.select(F.concat(F.lit("h/"), s(KEY()), F.lit(".json")).alias("path"), F.when(KEY() % 8 == 1, "not json").otherwise(F.to_json(body)).alias("value")))


@query("parse_run_history", """
SELECT 'run' || o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'running' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'automatic' ELSE 'manual' END AS trigger, o_orderdate AS started_at,
  CAST(greatest(0, o_orderkey % 30 - 5) AS DOUBLE) AS committed_topics, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS attempt_count, 1 AS topics FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 1""")
def _parse_run_history(spark, sf):
    runs, _ = lf.parse_run_history(run_files(spark, sf))
    return runs.select("run_id", "status", "trigger", "started_at", "committed_topics", "attempt_count", F.size("topic_results").alias("topics"))


@query("run_history_errors", """
SELECT 'h/' || o_orderkey || '.json' AS path, CASE WHEN o_orderkey % 8 = 1 THEN 'not-json' ELSE 'missing-run-fields' END AS reason FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 8 = 1""")
def _run_history_errors(spark, sf):
    return lf.parse_run_history(run_files(spark, sf))[1]


@query("parse_legacy_run_log", """
SELECT 'L' || o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'succeeded' ELSE 'unknown' END AS status, o_orderdate - INTERVAL 8 HOUR AS started_at, CAST(o_orderkey % 7 AS DOUBLE) AS committed_topics, 3.0 AS selected_topics FROM orders""")
def _parse_legacy_run_log(spark, sf):
    text = F.concat(
        F.lit("run_id=L"), s(KEY()), F.lit("\nverified_status="), F.when(KEY() % 2 == 0, "succeeded").otherwise("maybe"), F.lit("\nselected_topics=3\n\nbody\n[commit]\n{\"committed\": "), s(KEY() % 7), F.lit("}\n"),
    )
    files = g.read(spark, sf, "orders").select(F.concat(F.lit("raw/codex/automation/"), F.date_format("o_orderdate", "yyyy-MM-dd-HHmmss"), F.lit(".log")).alias("path"), text.alias("value"))
    runs, _ = lf.parse_legacy_run_log(files)
    return runs.select("run_id", "status", "started_at", "committed_topics", "selected_topics")


def status_files(spark, sf):
    e = g.read(spark, sf, "events")
    body = F.struct(
        F.concat(F.lit("r"), s(F.col("event_id"))).alias("run_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"), F.lit("partial").alias("status"),
        g.props_k().alias("candidate_topics"), F.when(F.col("event_id") % 2 == 0, g.props_k() + 1).alias("ready_topics"), (F.col("event_id") % 9 - 2).alias("selected_chars"),
    )
    return e.select(F.to_json(body).alias("value"))


@query("parse_current_status", """
SELECT 'r' || event_id AS run_id, CASE WHEN strftime(ts, '%H:%M') BETWEEN '23:25' AND '23:35' THEN 'automatic' ELSE 'manual' END AS trigger FROM events""")
def _parse_current_status(spark, sf):
    return lf.parse_current_status(status_files(spark, sf))[0].select("run_id", "trigger")


@query("parse_queue_status", """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT 'r' || event_id AS run_id, k AS candidate_topics, CASE WHEN event_id % 2 = 0 THEN k + 1 ELSE k END AS ready_topics, CAST(greatest(0, event_id % 9 - 2) AS DOUBLE) AS selected_chars, k AS remaining_topics FROM e""")
def _parse_queue_status(spark, sf):
    return lf.parse_current_status(status_files(spark, sf))[1].select("run_id", "candidate_topics", "ready_topics", "selected_chars", "remaining_topics")


def _runs(spark, sf):
    e = g.read(spark, sf, "events")
    run = lambda df, origin, per: df.select(
        F.concat(F.lit("u"), s(F.col("user_id"))).alias("owner"), F.concat_ws("-", F.lit(origin), s(F.col("event_id"))).alias("id"),
        F.concat(F.lit("r"), s(F.floor(F.col("event_id") / per))).alias("run_id"), (F.when(F.col("event_id") % 2 == 0, "partial").otherwise("failed")).alias("status"),
        F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(origin).alias("origin"),
    )
    return (run(e.where(kind), n, 50) for kind, n in ((~F.col("event_type").isin("view", "error"), "structured"), (F.col("event_type") == "view", "legacy"), (F.col("event_type") == "error", "current-status")))


RUNS = """
runs AS (SELECT 'u' || user_id AS owner, CASE event_type WHEN 'error' THEN 'current-status' WHEN 'view' THEN 'legacy' ELSE 'structured' END AS origin, event_id, 'r' || (event_id // 50) AS run_id,
  CASE WHEN event_id % 2 = 0 THEN 'partial' ELSE 'failed' END AS status, ts FROM events),
st AS (SELECT * FROM runs WHERE origin = 'structured'), lg AS (SELECT * FROM runs WHERE origin = 'legacy'), cu AS (SELECT * FROM runs WHERE origin = 'current-status')"""


@query("merge_runs", with_ctes(RUNS, """
merged AS (SELECT * FROM st UNION ALL SELECT * FROM lg WHERE (owner, run_id) NOT IN (SELECT (owner, run_id) FROM st)
  UNION ALL SELECT * FROM cu WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.owner = cu.owner AND st.run_id = cu.run_id AND st.status = cu.status AND abs(epoch_us(st.ts) - epoch_us(cu.ts)) < 300000000))""", """
SELECT owner, origin || '-' || event_id AS id FROM merged"""))
def _merge_runs(spark, sf):
    structured, legacy, current = _runs(spark, sf)
    return ld.merge_runs(structured, legacy, current, owner=["owner"]).select("owner", "id")


@query("legacy_before", with_ctes(RUNS, """
edge AS (SELECT owner, min(ts) AS edge FROM st GROUP BY owner)""", """
SELECT lg.owner, 'legacy-' || event_id AS id FROM lg LEFT JOIN edge USING (owner) WHERE edge IS NULL OR ts < edge"""))
def _legacy_before(spark, sf):
    structured, legacy, _ = _runs(spark, sf)
    return ld.legacy_before(structured, legacy, owner=["owner"]).select("owner", "id")


def _results(spark, sf):
    status = F.when(KEY() % 9 == 0, "system").when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", F.when(KEY() % 4 == 0, "failed").otherwise("not-applicable")).otherwise("pending")
    return g.read(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.format_string("t%012d", KEY()).alias("id"), status.alias("status"))


ROLLUP = """
results AS (SELECT o_custkey AS run_id, 't' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'system' WHEN o_orderstatus = 'F' THEN 'succeeded'
  WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'not-applicable' END ELSE 'pending' END AS status FROM orders),
c AS (SELECT run_id, count(*) FILTER (status = 'succeeded') AS committed, count(*) FILTER (status = 'not-applicable') AS skipped, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'system') AS system_pairs, coalesce(array_to_string(list(id ORDER BY id) FILTER (status = 'failed'), '|'), '') AS failures FROM results GROUP BY run_id),
rollup_ AS (SELECT *, CASE WHEN failed > 0 THEN CASE WHEN committed + skipped + system_pairs > 0 THEN 'partial' ELSE 'failed' END WHEN pending > 0 THEN 'partial' ELSE 'succeeded' END AS final_status FROM c)"""


@query("run_rollup", with_ctes(ROLLUP, "SELECT run_id, committed, skipped, pending, failed, system_pairs, final_status, failures FROM rollup_"))
def _run_rollup(spark, sf):
    return ld.run_rollup(_results(spark, sf)).drop("rows")


@query("cycle_rollup", with_ctes(ROLLUP, """
SELECT run_id % 20 AS cycle_id, count(*) AS batches, CASE WHEN bool_or(final_status IN ('failed', 'partial')) THEN 'partial' ELSE 'succeeded' END AS status, CAST(sum(committed) AS BIGINT) AS tokens_used FROM rollup_ GROUP BY 1"""))
def _cycle_rollup(spark, sf):
    batches = ld.run_rollup(_results(spark, sf)).withColumn("cycle_id", F.col("run_id") % 20).withColumn("tokens_used", F.col("committed"))
    return ld.cycle_rollup(batches)


@query("token_usage", "SELECT o_custkey, max(o_orderkey) AS tokens_used FROM orders GROUP BY 1")
def _token_usage(spark, sf):
    line = F.when(KEY() % 2 == 0, F.concat(F.lit('{"usage": {"total_tokens": '), s(KEY()), F.lit("}}"))).otherwise(F.concat(F.lit('{"turn": {"usage": {"total": '), s(KEY()), F.lit("}}}")))
    return ld.token_usage(g.read(spark, sf, "orders").select("o_custkey", line.alias("value")), "o_custkey")


@query("append_run_history", """
WITH a AS (SELECT DISTINCT o_custkey % 300 AS run_id, o_orderstatus AS status, o_orderpriority AS error FROM orders),
t AS (SELECT o_custkey % 300 AS run_id, o_orderstatus AS status, o_orderpriority AS error, max(o_orderkey) AS seq FROM orders GROUP BY ALL)
SELECT run_id, count(*) AS attempts, arg_max(status, seq) AS status FROM t GROUP BY run_id""")
def _append_run_history(spark, sf):
    attempts = g.read(spark, sf, "orders").select(
        (F.col("o_custkey") % 300).alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("error"), F.timestamp_seconds(KEY()).alias("finished_at")
    )
    return ld.append_run_history(attempts, ["status", "error"])[1]


# --- receipts and merges -------------------------------------------------------------------------
RECEIPTS = """
rc AS (SELECT id, CASE k % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'not-applicable' WHEN 2 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN k % 10 = 0 THEN '' ELSE 'why' END AS reason, updated_at + to_days(3) AS updated_at, k FROM ledger WHERE k % 2 = 0),
rev AS (SELECT rc.id, event_id FROM rc JOIN ledger_events ON settlement_id = rc.id WHERE NOT (k % 14 = 0 AND event_id LIKE '%1'))"""


def _receipts(spark, sf, tasks=None):
    ledger, events = g.order_ledger(spark, sf), g.ledger_events(spark, sf)
    key = F.col("k")
    status = F.when(key % 5 == 0, "pending").when(key % 5 == 1, "not-applicable").when(key % 5 == 2, "failed").otherwise("succeeded")
    receipts = ledger.where(key % 2 == 0).select(
        "id", status.alias("status"), F.when(key % 10 == 0, "").otherwise("why").alias("reason"), F.timestamp_micros(F.unix_micros("updated_at") + 3 * 86_400_000_000).alias("updated_at"), "k"
    )
    rev = dealt(events, tasks, "settlement_id").join(receipts.select(F.col("id").alias("settlement_id"), "k"), "settlement_id").where(~((F.col("k") % 14 == 0) & F.col("event_id").endswith("1")))
    return ledger, events, receipts, rev.select(F.col("settlement_id").alias("id"), "event_id")


@query("validate_receipts", with_ctes(LEDGER, RECEIPTS, """
topics AS (SELECT id, k FROM ledger WHERE k % 2 = 0 OR k % 9 = 0)""", """
SELECT topics.id, status, CASE WHEN status IS NULL THEN 'missing-topic' WHEN (SELECT count(*) FROM rev WHERE rev.id = topics.id) <> (SELECT count(*) FROM ledger_events WHERE settlement_id = topics.id) THEN 'source-events-differ' WHEN status = 'failed' THEN 'not-successful' WHEN status IN ('pending', 'not-applicable') AND reason = '' THEN 'reason-required' END AS error FROM topics LEFT JOIN rc USING (id)"""))
def _validate_receipts(spark, sf):
    ledger, events, receipts, rev = _receipts(spark, sf)
    topics = ledger.where((F.col("k") % 2 == 0) | (F.col("k") % 9 == 0)).select("id")
    contract_events = events.join(topics.withColumnRenamed("id", "settlement_id"), "settlement_id", "left_semi").select(F.col("settlement_id").alias("id"), "event_id")
    return ld.validate_receipts(receipts.withColumn("seq", F.col("k")), rev, topics, contract_events).select("id", "status", "error")


NAMED = """
named AS (SELECT CASE WHEN rc.status = 'failed' THEN 'failed:' || rc.id WHEN ledger.status = 'succeeded' AND rc.status <> 'succeeded' THEN rc.status || ':' || rc.id ELSE rc.id END AS new_id, rc.id, rc.status, rc.updated_at FROM rc JOIN ledger USING (id)),
nev AS (SELECT new_id, event_id FROM named JOIN rev USING (id)),
gone AS (SELECT DISTINCT l.id FROM ledger l JOIN ledger_events e ON e.settlement_id = l.id JOIN nev ON nev.event_id = e.event_id AND nev.new_id <> l.id WHERE l.status IN ('pending', 'failed') UNION SELECT new_id FROM named)"""


@query("merge_settlements", with_ctes(LEDGER, RECEIPTS, NAMED, """
SELECT id, status, updated_at FROM ledger WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT new_id, status, updated_at FROM named"""))
def _merge_settlements(spark, sf):
    ledger, events, receipts, rev = _receipts(spark, sf)
    merged, _ = ld.merge_settlements(ledger, events, receipts, rev)
    return merged.select(F.regexp_replace("id", ":[0-9a-f]{16}$", "").alias("id"), "status", "updated_at")


@query("advance_processed", with_ctes(LEDGER, RECEIPTS, """
before AS (SELECT DISTINCT event_id FROM ledger_events WHERE event_id LIKE '%2' OR event_id LIKE '%3')""", """
SELECT event_id FROM (SELECT event_id FROM before UNION SELECT event_id FROM rev JOIN rc USING (id) WHERE status IN ('succeeded', 'not-applicable'))
WHERE event_id NOT IN (SELECT event_id FROM rev JOIN rc USING (id) WHERE status IN ('pending', 'failed'))"""))
def _advance_processed(spark, sf):
    tasks = g.line_tasks(spark, sf)
    _, events, receipts, rev = _receipts(spark, sf, tasks)
    before = events.where(F.col("event_id").endswith("2") | F.col("event_id").endswith("3")).select("event_id").distinct()
    return ld.advance_processed(before, receipts, rev, tasks)


@query("same_event_sets", with_ctes(ART, LEDGER, """
a AS (SELECT id, list_sort(list(DISTINCT event_id)) AS l FROM art_events GROUP BY id), b AS (SELECT 'a' || lpad(CAST(k AS VARCHAR), 12, '0') AS id, list_sort(list(DISTINCT event_id)) AS l FROM ledger JOIN ledger_events ON settlement_id = id GROUP BY k)""", """
SELECT coalesce(a.id, b.id) AS id, coalesce(a.l = b.l, false) AS same FROM a FULL JOIN b ON a.id = b.id"""))
def _same_event_sets(spark, sf):
    ledger = g.order_ledger(spark, sf).select(F.col("id").alias("settlement_id"), F.format_string("a%012d", "k").alias("id"))
    other = g.ledger_events(spark, sf).join(ledger, "settlement_id").select("id", "event_id")
    return ld.same_event_sets(g.line_events(spark, sf), other, "id", g.line_tasks(spark, sf))


@query("overlaps_and_unions", """
WITH l AS (SELECT l_orderkey, list(DISTINCT l_partkey % 20) AS a, list(DISTINCT l_suppkey % 20) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_has_any(a, b) AS overlap, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS united FROM l""")
def _overlaps_and_unions(spark, sf):
    rows = g.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 20).alias("a"), F.collect_set(F.col("l_suppkey") % 20).alias("b"))
    return rows.select("l_orderkey", F.arrays_overlap("a", "b").alias("overlap"), F.array_join(F.transform(F.array_sort(F.array_union("a", "b")), lambda x: x.cast("string")), "|").alias("united"))


@query("missing_scopes", """
WITH e AS (SELECT r_name AS owner, module FROM region, (VALUES ('tasks'), ('base'), ('messages')) m(module) WHERE NOT (r_regionkey = 1 AND module = 'base')),
s(module, scope) AS (VALUES ('tasks', 'task:task:read'), ('base', 'search:docs:read'), ('base', 'base:table:read'), ('base', 'base:view:read'), ('base', 'base:record:read'), ('messages', 'im:chat:read'), ('messages', 'im:message:readonly')),
granted AS (SELECT r_name AS owner, scope FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (0, 'task:task:read'), (1, 'im:chat:read'), (2, 'base:view:read')) g(m, scope) WHERE n_nationkey % 7 = m)
SELECT DISTINCT owner, scope FROM e JOIN s USING (module) EXCEPT SELECT owner, scope FROM granted""")
def _missing_scopes(spark, sf):
    region, nation = g.read(spark, sf, "region"), g.read(spark, sf, "nation")
    enabled = region.select("r_regionkey", F.col("r_name").alias("owner"), F.explode(F.array(F.lit("tasks"), F.lit("base"), F.lit("messages"))).alias("module"))
    enabled = enabled.where(~((F.col("r_regionkey") == 1) & (F.col("module") == "base")))
    scope = F.when(F.col("n_nationkey") % 7 == 0, "task:task:read").when(F.col("n_nationkey") % 7 == 1, "im:chat:read").when(F.col("n_nationkey") % 7 == 2, "base:view:read")
    granted = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("owner"), scope.alias("scope")).where(F.col("scope").isNotNull())
    return ms.missing_scopes(ms.required_scopes(enabled, ms.module_scopes(spark)), granted)


# --- sinks ---------------------------------------------------------------------------------------
@query("append_new", with_ctes(REC, """
batch AS (SELECT *, CASE WHEN turn % 7 = 5 THEN '' ELSE content END AS c, 'c-' || conv_id || '-' || (turn // 2) AS eid FROM rec),
known AS (SELECT DISTINCT eid FROM batch WHERE conv_id % 4 = 0),
good AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY ingest_seq) AS n FROM batch WHERE trim(c) <> '')""", """
SELECT date, count(*) FILTER (v = 'accepted') AS accepted, count(*) FILTER (v = 'duplicate') AS duplicates, count(*) FILTER (v = 'rejected') AS rejected, count(*) FILTER (v <> 'rejected') AS acknowledged FROM (
  SELECT date, CASE WHEN n = 1 AND eid NOT IN (SELECT eid FROM known) THEN 'accepted' ELSE 'duplicate' END AS v FROM good UNION ALL SELECT date, 'rejected' FROM batch WHERE trim(c) = '') GROUP BY date"""))
def _append_new(spark, sf):
    r = g.conversations_as_records(spark, sf)
    turn, conv = F.substring_index("event_id", "-", -1).cast("long"), F.substring("session_id", 2, 12).cast("long")
    batch = r.withColumn("content", F.when(turn % 7 == 5, "").otherwise(F.col("content"))).withColumn("event_id", F.concat_ws("-", F.lit("c"), s(conv), s(F.floor(turn / 2))))
    return k.append_counts(k.append_plan(batch, batch.where(conv % 4 == 0)), ["date"])


@query("append_resources", with_ctes(RES, "SELECT event_id, date FROM res WHERE o_orderkey % 3 <> 0"))
def _append_resources(spark, sf):
    rows = g.orders_as_resources(spark, sf)
    return k.append_resources(rows.unionByName(rows), rows.where(F.col("ingest_seq") % 3 == 0)).select("event_id", "date").distinct()


@query("daily_source_pages", with_ctes(REC, PAIRS, """
b AS (SELECT 'raw/' || CASE source WHEN 'chatgpt_web' THEN 'chatgpt' ELSE 'codex' END || '/daily/' || date || '.md' AS daily_path, id, source, date,
  '<!-- ' || CASE source WHEN 'chatgpt_web' THEN 'chatgpt-qna' ELSE 'codex-qna' END || ':prompt=' || prompt_id || ';stop=' || stop_id || ' -->' AS marker, CASE source WHEN 'chatgpt_web' THEN '未命名对话' ELSE cwd END AS head,
  starts_with(prompt_content, 'Automation ID:') OR starts_with(prompt_content, '[no-obsidian]') AS automated, prompt_content, stop_content FROM pairs)""", """
SELECT daily_path, id, CASE WHEN automated THEN '## 自动化记录：例行自动化' || chr(10) || marker || chr(10) || chr(10) || '### 结果' || chr(10) || '> ' || replace(substr(stop_content, 1, 2000), chr(10), chr(10) || '> ') || chr(10)
  ELSE '## ' || head || chr(10) || marker || chr(10) || chr(10) || '### 问题' || chr(10) || '> ' || replace(prompt_content, chr(10), chr(10) || '> ') || chr(10) || chr(10) || '### 回答' || chr(10) || '> ' || replace(stop_content, chr(10), chr(10) || '> ') || chr(10) END AS block FROM b
UNION ALL SELECT DISTINCT daily_path, '', '# ' || CASE source WHEN 'chatgpt_web' THEN 'ChatGPT' ELSE 'Codex' END || ' 原始问答 - ' || date || chr(10) FROM b"""))
def _daily_source_pages(spark, sf):
    return k.daily_source_pages(u.build_pairs(g.conversations_as_records(spark, sf))).select("daily_path", "id", "block")


@query("daily_artifact_index", with_ctes(ART, """
SELECT local_date, project_label, id, '- ' || title || ' · ' || CASE proof WHEN 'independent' THEN '独立验证' WHEN 'target-present' THEN '目标存在' ELSE '完成报告' END || chr(10) || '  - ' || result AS line FROM art
UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), NULL, NULL, '当天没有当前快照中的成果条目。' FROM orders WHERE extract(day FROM o_orderdate) = 2"""))
def _daily_artifact_index(spark, sf):
    managed = g.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("local_date")).where(F.dayofmonth("local_date") == 2)
    return a.daily_artifact_index(g.order_artifacts(spark, sf), managed).select("local_date", "project_label", "id", "line")


@query("sync_managed", """
WITH cur AS (SELECT 'p' || o_orderkey AS path, 'i' || o_orderkey AS id, sha256(o_orderstatus) AS fp FROM orders WHERE o_orderkey % 5 <> 0),
man AS (SELECT 'p' || o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE 'i' || o_orderkey END AS id, sha256(CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END) AS fp FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(cur.path, man.path) AS path, CASE WHEN cur.path IS NULL THEN 'stale' WHEN man.path IS NULL THEN 'write' WHEN cur.id <> man.id THEN 'conflict' WHEN cur.fp = man.fp THEN 'unchanged' ELSE 'write' END AS action FROM cur FULL JOIN man ON cur.path = man.path""")
def _sync_managed(spark, sf):
    o = g.read(spark, sf, "orders")
    row = lambda df, who, what: df.select(F.concat(F.lit("p"), s(KEY())).alias("path"), who.alias("id"), F.sha2(what, 256).alias("fingerprint"))
    own = F.concat(F.lit("i"), s(KEY()))
    current = row(o.where(KEY() % 5 != 0), own, F.col("o_orderstatus"))
    managed = row(o.where(KEY() % 4 != 0), F.when(KEY() % 11 == 0, "other").otherwise(own), F.when(KEY() % 3 == 0, "F").otherwise(F.col("o_orderstatus")))
    return a.sync_managed(current, managed).select("path", "action")


@query("assign_unique_names", """
SELECT p_partkey AS id, CASE WHEN n > 99 THEN NULL WHEN n = 1 THEN p_name ELSE p_name || '（' || n || '）' END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def _assign_unique_names(spark, sf):
    parts = g.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("2024-01-01").cast("date").alias("local_date"))
    return a.assign_unique_names(parts).select("id", "name")


@query("check_write_intent", """
WITH u AS (SELECT 'p' || o_orderkey AS path, CASE o_orderkey % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' ELSE 'odd' END AS action, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN sha256('old' || o_orderkey) ELSE sha256('x') END AS expected, sha256('new' || o_orderkey) AS content_hash, o_orderkey AS k FROM orders),
c AS (SELECT 'p' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN sha256('new' || o_orderkey) ELSE sha256('old' || o_orderkey) END AS h FROM orders WHERE o_orderkey % 2 = 1)
SELECT path, action, CASE WHEN action = 'odd' THEN 'unknown-action' WHEN action = 'created' AND h IS NOT NULL AND h <> content_hash THEN 'created-but-exists' WHEN action = 'updated' AND h IS NULL THEN 'updated-but-missing'
  WHEN action = 'updated' AND expected = '' THEN 'expected-hash-required' WHEN expected <> '' AND NOT coalesce(h = expected OR h = content_hash, false) THEN 'changed-meanwhile' END AS error FROM u LEFT JOIN c USING (path)""")
def _check_write_intent(spark, sf):
    o = g.read(spark, sf, "orders")
    sha = lambda word: F.sha2(F.concat(F.lit(word), s(KEY())), 256)
    path = F.concat(F.lit("p"), s(KEY())).alias("path")
    updates = o.select(
        path, F.when(KEY() % 3 == 0, "created").when(KEY() % 3 == 1, "updated").otherwise("odd").alias("action"),
        F.when(KEY() % 4 == 0, "").when(KEY() % 4 == 1, sha("old")).otherwise(F.sha2(F.lit("x"), 256)).alias("expected"), sha("new").alias("content_hash"),
    )
    current = o.where(KEY() % 2 == 1).select(path, F.when(KEY() % 7 == 0, sha("new")).otherwise(sha("old")).alias("content_hash"))
    return ld.check_write_intent(updates, current)


@query("pending_backlog", with_ctes(RES, """
SELECT count(*) AS pending FROM res WHERE o_orderkey % 4 <> 0"""))
def _pending_backlog(spark, sf):
    rows = g.orders_as_resources(spark, sf)
    return ms.pending_backlog(rows, rows.where(F.col("ingest_seq") % 4 == 0))


# --- messages, health, dates ---------------------------------------------------------------------
@query("select_messages", """
WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN '好的' WHEN role = 'assistant' AND conv_id % 2 = 0 THEN text || ' issue' ELSE replace(replace(replace(replace(text, 'issue', ''), 'todo', ''), 'commit', ''), 'blocked', '') END AS t,
    CASE WHEN conv_id % 9 = 0 THEN 'p2p' ELSE 'group' END AS chat, CASE WHEN role = 'system' THEN 'bot' ELSE 'user' END AS sender, conv_id % 3 = 0 AND turn = 2 AS mention FROM conversations WHERE conv_id % 9 = 0 OR conv_id % 5 <> 4),
s AS (SELECT *, chat <> 'p2p' AND sender <> 'bot' AND trim(t) <> '' AS safe, t = '好的' AS noise, regexp_matches(t, 'commit|issue|todo|blocked', 'i') AS subst FROM m),
k AS (SELECT *, safe AND NOT noise AND (mention OR subst) AS kept FROM s),
n AS (SELECT *, lag(kept AND mention) OVER w AS b, lead(kept AND mention) OVER w AS a FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, NOT kept AS context_only FROM n WHERE kept OR (safe AND (coalesce(a, false) OR coalesce(b, false)))""")
def _select_messages(spark, sf):
    turn, conv, text = F.col("turn"), F.col("conv_id"), F.col("text")
    bare = text
    for word in ("issue", "todo", "commit", "blocked"):
        bare = F.replace(bare, F.lit(word), F.lit(""))
    rows = g.read(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(turn % 5 == 3, "好的").when((F.col("role") == "assistant") & (conv % 2 == 0), F.concat(text, F.lit(" issue"))).otherwise(bare).alias("text"),
        F.when(conv % 9 == 0, "p2p").otherwise("group").alias("chat_type"), F.when(F.col("role") == "system", "bot").otherwise("user").alias("sender_type"), F.lit("text").alias("msg_type"),
        F.when((conv % 3 == 0) & (turn == 2), F.array(F.lit("me"))).otherwise(F.array().cast("array<string>")).alias("mentions"), (conv % 5 != 4).alias("selected_group"),
    )
    return ms.select_messages(rows, "me", keys=("conv_id",), order=("turn",)).select("conv_id", "turn", "context_only")


@query("source_health", """
WITH l AS (SELECT 'u' || user_id AS source, max(ts) AS last_event_at FROM events GROUP BY 1), c AS (SELECT 'u' || c_custkey AS source, c_custkey % 5 <> 0 AS configured, c_custkey % 7 <> 0 AS supported, CASE WHEN c_custkey % 11 = 0 THEN 'down' END AS error FROM customer)
SELECT source, last_event_at, coalesce(TIMESTAMP '2024-01-31 06:00:00' - last_event_at > INTERVAL 36 HOUR, true) AS stale, CASE WHEN NOT configured OR NOT supported OR error IS NOT NULL THEN 'unavailable'
  WHEN last_event_at IS NULL OR TIMESTAMP '2024-01-31 06:00:00' - last_event_at > INTERVAL 36 HOUR THEN 'starting' ELSE 'ready' END AS state FROM c LEFT JOIN l USING (source)""")
def _source_health(spark, sf):
    ck = F.col("c_custkey")
    config = g.read(spark, sf, "customer").select(F.concat(F.lit("u"), s(ck)).alias("source"), (ck % 5 != 0).alias("configured"), (ck % 7 != 0).alias("supported"), F.when(ck % 11 == 0, "down").alias("error"))
    events = g.read(spark, sf, "events").select(F.concat(F.lit("u"), s(F.col("user_id"))).alias("source"), F.col("ts").alias("captured_at"))
    return ms.source_health(events, config, F.lit("2024-01-31 06:00:00").cast("timestamp")).select("source", "last_event_at", "stale", "state")


@query("calendar_dates", """
SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS week_end,
  CAST(date_trunc('week', date_trunc('month', o_orderdate)) AS DATE) AS grid_start, CAST(date_trunc('week', last_day(o_orderdate)) + INTERVAL 6 DAY AS DATE) AS grid_end, CAST(o_orderdate + INTERVAL 7 DAY AS DATE) AS next_week,
  CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS last_month, strftime(o_orderdate, '%Y-%m-%d') AS local_date, o_orderkey % 3 = 0 AS strict FROM orders""")
def _calendar_dates(spark, sf):
    day = F.to_date("o_orderdate")
    text = F.when(KEY() % 3 == 0, day.cast("string")).when(KEY() % 3 == 1, "2024-02-31").otherwise("2024-1-2")
    return g.read(spark, sf, "orders").select(
        "o_orderkey", dates.week_start(day).alias("week_start"), dates.week_end(day).alias("week_end"), dates.month_grid_start(day).alias("grid_start"),
        dates.month_grid_end(day).alias("grid_end"), dates.shift_range(day, "week", 1).alias("next_week"), dates.shift_month(day, -1).alias("last_month"),
        dates.local_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("local_date"), dates.is_calendar_date(text).alias("strict"),
    )


@query("stable_id", "SELECT doc_id, 'doc:' || left(sha256(coalesce(lang, '') || chr(0) || text), 16) AS id FROM documents")
def _stable_id(spark, sf):
    return g.read(spark, sf, "documents").select("doc_id", ids.stable_id("doc:", 16, F.col("lang"), F.col("text")).alias("id"))


@query("title_index_sessions", with_ctes(ACT, TITLES, "SELECT count(*) AS titles FROM titles"))
def _title_index_sessions(spark, sf):
    return g.labels_as_index(spark, sf).agg(F.count(F.lit(1)).alias("titles"))
