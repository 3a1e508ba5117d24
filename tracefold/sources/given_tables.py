"""Adapters from the driver's star-schema and text tables to this library's shapes.

They only rename, cast and derive columns; every row of the table is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators.sequence import ordinal_block, running_total

LINES_A_TASK = 250_000
EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; zone-less timestamps become instants, which streaming and arithmetic need."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for field in df.schema:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _ref(kind: str, label: str, path: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), F.lit(label).alias("label"), path.alias("path"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("string").alias("excerpt"),
    )


def events_as_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream events as one owner-keyed activity table with all nine kinds."""
    return activity_columns(read(spark, sf_dir, "events"))


def activity_columns(events: DataFrame) -> DataFrame:
    k = F.col("k")
    kind = (
        F.when(F.col("event_type") == "signup", "task_started")
        .when(F.col("event_type") == "click", "task_progress")
        .when(F.col("event_type") == "purchase", "task_completed")
        .when(F.col("event_type") == "error", "task_blocked")
        .when(k % 5 == 0, "research_activity")
        .when(k % 5 == 1, "output_created")
        .when(k % 5 == 2, "knowledge_created")
        .when(k % 5 == 3, "knowledge_updated")
        .otherwise("knowledge_reused")
    )
    rows = events.withColumn("k", props_k()).withColumn("kind", kind)
    project = F.when(F.col("user_id") % 10 == 0, "unassigned").otherwise(F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")))
    task = F.col("kind").startswith("task_")
    note = F.concat(F.lit("wiki/"), project, F.lit("/n"), (k % 20).cast("string"), F.lit(".md"))
    knowledge = F.col("kind").isin("knowledge_created", "knowledge_updated")
    own_source = F.when(F.col("event_id") % 3 == 0, "git").when(F.col("event_id") % 3 == 1, "codex").otherwise("chatgpt")
    refs = F.filter(
        F.array(
            F.when(knowledge, _ref("wiki", "知识笔记", note)),
            F.when(F.col("event_id") % 3 == 0, _ref("git", "commit", F.concat(F.lit("repo/"), project)))
            .when(F.col("event_id") % 3 == 1, _ref("codex", "来源页", F.concat(F.lit("raw/"), own_source))),
        ),
        lambda r: r.isNotNull(),
    )
    return rows.select(
        F.format_string("e%012d", "event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner"),
        "kind", F.col("ts").alias("occurred_at"),
        F.timestamp_micros(F.unix_micros("ts") + (k % 7) * 60_000_000).alias("observed_at"),
        F.to_date("ts").alias("local_date"), F.lit("source").alias("time_basis"),
        F.concat(F.lit("Task "), (k % 5).cast("string"), F.when(F.col("event_id") % 3 == 0, " (2)").otherwise("")).alias("title"),
        F.concat(F.lit("issue #"), (k % 9).cast("string"), F.lit(" of "), project).alias("summary"), project.alias("project_key"),
        F.concat(F.upper(project), F.lit("-"), own_source).alias("project_label"),
        F.when(task, F.concat_ws(":", project, F.col("user_id").cast("string"), (k % 5).cast("string"))).alias("task_key"),
        F.when(F.col("kind") == "output_created", F.concat(F.lit("o:"), project, F.lit(":"), (k % 25).cast("string")))
        .when(F.col("kind") == "knowledge_reused", F.concat(F.lit("l:"), project, F.lit(":"), (k % 10).cast("string"))).alias("object_key"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.concat(F.lit("t"), (F.col("event_id") % 50).cast("string")).alias("turn_id"),
        F.when(F.col("event_id") % 4 == 0, "verified").when(F.col("event_id") % 4 == 1, "observed")
        .when(F.col("event_id") % 4 == 2, "reported").otherwise("inferred").alias("confidence"),
        F.lit("given").alias("evidence"), refs.alias("source_refs"),
    )


def conversations_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as captured records; every few conversations carry the marks the rules look for."""
    rows = read(spark, sf_dir, "conversations").where(F.col("role") != "system")
    rows = running_total(
        rows, ["conv_id"], ["turn"], ordinal_block(F.col("turn")), (F.col("role") == "user").cast("int"), "ask"
    )
    return record_columns(rows)


def record_columns(rows: DataFrame) -> DataFrame:
    conv, user, ask = F.col("conv_id"), F.col("role") == "user", F.col("ask")
    prefix = (
        F.when(user & (conv % 11 == 5), "Automation ID: nightly\n")
        .when(user & (conv % 19 == 4), "[no-obsidian] ")
        .when(user & (conv % 13 == 6) & (ask >= 2), "新任务：")
        .when(user & (conv % 17 == 3), F.concat(F.lit("issue #"), (conv % 23).cast("string"), F.lit(" ")))
        .when(~user & (conv % 11 == 5) & (conv % 2 == 0), "队列为空\n")
        .when(~user & (conv % 11 == 5), "message_id 42\n")
        .when(~user & (conv % 3 == 0), "已完成：收尾\n测试全部通过\n")
        .when(~user & (conv % 7 == 2), "无法完成：缺少权限\n")
        .otherwise("")
    )
    short = user & (conv % 5 == 1) & (ask >= 3)
    at = F.timestamp_micros(
        F.unix_micros(F.lit(EPOCH).cast("timestamp")) + conv * 3_600_000_000 + F.col("turn") * 60_000_000
    )
    folder = F.concat(F.lit("proj"), (conv % 5).cast("string"))
    return rows.select(
        F.lit(1).alias("schema_version"), F.concat_ws("-", F.lit("c"), conv.cast("string"), F.col("turn").cast("string")).alias("event_id"),
        at.alias("captured_at"), F.to_date(at).alias("date"),
        F.when(conv % 4 == 3, "chatgpt_web").otherwise("codex").alias("source"),
        F.when(user, "UserPromptSubmit").otherwise("Stop").alias("event"),
        F.concat(F.lit("s"), conv.cast("string")).alias("session_id"), F.concat(F.lit("t"), ask.cast("string")).alias("turn_id"),
        F.when(conv % 7 == 0, F.concat(F.lit("/home/dev/.codex/worktrees/w1/"), folder)).otherwise(F.concat(F.lit("/home/dev/"), folder)).alias("cwd"),
        F.when(short, "继续").otherwise(F.concat(prefix, F.col("text"))).alias("content"),
        *[F.lit(None).cast("string").alias(n) for n in ("conversation_id", "title", "url")],
        F.lit(None).cast("timestamp").alias("occurred_at"), F.lit(None).cast("timestamp").alias("updated_at"),
        *[F.lit(None).cast("string").alias(n) for n in (
            "resource_type", "resource_id", "resource_version", "resource_status", "resource_url", "project_hint",
            "access_status", "identity_scope", "activity_kind")],
        F.lit(False).alias("untrusted_source"),
        F.concat(F.lit("raw/"), F.to_date(at).cast("string"), F.lit(".jsonl")).alias("source_path"),
        (F.col("turn") + 1).cast("int").alias("source_line"), (conv * 1_000_000 + F.col("turn")).alias("ingest_seq"),
    )


def labels_as_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as indexed sessions; every third title is a numbered copy."""
    doc = F.col("doc_id")
    return read(spark, sf_dir, "labels").select(
        F.concat(F.lit("s"), doc.cast("string")).alias("session_id"),
        F.concat(
            F.lit("Topic "), (doc % 12).cast("string"),
            F.when(doc % 3 == 0, F.concat(F.lit(" ("), (2 + doc % 4).cast("string"), F.lit(")"))).otherwise(""),
        ).alias("title"),
    )


def orders_as_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as collaboration records: 500 resources, one version per order date."""
    key = F.col("o_orderkey")
    module = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "tasks").when(F.col("o_orderpriority") == "2-HIGH", "base")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "documents").when(F.col("o_orderpriority") == "5-LOW", "approvals")
        .otherwise("messages")
    )
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "blocked").otherwise("open")
    day = F.to_date("o_orderdate")
    resource = F.concat(F.lit("r"), (F.col("o_custkey") % 500).cast("string"))
    none = F.lit(None).cast("string")
    return read(spark, sf_dir, "orders").select(
        F.lit(1).alias("schema_version"), F.format_string("f%012d", key).alias("event_id"), F.col("o_orderdate").alias("captured_at"),
        day.alias("date"), F.lit("feishu").alias("source"), F.lit("ResourceUpdate").alias("event"),
        F.concat_ws(":", F.lit("feishu"), module, resource).alias("session_id"), F.concat(F.lit("v"), key.cast("string")).alias("turn_id"),
        F.lit("").alias("cwd"), F.concat(F.lit("Order "), key.cast("string"), F.lit(" is "), status).alias("content"),
        none.alias("conversation_id"), F.concat(F.lit("Order "), key.cast("string")).alias("title"), none.alias("url"),
        F.col("o_orderdate").alias("occurred_at"), F.col("o_orderdate").alias("updated_at"), module.alias("resource_type"),
        resource.alias("resource_id"), day.cast("string").alias("resource_version"), status.alias("resource_status"),
        F.when(key % 2 == 0, F.concat(F.lit("https://records.example/"), key.cast("string"))).alias("resource_url"),
        F.concat(F.lit("Team "), (F.col("o_custkey") % 7).cast("string")).alias("project_hint"),
        F.when(key % 10 == 0, "revoked").otherwise("available").alias("access_status"), F.lit("scope").alias("identity_scope"),
        none.alias("activity_kind"), F.lit(True).alias("untrusted_source"), F.lit("raw/orders").alias("source_path"),
        F.lit(1).alias("source_line"), key.alias("ingest_seq"),
    )


def order_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifact headers: one per order, in (month, customer group) buckets."""
    key = F.col("o_orderkey")
    titles = F.concat(F.lit("fix: "), F.lower(F.substring("o_orderpriority", 3, 20)), F.lit(" item "), (key % 40).cast("string"))
    return read(spark, sf_dir, "orders").select(
        F.format_string("a%012d", key).alias("id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("local_date"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + (key % 1440) * 60_000_000).alias("occurred_at"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 10).cast("string")).alias("project_key"),
        F.concat(F.lit("Project "), (F.col("o_custkey") % 10).cast("string")).alias("project_label"),
        F.when(key % 5 == 0, F.concat(F.lit("task:"), (F.col("o_custkey") % 50).cast("string"))).alias("task_key"),
        F.when(key % 4 == 0, "git-commit").when(key % 4 == 1, "knowledge-note").when(key % 4 == 2, "file-deliverable")
        .otherwise("completion-report").alias("kind"),
        titles.alias("title"), F.when(key % 6 == 0, F.concat(F.lit("Problem "), (key % 30).cast("string"))).alias("problem"),
        F.concat(F.lit("Result "), (key % 100).cast("string"), F.when(key % 9 == 0, F.concat(F.lit(" issue #"), (key % 8).cast("string"))).otherwise("")).alias("result"),
        F.when(key % 4 == 0, "independent").when(key % 4 == 2, "target-present").otherwise("report-only").alias("proof"),
    )


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge (artifact id, changed file)."""
    return read(spark, sf_dir, "lineitem").select(
        F.format_string("a%012d", "l_orderkey").alias("id"), F.concat(F.lit("src/f"), (F.col("l_partkey") % 60).cast("string"), F.lit(".py")).alias("file"),
    ).distinct()


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks among which lines are dealt, so that what one of them holds does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), read(spark, sf_dir, "lineitem").count() // LINES_A_TASK + 1)


def _line_event() -> Column:
    return F.concat(F.lit("x"), F.col("line").cast("string")).alias("event_id")


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge (artifact id, source event id)."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")).repartition(line_tasks(spark, sf_dir), "l_orderkey").distinct()
    return lines.select(F.format_string("a%012d", "l_orderkey").alias("id"), _line_event())


def _settlement_id(key: Column) -> Column:
    return F.when(key % 21 == 0, F.format_string("outcome:backfill:%012d", key)).otherwise(F.format_string("outcome:%012d", key))


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement headers: one per order."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        _settlement_id(key).alias("id"),
        F.when(key % 4 == 0, "failed").when(key % 4 == 1, "pending").when(key % 4 == 2, "succeeded").otherwise("not-applicable").alias("status"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + 86_400_000_000).alias("updated_at"),
        F.when(key % 2 == 0, "durable-output").otherwise("knowledge-topic").alias("category"),
        F.concat(F.lit("Settled "), key.cast("string")).alias("title"), key.alias("k"),
    )


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge (settlement id, source event id): the lines of the settlement's order, and of every fourth one's next."""
    orders = F.when(F.col("k") % 4 == 0, F.array("k", F.col("k") + 1)).otherwise(F.array("k"))
    spans = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.explode(orders).alias("l_orderkey"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    met = spans.join(lines, "l_orderkey").select("k", "line").repartition(line_tasks(spark, sf_dir), "k").distinct()  # as numbers, before they become longer names
    return met.select(_settlement_id(F.col("k")).alias("settlement_id"), _line_event())


def documents_as_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    at = F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp")) + doc * 3_600_000_000)
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("wiki/"), "source", F.lit("/d"), doc.cast("string"), F.lit(".md")).alias("path"), "doc_id",
        F.col("text").alias("content"), at.alias("created_at"),
        F.timestamp_micros(F.unix_micros(at) + (doc % 3) * 86_400_000_000).alias("modified_at"), "source", "lang",
    )
