"""Readers of capture logs, session indexes and producer session logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions import ids
from tracefold.functions.dates import is_calendar_date, local_date, local_day, parse_iso
from tracefold.functions.text import redact, trim_ws
from tracefold.operators.common import evaluate_once
from tracefold.operators.sequence import ordinal_block, previous_value, previous_values, running_total
from tracefold.session import cut_lineage
from tracefold.schemas import CAPTURE_OPTIONAL, CAPTURE_REQUIRED


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and 1-based line number.

    Files are split like any other text input; a line's number is its place inside its split plus the
    lines of the splits before it, so one huge daily file does not become one task.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    numbered = running_total(raw, ["source_path"], ["_pos"], F.col("_start"), F.lit(1), "source_line")
    return numbered.select("value", "source_path", F.col("source_line").cast("int").alias("source_line"))


def variant_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def json_string(v: Column, path: str) -> Column:
    """A field's text only where the field really is a string; numbers are not coerced."""
    return F.when(F.schema_of_variant(variant_at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def json_number(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(variant_at(v, path))
    return F.when(kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, "double"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def parse_capture_lines(lines: DataFrame, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Typed records and rejected lines, from rows (value, source_path, source_line)."""
    rows = lines.where(trim_ws(F.col("value")) != "").withColumn("v", F.try_parse_json("value"))
    v = F.col("v")
    typed = evaluate_once(
        rows, ["source_path", "source_line"], is_object(v).alias("_object"),
        *[json_string(v, f"$.{n}").alias(n) for n in [*CAPTURE_REQUIRED, *CAPTURE_OPTIONAL, "source", "date", "cwd", "activity_kind"]],
        json_number(v, "$.schema_version").cast("int").alias("schema_version"),
        F.coalesce(F.try_variant_get(v, "$.untrusted_source", "boolean"), F.lit(False)).alias("untrusted_source"),
        F.col("v").isNull().alias("_unparsed"),
    )
    reason = F.when(F.col("_unparsed"), "not-json").when(~F.col("_object"), "not-object")
    for name in CAPTURE_REQUIRED:
        reason = reason.when(F.col(name).isNull(), f"missing-{name}")
    reason = reason.when(parse_iso(F.col("captured_at")).isNull(), "bad-captured_at")
    judged = typed.withColumn("reason", reason)  # cheap null tests over columns evaluated once
    rejects = judged.where(F.col("reason").isNotNull()).select("source_path", "source_line", "reason")
    # A web capture carries a conversation instead of a session; callers that accept it fill session_id first.
    good = judged.where(F.col("reason").isNull())
    day = F.when(is_calendar_date(F.col("date")), F.col("date")).otherwise(local_date(F.col("captured_at"), tz))
    records = good.select(
        F.coalesce("schema_version", F.lit(1)).alias("schema_version"), "event_id",
        parse_iso(F.col("captured_at")).alias("captured_at"), F.try_to_date(day).alias("date"),
        F.coalesce("source", F.lit("codex")).alias("source"), "event", "session_id", "turn_id",
        F.coalesce("cwd", F.lit("")).alias("cwd"), "content",
        *[parse_iso(F.col(n)).alias(n) if n in ("occurred_at", "updated_at") else F.col(n) for n in CAPTURE_OPTIONAL],
        F.when(F.col("activity_kind").isin(*fv.ACTIVITY_KINDS), F.col("activity_kind")).alias("activity_kind"),
        "untrusted_source", "source_path", "source_line",
    )
    return records, rejects


def read_capture_log(spark: SparkSession, path: str, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    return parse_capture_lines(read_lines(spark, path), tz)


def malformed_report(rejects: DataFrame) -> DataFrame:
    """Rejected lines per file and reason."""
    return rejects.groupBy("source_path", "reason").agg(
        F.count(F.lit(1)).alias("lines"), F.min("source_line").alias("first_line")
    )


def tolerate_trailing(rejects: DataFrame, last_lines: DataFrame) -> DataFrame:
    """Unparsed lines that are an error: a file's last line may be a record still being written."""
    last = last_lines.select("source_path", F.col("last_line"))
    joined = rejects.join(last, "source_path", "left")
    return joined.where((F.col("reason") != "not-json") | (F.col("source_line") < F.col("last_line"))).drop("last_line")


def parse_session_index(lines: DataFrame) -> DataFrame:
    """Latest title per session; of equal update times the later line wins; unreadable lines are skipped."""
    rows = lines.withColumn("v", F.try_parse_json("value"))
    v = F.col("v")
    rows = rows.select(
        json_string(v, "$.id").alias("session_id"), trim_ws(json_string(v, "$.thread_name")).alias("title"),
        F.coalesce(parse_iso(json_string(v, "$.updated_at")), F.lit("1970-01-01").cast("timestamp")).alias("updated_at"),
        "source_line",
    ).where(F.col("session_id").isNotNull() & F.col("title").isNotNull())
    best = rows.groupBy("session_id").agg(
        F.max_by(F.struct("title", "updated_at"), F.struct("updated_at", "source_line")).alias("b")
    )
    return best.select("session_id", "b.title", "b.updated_at")


def read_session_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_session_index(read_lines(spark, path))


# --- producer session logs -----------------------------------------------------------------------
def supported_version(version: Column, minors: list[int] | None = None) -> Column:
    part = lambda g: F.regexp_extract(version, r"^(\d+)\.(\d+)\.", g).try_cast("int")
    known = (part(1) == fv.VERIFIED_PRODUCER_MAJOR) & part(2).isin(minors or fv.VERIFIED_PRODUCER_MINORS)
    return F.coalesce(known, F.lit(False))


def supported_versions(df: DataFrame, minors: list[int] | None = None, column: str = "producer_version"):
    """Rows of verified producers, and the quarantined rest with its error."""
    ok = supported_version(F.col(column), minors)
    shown = F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("未知"))
    return df.where(ok), df.where(~ok).withColumn("error", F.concat(F.lit("不支持的数据版本 "), shown))


def parse_producer_lines(lines: DataFrame) -> DataFrame:
    """Producer log lines to flat columns."""
    rows = evaluate_once(lines, ["source_path", "source_line"], F.try_parse_json("value").alias("v"))
    v = F.col("v")
    clean = lambda path: F.when(trim_ws(json_string(v, path)) != "", trim_ws(json_string(v, path)).substr(1, 1000))
    sub = F.try_variant_get(v, "$.payload.source.subagent", "string")
    return rows.select(
        F.col("source_path").alias("file"), F.col("source_line").cast("long").alias("line"),
        json_string(v, "$.type").alias("type"), parse_iso(json_string(v, "$.timestamp")).alias("timestamp"),
        json_string(v, "$.payload.type").alias("event_type"), clean("$.payload.turn_id").alias("turn_id"),
        F.coalesce(clean("$.payload.id"), clean("$.payload.session_id")).alias("meta_id"), clean("$.payload.cwd").alias("cwd"),
        clean("$.payload.originator").alias("originator"), clean("$.payload.cli_version").alias("producer_version"),
        F.coalesce(~sub.isin("", "false", "0"), F.lit(False)).alias("subagent"),
        json_string(v, "$.payload.message").alias("message"), json_string(v, "$.payload.last_agent_message").alias("answer"),
        parse_iso(json_string(v, "$.payload.completed_at")).alias("completed_at"),
    )


def resolve_producer_rows(records: DataFrame, originator: str = "Codex Desktop") -> DataFrame:
    """Carry session context and the active turn forward through each file.

    A turn stays active from the row that starts it to the first completion naming it (or naming none).
    The passes run over slim rows, written between passes; texts join the few rows that become captures.
    """
    keys, order, block = ["file"], ["line"], ordinal_block(F.col("line"))
    is_meta, is_msg = F.col("type") == "session_meta", F.col("type") == "event_msg"
    meta = F.when(is_meta, F.struct("meta_id", "originator", "producer_version", "subagent"))
    rows = previous_value(records.drop("message", "answer"), keys, order, block, meta, "meta")
    known = (F.col("meta.originator") == originator) & supported_version(F.col("meta.producer_version")) & ~F.col("meta.subagent")
    rows = cut_lineage(rows.withColumn("known", F.coalesce(known, F.lit(False))))
    # Rows under an unsupported session change nothing: neither the folder nor the active turn.
    in_turn = F.col("known") & F.col("turn_id").isNotNull()
    context = in_turn & (F.col("type") == "turn_context")
    folder = F.when(is_meta | (context & F.col("cwd").isNotNull()), F.struct(F.col("cwd").alias("cwd")))
    starts = context | (F.col("known") & is_msg & (F.col("event_type") == "task_started"))
    begun = F.when(starts, F.struct(F.col("turn_id").alias("turn"), F.col("line").alias("at")))
    rows = cut_lineage(previous_values(rows, keys, order, block, {"folder": folder, "begun": begun}))
    ends = is_msg & F.col("event_type").isin("task_complete", "turn_aborted")
    closing = F.col("known") & ends & (F.col("turn_id").isNull() | (F.col("turn_id") == F.col("begun.turn")))
    rows = previous_value(rows, keys, order, block, F.when(closing, F.col("line")), "closed_at")
    open_ = F.col("closed_at").isNull() | (F.col("closed_at") < F.col("begun.at"))
    rows = rows.withColumn("active_turn", F.when(open_, F.col("begun.turn")))
    prompt, at = is_msg & (F.col("event_type") == "user_message"), F.coalesce("timestamp", "completed_at")
    turn = F.when(prompt, F.col("active_turn")).otherwise(F.coalesce("turn_id", "active_turn"))
    error = (
        F.when(F.col("meta.meta_id").isNull(), "会话缺少 session_meta.id")
        .when(prompt & turn.isNull(), "用户消息缺少可关联的 turn_id")
        .when(ends & turn.isNull(), "完成事件缺少 turn_id")
    )
    text = F.when(prompt, F.col("message")).when(F.col("event_type") == "turn_aborted", fv.ABORTED_TEXT).otherwise(F.col("answer"))
    kept = rows.where(F.col("known") & (prompt | ends) & at.isNotNull())
    return kept.join(records.select("file", "line", "message", "answer"), ["file", "line"]).select(
        "file", "line", F.when(prompt, "UserPromptSubmit").otherwise("Stop").alias("event"), at.alias("captured_at"),
        F.col("meta.meta_id").alias("session_id"), turn.alias("turn_id"), F.col("folder.cwd").alias("cwd"),
        F.col("meta.producer_version").alias("producer_version"), trim_ws(redact(F.coalesce(text, F.lit("")))).alias("content"),
        error.alias("error"),
    )


def read_producer_sessions(records: DataFrame, bootstrap_after=None, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Prompt and stop captures of producer logs, and the rows that could not be placed."""
    rows = resolve_producer_rows(records)
    if bootstrap_after is not None:
        rows = rows.where(F.col("captured_at") > F.lit(bootstrap_after).cast("timestamp"))
    good = rows.where(F.col("error").isNull() & (F.col("content") != ""))
    event_id = ids.stable_id("codex:", 32, *[F.col(n) for n in ("event", "session_id", "turn_id", "cwd", "content")])
    captures = good.select(
        F.lit(1).alias("schema_version"), event_id.alias("event_id"), "captured_at", local_day(F.col("captured_at"), tz).alias("date"),
        F.lit("codex").alias("source"), F.lit("codex_desktop").alias("capture_source"), "producer_version", "event", "session_id",
        "turn_id", "cwd", "content", "file", "line",
    )
    return captures, rows.where(F.col("error").isNotNull()).select("file", "line", "event", "error")


def last_event_at(records: DataFrame, source: str | None = None) -> DataFrame:
    rows = records if source is None else records.where(F.col("capture_source") == source)
    return rows.groupBy("capture_source").agg(F.max("captured_at").alias("last_event_at"))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
