"""Readers of the settlement ledger, run history, legacy run logs and the status file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.dates import parse_iso
from tracefold.functions.notes import file_title
from tracefold.functions.text import blank_to_null, extract, trim_ws
from tracefold.operators.common import evaluate_once
from tracefold.schemas import QUEUE_COUNTERS, RUN_COUNTERS
from tracefold.sources.captures import is_object, json_number, json_string, variant_at


def text_at(v: Column, path: str) -> Column:
    return blank_to_null(trim_ws(json_string(v, path)))


def count_at(v: Column, path: str) -> Column:
    """A finite non-negative number, else null."""
    n = json_number(v, path)
    return F.when((n >= 0) & (n < float("inf")), n)


def strings_at(v: Column, path: str) -> Column:
    """Distinct non-blank strings of an array field, in order."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    text = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.array_distinct(F.filter(text, lambda s: s.isNotNull() & (trim_ws(s) != "")))


def digest_at(v: Column, path: str) -> Column:
    field = lambda *names: F.coalesce(*[blank_to_null(trim_ws(F.regexp_replace(json_string(v, f"{path}.{n}"), r"\s+", " "))) for n in names])
    parts = [field("about"), field("problem"), field("result"), field("next_use", "nextUse")]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    names = ["about", "problem", "result", "next_use"]
    return F.when(whole, F.struct(*[p.alias(n) for p, n in zip(parts, names)]))


def changes_at(v: Column, path: str) -> Column:
    """Knowledge changes with a known action and a path."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))

    def change(x: Column) -> Column:
        role, target = text_at(x, "$.role"), text_at(x, "$.path")
        return F.struct(
            text_at(x, "$.action").alias("action"), target.alias("path"),
            F.coalesce(text_at(x, "$.title"), file_title(target)).alias("title"),
            F.when(role.isin("memory", "evidence"), role).alias("role"),
        )

    return F.filter(F.transform(items, change), lambda c: c["action"].isin("created", "updated") & c["path"].isNotNull())


def parse_settlement_ledger(ledgers: DataFrame, text: str = "value", key: str = "ledger") -> tuple[DataFrame, DataFrame]:
    """Settlements and error rows of ledger documents (``key``, ``text``), one element per outcome.

    The first valid row of an id wins, as a ranked choice rather than a loop; later ones are errors.
    """
    rows = ledgers.where(trim_ws(F.col(text)) != "").withColumn("v", F.try_parse_json(text))
    rows = rows.withColumn("outcomes", F.try_variant_get("v", "$.outcomes", "array<variant>"))
    broken = rows.where(F.col("outcomes").isNull()).select(
        key, F.lit(None).cast("int").alias("index"),
        F.when(F.col("v").isNull(), "not-json").otherwise("no-outcomes").alias("reason"),
    )
    items = rows.select(key, F.posexplode("outcomes").alias("index", "o"))
    return _settlements(items, key, broken)


def parse_settlement_rows(rows: DataFrame, text: str = "value", key: str = "ledger") -> tuple[DataFrame, DataFrame]:
    """The same for ledgers kept as one JSON outcome per row: (``key``, index, ``text``).

    A ledger of any size splits over tasks this way; a single JSON document cannot.
    """
    return _settlements(rows.select(key, "index", F.try_parse_json(text).alias("o")), key, None)


def _settlements(items: DataFrame, key: str, broken: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    o = F.col("o")
    rows = evaluate_once(
        items, [key, "index"], is_object(o).alias("object"), text_at(o, "$.id").alias("id"), text_at(o, "$.status").alias("status"),
        strings_at(o, "$.source_event_ids").alias("source_event_ids"), strings_at(o, "$.wiki_paths").alias("wiki_paths"),
        changes_at(o, "$.knowledge_changes").alias("knowledge_changes"), text_at(o, "$.updated_at").alias("updated_text"),
        text_at(o, "$.last_error").alias("last_error"), text_at(o, "$.reason").alias("reason_text"),
        strings_at(o, "$.reused_by_outcome_ids").alias("reused_by"), text_at(o, "$.category").alias("category"),
        text_at(o, "$.title").alias("title"), text_at(o, "$.local_date").alias("local_date"),
        text_at(o, "$.occurred_at").alias("occurred_at"), text_at(o, "$.project_label").alias("project_label"),
        strings_at(o, "$.daily_paths").alias("daily_paths"), digest_at(o, "$.digest").alias("digest"),
        text_at(o, "$.memory_path").alias("memory_path"), strings_at(o, "$.evidence_paths").alias("evidence_paths"),
    )
    reason = (
        F.when(~F.col("object"), "not-object")
        .when(F.col("id").isNull(), "missing-id")
        .when(~F.coalesce(F.col("status").isin(*fv.SETTLEMENT_STATUSES), F.lit(False)), "unknown-status")
        .when(F.size("source_event_ids") == 0, "no-sources")
        .when(F.col("updated_text").isNull(), "missing-updated_at")
        .when((F.col("status") == "succeeded") & (F.size("wiki_paths") == 0), "succeeded-without-wiki")
    )
    judged = rows.withColumn("reason", reason)
    valid = judged.where(F.col("reason").isNull())
    # Winners by grouped minimum and a join back: a much repeated id never gathers in one window.
    first = valid.groupBy(key, "id").agg(F.min("index").alias("first_index"))
    ranked = valid.join(first, [key, "id"])
    settlements = ranked.where(F.col("index") == F.col("first_index")).select(
        key, "id", "status", "source_event_ids", "wiki_paths", "knowledge_changes", parse_iso(F.col("updated_text")).alias("updated_at"),
        "last_error", F.col("reason_text").alias("reason"), "reused_by", "category", "title", F.try_to_date("local_date").alias("local_date"),
        parse_iso(F.col("occurred_at")).alias("occurred_at"), "project_label", "daily_paths", "digest", "memory_path", "evidence_paths",
    )
    repeats = ranked.where(F.col("index") > F.col("first_index")).select(key, "index", F.lit("duplicate-id").alias("reason"))
    errors = judged.where(F.col("reason").isNotNull()).select(key, "index", "reason").unionByName(repeats)
    return settlements, errors if broken is None else errors.unionByName(broken)


def _status(v: Column) -> Column:
    status = text_at(v, "$.status")
    return F.when(status.isin(*fv.RUN_STATUSES), status)


def _counters(v: Column) -> list[Column]:
    return [F.coalesce(count_at(v, f"$.{field}"), F.lit(0.0)).alias(name) for field, name in RUN_COUNTERS]


def topic_results_at(v: Column, path: str) -> Column:
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))

    def result(x: Column) -> Column:
        return F.struct(
            text_at(x, "$.id").alias("id"), F.coalesce(text_at(x, "$.title"), F.lit("未命名主题")).alias("title"),
            text_at(x, "$.status").alias("status"), text_at(x, "$.reason").alias("reason"), text_at(x, "$.error").alias("error"),
            strings_at(x, "$.wiki_paths").alias("wiki_paths"), changes_at(x, "$.knowledge_changes").alias("knowledge_changes"),
            digest_at(x, "$.digest").alias("digest"), text_at(x, "$.memory_path").alias("memory_path"),
            strings_at(x, "$.evidence_paths").alias("evidence_paths"), strings_at(x, "$.daily_paths").alias("daily_paths"),
            F.coalesce(count_at(x, "$.source_event_count"), F.lit(0.0)).alias("source_event_count"),
        )

    return F.filter(
        F.transform(items, result), lambda r: r["id"].isNotNull() & F.coalesce(r["status"].isin(*fv.SETTLEMENT_STATUSES), F.lit(False))
    )


def parse_run_history(files: DataFrame, text: str = "value", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Structured run files, one JSON object per row, to typed runs and errors."""
    # Parsed once: a filter that is pushed below the projection would parse the text again for every field it asks for.
    rows = evaluate_once(files, [path], F.try_parse_json(text).alias("v"))
    v = F.col("v")
    ok = F.coalesce(
        is_object(v) & text_at(v, "$.run_id").isNotNull() & text_at(v, "$.started_at").isNotNull() & _status(v).isNotNull(), F.lit(False)
    )
    attempts = F.size(F.try_variant_get(v, "$.attempts", "array<variant>"))
    runs = rows.where(ok).select(
        F.coalesce(text_at(v, "$.attempt_id"), F.concat(F.lit("history:"), path)).alias("id"), text_at(v, "$.run_id").alias("run_id"),
        parse_iso(text_at(v, "$.started_at")).alias("started_at"), parse_iso(text_at(v, "$.finished_at")).alias("finished_at"),
        _status(v).alias("status"), F.when(text_at(v, "$.trigger") == "automatic", "automatic").otherwise("manual").alias("trigger"),
        *_counters(v), text_at(v, "$.cycle_id").alias("cycle_id"),
        F.when(attempts >= 0, attempts).when(_status(v) == "running", 0).otherwise(1).alias("attempt_count"),
        topic_results_at(v, "$.topic_results").alias("topic_results"), text_at(v, "$.error").alias("error"),
        text_at(v, "$.log_path").alias("log_path"), F.lit("structured").alias("origin"),
    )
    reason = F.when(~is_object(v) | v.isNull(), "not-json").otherwise("missing-run-fields")
    return runs, rows.where(~ok).select(path, reason.alias("reason"))


def parse_legacy_run_log(files: DataFrame, text: str = "value", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Plain run logs: ``key=value`` header, counts in the JSON line after ``[commit]``, time from the file name."""
    body = F.col(text)
    header = F.get(F.split(body, r"(?i)\r?\n(?:\r?\n|\[(?:commit|codex_stdout|codex_stderr)\]\r?\n)", 2), F.lit(0))
    field = lambda name: F.regexp_extract(header, rf"(?im)^{name}=([^\r\n]*)$", 1)
    value = lambda name: blank_to_null(trim_ws(field(name)))
    name = F.element_at(F.split(path, r"[\\/]"), -1)
    stamp = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2}-\d{6})", 1)
    named = F.try_to_timestamp(F.concat(stamp, F.lit("+08:00")), F.lit("yyyy-MM-dd-HHmmssXXX"))
    commit = F.try_parse_json(F.regexp_extract(body, r"(?i)\r?\n\[commit\]\r?\n(\{[^\r\n]*\})", 1))
    rows = files.withColumn("c", commit).withColumn("started_at", F.coalesce(parse_iso(value("started_at")), named))
    c = F.col("c")

    def number(key: str) -> Column:
        given = value(key).try_cast("double")
        return F.coalesce(F.when(given >= 0, given), count_at(c, f"$.{key}"), F.lit(0.0))

    from_header = {"selected_topics", "batch_index", "tokens_used", "input_chars", "duration_ms"}
    counters = [
        (number(f) if f in from_header else F.coalesce(count_at(c, f"$.{f}"), F.lit(0.0))).alias(n) for f, n in RUN_COUNTERS
    ]
    status = F.when(value("verified_status").isin(*fv.RUN_STATUSES), value("verified_status")).otherwise("unknown")
    trigger = F.when(value("trigger").isin("automatic", "manual"), value("trigger")).otherwise("legacy")
    runs = rows.where(F.col("started_at").isNotNull()).select(
        F.concat(F.lit("legacy:"), path).alias("id"),
        F.coalesce(value("run_id"), F.concat(F.lit("legacy:"), F.regexp_replace(name, r"\.log$", ""))).alias("run_id"), "started_at",
        parse_iso(value("finished_at")).alias("finished_at"), status.alias("status"), trigger.alias("trigger"), *counters,
        value("cycle_id").alias("cycle_id"), F.lit(1).alias("attempt_count"), F.col(path).alias("log_path"), F.lit("legacy-log").alias("origin"),
    )
    return runs, rows.where(F.col("started_at").isNull()).select(path, F.lit("no-start-time").alias("reason"))


def parse_current_status(files: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """The status document as a run row and as a queue row."""
    rows = files.withColumn("v", F.try_parse_json(text))
    v = F.col("v")
    updated = text_at(v, "$.updated_at")
    ok = text_at(v, "$.run_id").isNotNull() & updated.isNotNull() & _status(v).isNotNull()
    clock = extract(updated, r"T(\d{2}:\d{2})")
    automatic = F.coalesce(clock.between(*fv.AUTOMATIC_WINDOW), F.lit(False))
    runs = rows.where(F.coalesce(ok, F.lit(False))).select(
        F.concat_ws(":", F.lit("current"), text_at(v, "$.run_id"), updated).alias("id"), text_at(v, "$.run_id").alias("run_id"),
        parse_iso(updated).alias("started_at"), _status(v).alias("status"),
        F.when(automatic, "automatic").otherwise("manual").alias("trigger"), *_counters(v), F.lit(1).alias("attempt_count"),
        text_at(v, "$.error").alias("error"), F.lit("current-status").alias("origin"),
    )

    def counter(name: str, stand_in: str | None) -> Column:
        tries = [count_at(v, f"$.{name}")] + ([count_at(v, f"$.{stand_in}")] if stand_in else [])
        return F.coalesce(*tries, F.lit(0.0)).alias(name)

    queue = rows.where(is_object(v)).select(text_at(v, "$.run_id").alias("run_id"), *[counter(n, s) for n, s in QUEUE_COUNTERS])
    return runs, queue


def newest(files: DataFrame, n: int, order: str = "modified_at") -> DataFrame:
    return files.orderBy(F.col(order).desc()).limit(n)


__all__ = [
    "parse_settlement_ledger", "parse_settlement_rows", "parse_run_history", "parse_legacy_run_log", "parse_current_status",
    "newest", "text_at", "strings_at", "digest_at", "changes_at", "topic_results_at", "count_at",
]
