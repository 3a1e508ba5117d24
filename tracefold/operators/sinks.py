"""Appending captures and writing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.collab import module_label
from tracefold.functions.text import blank_to_null, lines_of
from tracefold.functions.topics import automation_display_name


def valid_capture() -> Column:
    text = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    return F.col("event").isin("UserPromptSubmit", "Stop") & text("session_id") & text("turn_id") & (F.trim(F.coalesce("content", F.lit(""))) != "")


def append_plan(batch: DataFrame, known: DataFrame, key: str = "event_id", seq: str = "ingest_seq", valid: Column | None = None) -> DataFrame:
    """Each row of a batch with its verdict: accepted, duplicate (known, or repeated in the batch) or rejected.

    The first row of an id in the batch is found by a grouped minimum and joined back, so an id repeated
    without limit needs no window of its own.
    """
    ok = valid_capture() if valid is None else valid
    good = batch.where(ok)
    first = good.groupBy(key).agg(F.min(seq).alias("_first"))
    old = known.select(key, F.lit(True).alias("_known")).distinct()
    judged = good.join(first, key).join(old, key, "left")
    fresh = F.col("_known").isNull() & F.col(seq).eqNullSafe(F.col("_first"))
    rows = judged.withColumn("verdict", F.when(fresh, "accepted").otherwise("duplicate")).drop("_first", "_known")
    return rows.unionByName(batch.where(~F.coalesce(ok, F.lit(False))).withColumn("verdict", F.lit("rejected")))


def append_counts(plan: DataFrame, owner: list[str] | None = None) -> DataFrame:
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    return plan.groupBy(*(owner or [])).agg(
        is_("accepted").alias("accepted"), is_("duplicate").alias("duplicates"), is_("rejected").alias("rejected"),
        (is_("accepted") + is_("duplicate")).alias("acknowledged"),
    )


def append_resources(records: DataFrame, known: DataFrame) -> DataFrame:
    """Resource records whose event id is new."""
    first = records.groupBy("event_id").agg(F.min("ingest_seq").alias("_first"))
    rows = records.join(known.select("event_id").distinct(), "event_id", "left_anti").join(first, "event_id")
    return rows.where(F.col("ingest_seq") == F.col("_first")).drop("_first")


def _quote(value: Column) -> Column:
    return F.array_join(F.transform(lines_of(value), lambda l: F.concat(F.lit("> "), l)), "\n")


def _heading(value: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(value, r"[\r\n]+", " "), r"[#*_\[\]`]", "")
    return F.coalesce(blank_to_null(F.trim(clean)), F.lit("未命名"))


def source_marker() -> Column:
    first, second = F.get("source_event_ids", F.lit(0)), F.get("source_event_ids", F.lit(1))
    prefix = F.when(F.col("source") == "chatgpt_web", "chatgpt-qna").otherwise("codex-qna")
    pair = F.concat(F.lit("<!-- "), prefix, F.lit(":prompt="), first, F.lit(";stop="), second, F.lit(" -->"))
    return F.when(F.col("source") == "feishu", F.concat(F.lit("<!-- feishu-record:event="), first, F.lit(" -->"))).otherwise(pair)


def daily_source_pages(pairs: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Blocks of the daily source pages: (daily_path, captured_at, id, marker, block), a heading block per page.

    A page is its blocks in (captured_at, id) order. They are not gathered into one value: a day may hold
    a third of all pairs. ``written`` (marker) names blocks already on their page, which are left out.
    """
    record, chat = F.col("source") == "feishu", F.col("source") == "chatgpt_web"
    automated = F.col("prompt_content").rlike(fv.AUTOMATION_HEADER) | F.col("prompt_content").rlike(fv.OPT_OUT_PROMPT)
    title = F.when(chat, F.coalesce(blank_to_null(F.col("title")), F.lit("未命名对话"))).otherwise(
        F.coalesce(blank_to_null(F.col("cwd")), F.lit("未记录工作目录"))
    )
    body = lambda *parts: F.concat_ws("\n", *parts)
    lit = F.lit
    as_record = body(
        F.concat(lit("## "), _heading(F.coalesce(blank_to_null(F.col("title")), lit("未命名飞书记录")))), F.col("marker"), lit(""),
        F.concat(lit("- 来源：飞书 · "), module_label(F.col("resource_type"))), lit(""), _quote(F.col("stop_content")), lit(""),
    )
    as_automation = body(
        F.concat(lit("## 自动化记录："), automation_display_name(F.col("prompt_content"), F.col("stop_content"))), F.col("marker"), lit(""),
        lit("### 结果"), _quote(F.substring("stop_content", 1, fv.AUTOMATION_RESULT_CHARS)), lit(""),
    )
    as_pair = body(
        F.concat(lit("## "), _heading(title)), F.col("marker"), lit(""), lit("### 问题"), _quote(F.col("prompt_content")), lit(""),
        lit("### 回答"), _quote(F.col("stop_content")), lit(""),
    )
    rows = pairs.withColumn("marker", source_marker())
    if written is not None:
        rows = rows.join(written.select("marker").distinct(), "marker", "left_anti")
    blocks = rows.select(
        "daily_path", "captured_at", "id", "marker", F.when(record, as_record).when(automated, as_automation).otherwise(as_pair).alias("block")
    )
    name = F.when(chat, "ChatGPT").when(record, "飞书").otherwise("Codex")
    kind = F.when(record, "活动").otherwise("原始问答")
    heads = rows.groupBy("daily_path").agg(F.min(F.concat(lit("# "), name, lit(" "), kind, lit(" - "), F.col("date").cast("string"), lit("\n"))).alias("block"))
    return blocks.unionByName(heads.select(
        "daily_path", lit(None).cast("timestamp").alias("captured_at"), lit("").alias("id"), lit(None).cast("string").alias("marker"), "block"
    ))


def write_pages(blocks: DataFrame, path: str, page: str = "daily_path", order: tuple[str, ...] = ("captured_at", "id"), text: str = "block") -> None:
    """Write ordered blocks as text, one folder per page; a page reads as its files in name order.

    Range partitioning keeps the order across files and splits a page that outgrows a task. Pages that are given are
    replaced, others stay, so writing twice doubles nothing.
    """
    ordered = blocks.repartitionByRange(page, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        page, *[F.col(c).asc_nulls_first() for c in order]
    )
    ordered.select(page, F.col(text).alias("value")).write.partitionBy(page).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)
