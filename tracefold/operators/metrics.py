"""Tasks, calendar, range metrics, focus switches and project labels over activity events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.dates import in_range
from tracefold.functions.projects import label_priority
from tracefold.functions.text import choose, rank_of
from tracefold.operators.sequence import RANGE, first_rows, previous_value, range_blocks

ALL = "all"


def _moment(*names: str) -> Column:
    return F.struct(*names)


# --- filters and order ---------------------------------------------------------------------------
def filter_events(events: DataFrame, start, end, project: str = ALL, confidence: str = ALL) -> DataFrame:
    kept = events.where(in_range(F.col("local_date"), start, end))
    if project != ALL:
        kept = kept.where(F.col("project_key") == project)
    return kept if confidence == ALL else kept.where(F.col("confidence") == confidence)


def filter_outcomes(outcomes: DataFrame, start, end, project: str = ALL, proof: str = ALL) -> DataFrame:
    kept = outcomes.where(in_range(F.col("local_date"), start, end))
    if project != ALL:
        kept = kept.where(F.col("project_key") == project)
    if proof != ALL:
        kept = kept.where(F.col("proof") == proof)
    return kept.orderBy(F.col("occurred_at").desc(), F.col("id"))


def order_events(events: DataFrame) -> DataFrame:
    return events.orderBy("occurred_at", "id")


def order_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.col("last_activity_at").desc(), F.col("task_key"))


def first_by_key(df: DataFrame, key: list, order: list = ("occurred_at", "id")) -> DataFrame:
    return first_rows(df, list(key), list(order))


# --- keys that events are counted by -------------------------------------------------------------
def note_path() -> Column:
    """Path of the first wiki reference of an event."""
    return F.get(F.filter("source_refs", lambda r: r["type"] == "wiki"), F.lit(0))["path"]


def object_identity() -> Column:
    return F.coalesce("object_key", "id")


def note_identity() -> Column:
    return F.coalesce(note_path(), F.col("object_key"), F.col("id"))


def task_events(events: DataFrame) -> DataFrame:
    """Bridge (task_key, event_id): what the reference keeps as an id list per task."""
    return _task_rows(events).select("task_key", F.col("id").alias("event_id"), "occurred_at")


def task_sources(events: DataFrame) -> DataFrame:
    """Distinct source references of each task."""
    ref = F.col("ref")
    key = F.concat_ws(
        ":", ref["type"], F.coalesce(ref["path"], ref["url"], ref["label"]), F.coalesce(ref["line"].cast("string"), F.lit(""))
    )
    rows = _task_rows(events).select("task_key", "occurred_at", "id", F.posexplode("source_refs").alias("pos", "ref"))
    rows = rows.withColumn("ref_key", key)
    return first_rows(rows, ["task_key", "ref_key"], ["occurred_at", "id", "pos"]).select("task_key", "ref_key", "ref")


def _task_rows(events: DataFrame) -> DataFrame:
    return events.where(F.col("task_key").isNotNull() & F.col("kind").isin(*fv.TASK_KINDS))


# --- tasks ---------------------------------------------------------------------------------------
def aggregate_tasks(events: DataFrame) -> DataFrame:
    """One row per task; the latest event decides the status, so a finished task may reopen.

    Partial aggregation runs before the only shuffle. ``active_dates`` is bounded by the calendar; event
    ids and references, which are not, are the bridges ``task_events`` and ``task_sources``.
    """
    at = _moment("occurred_at", "id")
    turn = F.concat_ws(":", F.coalesce("session_id", F.lit("unknown")), F.coalesce("turn_id", "id"))
    last = F.max_by(F.struct("kind", "project_key", "project_label", "confidence", "observed_at"), at)
    grouped = _task_rows(events).groupBy("task_key").agg(
        F.min_by(F.struct("title", "occurred_at"), at).alias("head"),
        last.alias("tail"),
        F.sort_array(F.collect_set("local_date")).alias("active_dates"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct(turn).alias("turn_count"),
    )
    status = F.when(F.col("tail.kind") == "task_completed", "completed").when(
        F.col("tail.kind") == "task_blocked", "blocked"
    ).otherwise("active")
    return grouped.select(
        "task_key", "tail.project_key", "tail.project_label", "head.title", status.alias("status"),
        F.col("tail.confidence").alias("status_confidence"), F.col("head.occurred_at").alias("first_observed_at"),
        F.col("tail.observed_at").alias("last_activity_at"), "active_dates", "event_count", "turn_count",
    )


def group_by_project(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("project_label").agg(F.count(F.lit(1)).alias("tasks"))


# --- calendar ------------------------------------------------------------------------------------
def _calendar_kind() -> Column:
    kind = F.col("kind")
    return (
        F.when(kind.isin(*fv.TASK_KINDS) & F.col("task_key").isNotNull(), "task")
        .when(kind == "output_created", "output")
        .when(kind.isin(*fv.KNOWLEDGE_KINDS), "knowledge")
    )


def calendar_days(events: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Distinct tasks, outputs and notes per day.

    An event counts in one dimension only, so one distinct over (day, dimension, key) replaces three
    distinct counts and the row expansion they would need.
    """
    dimension = _calendar_kind()
    key = F.when(dimension == "task", F.col("task_key")).when(dimension == "output", object_identity()).otherwise(
        note_identity()
    )
    units = events.where(dimension.isNotNull()).select("local_date", dimension.alias("dim"), key.alias("key")).distinct()
    days = units.groupBy("local_date").agg(
        F.count_if(F.col("dim") == "task").alias("tasks"),
        F.count_if(F.col("dim") == "output").alias("outputs"),
        F.count_if(F.col("dim") == "knowledge").alias("knowledge"),
    )
    if outcomes is None:
        return days
    made = outcomes.groupBy("local_date").agg(F.count(F.lit(1)).alias("made"))
    joined = days.drop("outputs").join(made, "local_date", "full_outer")
    return joined.select(
        "local_date", F.coalesce("tasks", F.lit(0)).alias("tasks"), F.coalesce("made", F.lit(0)).alias("outputs"),
        F.coalesce("knowledge", F.lit(0)).alias("knowledge"),
    )


def date_spine(spark, start, end) -> DataFrame:
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias("local_date"))


def daily_distribution(events: DataFrame, start, end, outcomes: DataFrame | None = None) -> DataFrame:
    """``calendar_days`` on every day of a range, with the largest count for scaling."""
    if outcomes is not None:
        outcomes = outcomes.where(in_range(F.col("local_date"), start, end))
    days = calendar_days(filter_events(events, start, end), outcomes)
    dense = date_spine(events.sparkSession, start, end).join(days, "local_date", "left").fillna(0)
    largest = F.greatest(F.lit(1), F.max(F.greatest("tasks", "outputs", "knowledge")).over(Window.partitionBy()))
    return dense.withColumn("largest", largest)  # the spine has one row per day of the range


# --- activity units and focus --------------------------------------------------------------------
def activity_units(events: DataFrame) -> DataFrame:
    """One unit per owner, day and task (or research session): its earliest and its most telling event."""
    rows = events.where(F.col("kind").isin(*fv.TASK_KINDS, "research_activity"))
    identity = F.coalesce(
        F.col("task_key"), F.concat(F.lit("research:"), F.coalesce("session_id", "id"))
    )
    priority = rank_of(F.col("kind"), fv.KIND_PRIORITY)
    return (
        rows.withColumn("identity", identity)
        .groupBy("owner", "local_date", "identity")
        .agg(
            F.min_by(F.struct("id", "occurred_at", "project_key"), _moment("occurred_at", "id")).alias("anchor"),
            F.max_by(F.struct("id", "kind", "project_key"), F.struct(priority, "occurred_at", "id")).alias("representative"),
        )
    )


def focus_switches(units: DataFrame, minutes: int = fv.FOCUS_GAP_MINUTES, blocks: int | None = None) -> DataFrame:
    """Anchors whose predecessor, the same day and at most ``minutes`` before, worked on another project."""
    anchors = units.select("owner", "local_date", "anchor.*").where(F.col("project_key") != "unassigned")
    keys, order = ["owner", "local_date"], ["occurred_at", "id"]
    anchors = range_blocks(anchors.select(*keys, *order, "project_key"), keys, order, blocks)
    seen = previous_value(anchors, keys, order, F.col(RANGE), F.struct("occurred_at", "project_key"), "previous")
    gap = F.unix_micros("occurred_at") - F.unix_micros("previous.occurred_at")
    return seen.where(
        gap.between(0, minutes * 60_000_000) & (F.col("project_key") != F.col("previous.project_key"))
    ).select("owner", "local_date", "id", "occurred_at", "project_key", F.col("previous.project_key").alias("from_project"))


# --- metrics -------------------------------------------------------------------------------------
def outcome_metric_events(outcomes: DataFrame) -> DataFrame:
    """Outcomes as countable output events; the proof decides the confidence."""
    return outcomes.select(
        "id", F.lit("output_created").alias("kind"), "occurred_at", F.col("occurred_at").alias("observed_at"),
        "local_date", F.lit("captured").alias("time_basis"), "title", "project_key", "project_label",
        F.col("id").alias("object_key"), choose(F.col("proof"), fv.PROOF_CONFIDENCE).alias("confidence"),
    )


def _metric_parts(events: DataFrame, start, end, project: str, confidence: str, outcomes: DataFrame | None):
    scoped = filter_events(events, start, end, project, confidence)
    units = activity_units(scoped)
    if outcomes is None:
        outputs = scoped.where(F.col("kind") == "output_created")
    else:
        outputs = filter_events(outcome_metric_events(outcomes), start, end, project, confidence)
    at = _moment("occurred_at", "id")
    outputs = outputs.groupBy(object_identity().alias("key")).agg(F.min_by("id", at).alias("event_id"))
    sourced = F.exists("source_refs", lambda r: r["type"].isin(*fv.CAPTURE_REF_TYPES))
    knowledge = (
        scoped.where(F.col("kind").isin(*fv.KNOWLEDGE_KINDS))
        .groupBy("local_date", note_identity().alias("note"))
        .agg(F.min_by(F.struct(F.col("id").alias("event_id"), sourced.alias("sourced")), at).alias("head"))
        .select("local_date", "note", "head.*")
    )
    reuse = scoped.where(F.col("kind") == "knowledge_reused")
    reuse = reuse.groupBy(object_identity().alias("key")).agg(F.min_by("id", at).alias("event_id"))
    return units, outputs, knowledge, reuse, focus_switches(units)


def metric_evidence(
    events: DataFrame, start, end, project: str = ALL, confidence: str = ALL, outcomes: DataFrame | None = None
) -> DataFrame:
    """Events behind each metric: (dimension, event_id). A metric's value is the number of its rows here."""
    units, outputs, knowledge, reuse, switches = _metric_parts(events, start, end, project, confidence, outcomes)
    parts = [
        ("activity", units.select(F.col("representative.id").alias("event_id"))), ("output", outputs),
        ("knowledge", knowledge), ("reuse", reuse), ("focus", switches.select(F.col("id").alias("event_id"))),
    ]
    rows = [df.select(F.lit(name).alias("dimension"), "event_id") for name, df in parts]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def metrics_for_range(
    events: DataFrame, start, end, project: str = ALL, confidence: str = ALL, outcomes: DataFrame | None = None
) -> DataFrame:
    """Five rows: activity, output, knowledge, reuse and focus, each with its value and note."""
    units, outputs, knowledge, reuse, switches = _metric_parts(events, start, end, project, confidence, outcomes)
    text = F.format_string
    assigned = F.when(F.col("representative.project_key") != "unassigned", F.col("representative.project_key"))
    activity = units.agg(
        F.count(F.lit(1)).alias("value"), F.count_distinct("identity").alias("tasks"),
        F.count_distinct(assigned).alias("projects"),
    ).select("value", text("%d 项任务或对话 · %d 个已归属项目 · 每项每日计 1 次", "tasks", "projects").alias("note"))
    basis = "以 Git commit 等可核对事实计数" if outcomes is None else "按同一真实任务合并 · 可展开底层证据"
    output = outputs.agg(F.count(F.lit(1)).alias("value"))
    output = output.select("value", F.when(F.col("value") == 0, "暂无真实成果").otherwise(basis).alias("note"))
    notes = knowledge.groupBy("note").agg(F.count(F.lit(1)).alias("n"), F.bool_or("sourced").alias("sourced"))
    known = notes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("value"), F.count(F.lit(1)).alias("notes"),
        F.count_if("sourced").alias("sourced"),
    ).select(
        "value",
        F.when(F.col("notes") == 0, "暂无知识数据").otherwise(text("来源覆盖 %d/%d", "sourced", "notes")).alias("note"),
    )
    reused = reuse.agg(F.count(F.lit(1)).alias("value")).select(
        "value",
        F.when(F.col("value") == 0, "暂无显式知识复用证据").otherwise("显式 Wiki 引用 · 日期按修改时间估算").alias("note"),
    )
    # Both sides are one row per day, so the day count and the switch count meet without a cross join.
    per_day = units.groupBy("local_date").agg(F.lit(1).alias("active"))
    moved = switches.groupBy("local_date").agg(F.count(F.lit(1)).alias("switched"))
    focus = per_day.join(moved, "local_date", "full_outer").agg(
        F.coalesce(F.sum("switched"), F.lit(0)).alias("value"), F.coalesce(F.sum("active"), F.lit(0)).alias("days")
    ).select("value", text("按任务首次活动估算 · %d 个活跃日 · 90 分钟内", "days").alias("note"))
    rows = None
    for name, df in [("activity", activity), ("output", output), ("knowledge", known), ("reuse", reused), ("focus", focus)]:
        row = df.select(
            F.lit(name).alias("dimension"), F.lit(fv.METRIC_LABELS[name]).alias("label"),
            F.col("value").cast("long").alias("value"), "note",
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def knowledge_coverage(events: DataFrame) -> DataFrame:
    """How many notes rest on at least one captured source."""
    sourced = F.exists("source_refs", lambda r: r["type"].isin(*fv.CAPTURE_REF_TYPES))
    notes = (
        events.where(F.col("kind").isin(*fv.KNOWLEDGE_KINDS))
        .groupBy(note_identity().alias("note"))
        .agg(F.bool_or(sourced).alias("sourced"))
    )
    return notes.agg(F.count_if("sourced").alias("sourced_notes"), F.count(F.lit(1)).alias("notes")).withColumn(
        "coverage", F.when(F.col("notes") > 0, F.round(F.col("sourced_notes") / F.col("notes"), 6))
    )


# --- projects ------------------------------------------------------------------------------------
def project_options(events: DataFrame) -> DataFrame:
    """Project keys with their latest label, in label order."""
    options = events.groupBy("project_key").agg(F.max_by("project_label", _moment("occurred_at", "id")).alias("label"))
    return options.orderBy(F.collate("label", "UNICODE"), "project_key")


def reconcile_project_labels(events: DataFrame) -> DataFrame:
    """Give all events of a project the label of its strongest source, the earliest on ties."""
    types = F.transform("source_refs", lambda r: r["type"])
    order = F.struct(-label_priority(types), F.col("occurred_at"), F.col("id"))
    best = events.groupBy("project_key").agg(F.min_by("project_label", order).alias("best_label"))
    joined = events.join(best, "project_key", "left")
    return joined.withColumn("project_label", F.coalesce("best_label", "project_label")).drop("best_label")
