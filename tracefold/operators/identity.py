"""Merging tasks that are one piece of work under several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.text import strip_copy_suffix
from tracefold.functions.topics import work_identifier
from tracefold.session import cut_lineage


def encode_component(value: Column) -> Column:
    """URI component encoding."""
    out = F.url_encode(value)
    for coded, plain in [(r"\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        out = F.regexp_replace(out, coded, plain)
    return out


def _task_rows(events: DataFrame) -> DataFrame:
    return events.where(F.col("task_key").isNotNull() & F.col("kind").isin(*fv.TASK_KINDS))


def _rename(events: DataFrame, replacement: DataFrame, task_kinds_only: bool) -> DataFrame:
    """Apply (task_key -> new_key, new_title, first_start); later starts become progress.

    Events without a task, which may be most of them, are not joined: they would meet in one partition.
    """
    joined = events.where(F.col("task_key").isNotNull()).join(replacement, "task_key", "left")
    merged = F.col("new_key").isNotNull()
    if task_kinds_only:
        merged = merged & F.col("kind").isin(*fv.TASK_KINDS)
    demoted = merged & (F.col("kind") == "task_started") & ~F.col("id").eqNullSafe(F.col("first_start"))
    renamed = joined.select(
        *[
            F.when(merged, F.col("new_key")).otherwise(F.col("task_key")).alias("task_key") if c == "task_key"
            else F.when(merged, F.col("new_title")).otherwise(F.col("title")).alias("title") if c == "title"
            else F.when(demoted, "task_progress").otherwise(F.col("kind")).alias("kind") if c == "kind"
            else F.col(c)
            for c in events.columns
        ]
    )
    return renamed.unionByName(events.where(F.col("task_key").isNull()))


def numbered_copies(events: DataFrame, gap_days: int = fv.TASK_COPY_GAP_DAYS) -> DataFrame:
    """Replacement table of tasks whose titles differ by "(2)", "(3)" … within one project.

    Tasks of a family belong together while consecutive first sightings lie at most ``gap_days`` apart.
    A gap longer than a day can only fall between days, so islands are found on one row per family and
    day — bounded by the calendar however many tasks share a title — and joined back.
    """
    rows = _task_rows(events)
    at = F.struct("occurred_at", "id")
    tasks = rows.groupBy("task_key").agg(
        F.min_by(F.struct("title", "project_key", "occurred_at"), at).alias("head"),
        F.min_by("session_id", F.when(F.col("session_id").isNotNull(), at)).alias("session"),
        F.min(F.when(F.col("kind") == "task_started", at)).alias("start"),
    )
    parsed = strip_copy_suffix(F.col("head.title"))
    tasks = tasks.select(
        "task_key", "session", "start", F.col("head.project_key").alias("project_key"), F.col("head.occurred_at").alias("first_at"),
        F.to_date("head.occurred_at").alias("day"), parsed.alias("p"),
    ).select("task_key", "session", "start", "project_key", "first_at", "day", F.col("p.title").alias("title"),
             F.lower("p.title").alias("family"), F.col("p.numbered").alias("numbered"))
    keys = ["project_key", "family"]
    days = tasks.groupBy(*keys, "day").agg(F.min("first_at").alias("first"), F.max("first_at").alias("last"))
    by_day = Window.partitionBy(*keys).orderBy("day")
    gap = F.unix_micros("first") - F.unix_micros(F.lag("last").over(by_day))
    days = days.withColumn("broke", F.coalesce((gap > gap_days * 86_400_000_000).cast("int"), F.lit(1)))
    days = days.withColumn("island", F.sum("broke").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    placed = tasks.join(days.select(*keys, "day", "island"), [*keys, "day"])
    clusters = placed.groupBy(*keys, "island").agg(
        F.count(F.lit(1)).alias("tasks"), F.bool_or("numbered").alias("any_numbered"),
        F.min_by(F.struct("title", "task_key", "session"), F.struct("numbered", "first_at", "task_key")).alias("canon"),
        F.min("start")["id"].alias("first_start"),
    )
    sessions = placed.select(*keys, "island", "task_key").join(
        rows.select("task_key", "session_id").where(F.col("session_id").isNotNull()).distinct(), "task_key"
    ).groupBy(*keys, "island").agg(F.count_distinct("session_id").alias("sessions"))
    chosen = clusters.join(sessions, [*keys, "island"]).where(
        (F.col("tasks") >= 2) & (F.col("sessions") >= 2) & F.col("any_numbered")
    )
    new_key = F.concat_ws(
        ":", F.lit("codex"), "project_key", encode_component(F.col("family")), F.coalesce("canon.session", "canon.task_key")
    )
    chosen = chosen.select(*keys, "island", new_key.alias("new_key"), F.col("canon.title").alias("new_title"), "first_start")
    return placed.select(*keys, "island", "task_key").join(chosen, [*keys, "island"]).select(
        "task_key", "new_key", "new_title", "first_start"
    )


def merge_numbered_copies(events: DataFrame, gap_days: int = fv.TASK_COPY_GAP_DAYS) -> DataFrame:
    return _rename(events, numbered_copies(events, gap_days), task_kinds_only=True)


def explicit_identities(events: DataFrame) -> DataFrame:
    """Replacement table of tasks that name the same issue or task id from different kinds of source."""
    said = F.concat_ws(
        "\n", "title", "summary",
        F.array_join(F.transform("source_refs", lambda r: F.concat(F.coalesce(r["url"], F.lit("")), F.lit(" "), F.coalesce(r["excerpt"], F.lit("")))), "\n"),
    )
    rows = _task_rows(events).select(
        "id", "task_key", "project_key", "title", "kind", "occurred_at", work_identifier(said).alias("named"),
        F.transform("source_refs", lambda r: r["type"]).alias("types"),
    )
    rows = cut_lineage(rows, "identities").where(F.col("named").isNotNull())  # texts are searched once, before rows are chosen
    rows = rows.withColumn("identity", F.concat_ws(":", "project_key", "named"))
    at = F.struct("occurred_at", "id")
    # Whether there are two is told by the ends, so that map tasks fold an identity to one row however many tasks it has.
    ends = [F.min("task_key").alias("task_low"), F.max("task_key").alias("task_high"), F.min(F.array_min("types")).alias("type_low"), F.max(F.array_max("types")).alias("type_high")]
    several = F.coalesce(F.col("type_low") != F.col("type_high"), F.lit(False)) | (F.col("type_low").isNotNull() & F.coalesce("unnamed", F.lit(False)))
    groups = rows.groupBy("identity").agg(
        *ends, F.bool_or(F.exists("types", lambda t: t.isNull())).alias("unnamed"),
        F.min(F.when(F.col("kind") == "task_started", at))["id"].alias("first_start"),
        F.min_by("title", F.struct(~F.array_contains("types", "codex"), "occurred_at", "id")).alias("new_title"),
        F.min(at).alias("first_seen"),
    ).where((F.col("task_low") != F.col("task_high")) & several).select("identity", "first_start", "new_title", "first_seen")
    members = rows.select("identity", "task_key").distinct().join(groups, "identity")
    # A task that names several ids follows the one seen last.
    pick = F.max_by(F.struct("identity", "new_title", "first_start"), F.struct("first_seen", "identity"))
    return members.groupBy("task_key").agg(pick.alias("m")).select(
        "task_key", F.concat(F.lit("work:"), "m.identity").alias("new_key"), "m.new_title", "m.first_start"
    )


def merge_explicit_identities(events: DataFrame) -> DataFrame:
    """Every event of a task goes with its task, whatever its kind."""
    return _rename(events, explicit_identities(events), task_kinds_only=False)


def reconcile_identities(events: DataFrame) -> DataFrame:
    return merge_explicit_identities(merge_numbered_copies(events))


def numbered_families(pairs: DataFrame, titles: DataFrame) -> DataFrame:
    """Anchor shared by sessions whose index titles differ only by "(n)": (session_id, family_anchor)."""
    from tracefold.functions.projects import normalized_project
    from tracefold.functions.text import blank_to_null, trim_ws
    from tracefold.functions.topics import normalize_text

    heads = pairs.where(F.col("source") == "codex").groupBy("session_id").agg(
        F.min_by(F.struct("cwd", "captured_at"), F.struct("captured_at", "id")).alias("h")
    )
    title = trim_ws(F.col("title"))
    base = F.regexp_extract(title, r"^(.*?)\s*\(((?:[2-9]|\d{2,3}))\)\s*$", 1)
    numbered = title.rlike(r"^(.*?)\s*\(((?:[2-9]|\d{2,3}))\)\s*$")
    rows = heads.join(titles.where(blank_to_null(title).isNotNull()).select("session_id", "title"), "session_id").select(
        "session_id", numbered.alias("numbered"), F.col("h.captured_at").alias("first_seen"),
        F.concat_ws(":", normalized_project(F.col("h.cwd")), normalize_text(trim_ws(F.when(numbered, base).otherwise(title)))).alias("family"),
    )
    groups = rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("sessions"), F.bool_or("numbered").alias("any_numbered"),
        F.min(F.when(~F.col("numbered"), F.struct("first_seen", "session_id")))["session_id"].alias("base_session"),
    ).where((F.col("sessions") >= 2) & F.col("any_numbered"))
    member = F.col("numbered") | (F.col("session_id") == F.col("base_session"))
    return rows.join(groups, "family").where(member).select(
        "session_id", F.concat(F.lit("codex:numbered-family:"), "family").alias("family_anchor")
    )
