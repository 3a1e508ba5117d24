"""Deliverables: commits, notes and completion reports, their naming and their managed tables."""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import fields as dataclass_fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions import ids
from tracefold.functions.artifact_titles import display_title
from tracefold.functions.notes import extract_paths, extract_urls, readable_file_title, wiki_conclusion
from tracefold.functions.text import (
    blank_to_null, choose, extract_all, has_direct_completion, head_chars, let, lines_of, matching_lines, non_empty,
    report_section, result_summary, sanitize_text, sentences, trim_ws,
)
from tracefold.operators.common import dealt
from tracefold.operators.metrics import note_path
from tracefold.operators.sequence import first_rows
from tracefold.session import cut_lineage, shuffles_released

ARTIFACT_COLUMNS = [
    "id", "local_date", "occurred_at", "time_basis", "project_key", "project_label", "task_key", "kind", "title", "problem", "result",
    "validation", "limitations", "proof", "source_event_ids", "source_refs",
]


def refs_of(kind: str) -> Column:
    return F.filter("source_refs", lambda r: r["type"] == kind)


def commit_hash() -> Column:
    return F.lower(blank_to_null(F.regexp_extract(F.coalesce("object_key", "id"), "(?i)([0-9a-f]{40})$", 1)))


def _hash_of_id() -> Column:
    return blank_to_null(F.regexp_extract("id", "([0-9a-f]{40})$", 1))


def _commit_result(title: Column, count: Column, shown: Column) -> Column:
    listed = F.concat(
        title, F.lit("\nGit 提交记录列出 "), count.cast("string"), F.lit(" 个相关文件："), F.array_join(shown, "、"),
        F.when(count > fv.COMMIT_FILES_SHOWN, "等").otherwise(""), F.lit("。"),
    )
    return F.when(count > 0, listed).otherwise(title)


def _artifact(events: DataFrame, **parts: Column) -> DataFrame:
    base = {n: F.col(n) for n in ("local_date", "occurred_at", "time_basis", "project_key", "project_label", "task_key", "source_refs")}
    cols = {**base, **parts}
    files = F.transform(refs_of("file"), lambda r: r["label"])
    cols["title"] = display_title(F.col("title"), F.col("project_label"), parts["kind"], files)
    return events.select(*[cols[n].alias(n) for n in ARTIFACT_COLUMNS])


def commit_artifacts(events: DataFrame) -> DataFrame:
    """One artifact per commit event; clones of one commit are merged by ``merge_commit_artifacts``."""
    rows = events.where((F.col("kind") == "output_created") & F.exists("source_refs", lambda r: r["type"] == "git"))
    rows = rows.withColumn("hash", commit_hash())
    files = F.transform(F.filter(refs_of("file"), lambda r: r["path"].isNotNull()), lambda r: r["label"])
    key = F.coalesce("hash", "object_key", "id")
    proof = F.when(F.col("hash").isNotNull(), F.concat(F.lit("Git 历史中存在完整提交 "), "hash", F.lit("。"))).otherwise("Git 历史中存在该提交。")
    return _artifact(
        rows, id=F.when(F.col("hash").isNotNull(), F.concat(F.lit("artifact:git:"), key)).otherwise(F.concat(F.lit("artifact:"), key)),
        kind=F.lit("git-commit"), problem=F.lit(None).cast("string"),
        result=_commit_result(F.col("title"), F.size(files), F.slice(files, 1, fv.COMMIT_FILES_SHOWN)),
        validation=F.array(proof), limitations=F.array().cast("array<string>"), proof=F.lit("independent"),
        source_event_ids=F.array("id"),
    )


@dataclass
class MergedCommits:
    """Commits with the clones of each merged, as tables."""

    heads: DataFrame  # (id, clones, files, refs, targets, events, the columns asked for): one row a commit, and how many of each it has
    events: DataFrame  # (id, event_id)
    refs: DataFrame  # (id, type, label, path, url, line, excerpt): a file once by its name, case aside, others once by where they lead
    targets: DataFrame  # (id, key, type, label, path, url, hash, attribution): a repository of the commit once, case aside


#: A commit crowds a task where its clones are more than this and more than twice a task's even share.
CROWD = 100_000
_HEAD, _EVENT, _FILE, _OTHER, _TARGET = range(5)


def _crowded(artifacts: DataFrame, tasks: int) -> bool:
    """Whether one commit's clones would make the task that folds them the long one; counted by cells of ids."""
    cells = artifacts.groupBy(F.pmod(F.xxhash64("id"), F.lit(max(4096, 16 * tasks)))).agg(F.count(F.lit(1)).alias("n"))
    with shuffles_released(artifacts.sparkSession):
        most, rows = cells.agg(F.max("n"), F.sum("n")).first()
    return most is not None and most > max(CROWD, 2 * rows // tasks)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _commit_units(artifacts: DataFrame, columns: list[str], refs: bool, tasks: int | None) -> DataFrame:
    """(id, part, key, order, n, label, ref, head): what the clones of a commit say, each once, as the first of them says it.

    With ``tasks``, clones are dealt by their commit and fold where they arrive; without, what each task's clones say is
    folded before it is dealt. Each column moves once, of a file no more than its name unless ``refs`` are asked for, and
    of a result that its files make again no more than its first line.
    """
    types = {c: artifacts.schema[c].dataType for c in ("source_event_ids", "source_refs")}
    whole = {c: F.coalesce(c, F.array().cast(t)) for c, t in types.items()}
    is_file = lambda r: r["type"].eqNullSafe("file")
    fields = ["type", "label", "path", "url", "line", *(["excerpt"] if refs else [])]
    files = F.transform(F.filter(whole["source_refs"], is_file), lambda r: r if refs else r["label"])
    others = F.transform(F.filter(whole["source_refs"], lambda r: ~is_file(r)), lambda r: F.struct(*[r[c].alias(c) for c in fields]))
    label = lambda f: f["label"] if refs else f
    again = _commit_result(F.col("result"), F.size("_files"), F.slice(F.transform("_files", label), 1, fv.COMMIT_FILES_SHOWN))
    moved = artifacts.select(
        *dict.fromkeys(["id", "occurred_at", "title", *columns]), whole["source_event_ids"].alias("source_event_ids"), files.alias("_files"), others.alias("_others"))
    if "result" in columns:
        moved = moved.withColumn("_whole", F.col("result")).withColumn("result", F.substring_index("result", "\n", 1))
        moved = moved.withColumn("_whole", F.when(~again.eqNullSafe(F.col("_whole")), F.col("_whole")))
    if not refs:  # names move as one text where it gives them again, which packs better than a list
        moved = moved.withColumn("_names", F.array_join("_files", "\n"))
        moved = moved.withColumn("_files", F.when(~F.split("_names", "\n").eqNullSafe(F.col("_files")), F.col("_files")))
    moved = dealt(moved, tasks, "id") if tasks else moved
    if not refs:
        moved = moved.withColumn("_files", F.coalesce("_files", F.split("_names", "\n")))
    if "result" in columns:
        moved = moved.withColumn("result", F.coalesce("_whole", again))
    event = F.get("source_event_ids", F.lit(0))
    rows = moved.select("id", F.struct("occurred_at", event.alias("event"), "title").alias("at"), F.struct(*columns).alias("head"), "source_event_ids", "_files", "_others")
    ref_type, head_type, none = types["source_refs"].elementType if refs else "int", rows.schema["head"].dataType, F.lit(None)
    unit = lambda part, key, pos, label=none, ref=none, head=none: F.struct(
        F.lit(part).alias("part"), key.alias("key"), pos.alias("pos"), label.cast("string").alias("label"), ref.cast(ref_type).alias("ref"), head.cast(head_type).alias("head"))
    own = lambda r: r if refs else none
    leads = lambda r: F.concat_ws(":", *[_text(r[c]) for c in ("type", "path", "url", "line")])
    target = lambda r: F.concat(F.lit("git:"), F.coalesce(_hash_of_id(), event, F.lit("")), F.lit(":"), F.coalesce(F.lower(r["path"]), _text(r["label"])))
    units = F.concat(
        F.array(unit(_HEAD, F.lit(""), F.lit(0), head=F.col("head"))),
        F.transform("source_event_ids", lambda e, i: unit(_EVENT, e, i)),
        F.transform("_files", lambda f, i: unit(_FILE, F.lower(label(f)), i, label(f), own(f))),
        F.transform("_others", lambda r, i: unit(_OTHER, leads(r), i, r["label"], own(r))),
        F.transform(F.filter("_others", lambda r: r["type"] == "git"), lambda r, i: unit(_TARGET, target(r), i, r["label"], own(r))),
    )
    order = F.struct("at", "u.pos")
    return rows.select("id", "at", F.explode(units).alias("u")).groupBy("id", F.col("u.part").alias("part"), F.col("u.key").alias("key")).agg(
        F.min(order).alias("order"), F.count(F.lit(1)).alias("n"), *[F.min_by(f"u.{c}", order).alias(c) for c in ("label", "ref", "head")])


def merge_commit_artifacts(artifacts: DataFrame, columns: list[str] | None = None, tasks: int | None = None, crowded: bool | None = None) -> MergedCommits:
    """One artifact per commit however many clones reported it: heads with ``columns``, and bridges of all its clones say.

    A commit may be cloned without limit, so nothing gathers all copies: heads are the first clone's, events, references
    and targets are distinct rows, and of the files the first eight are shown. Whether a commit crowds a task is counted,
    unless the caller knows.
    """
    wanted = columns or [c for c in ARTIFACT_COLUMNS if c not in ("id", "source_event_ids", "source_refs")]
    tasks = tasks or int(artifacts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if _crowded(artifacts, tasks) if crowded is None else crowded:
        tasks = None
    units = _commit_units(artifacts, list(dict.fromkeys([*wanted, "title", "result"])), False, tasks)
    ranked = units.withColumn("rank", F.row_number().over(Window.partitionBy("id", "part").orderBy("order", "key")))
    of = lambda *parts: F.col("part").isin(*parts)
    places = range(1, fv.COMMIT_FILES_SHOWN + 1)
    merged = ranked.groupBy("id").agg(
        F.max(F.when(of(_HEAD), F.col("n"))).alias("clones"), F.first(F.when(of(_HEAD), F.col("head")), True).alias("h"),
        *[F.count_if(of(*parts)).alias(n) for n, parts in {"files": [_FILE], "refs": [_FILE, _OTHER], "targets": [_TARGET], "events": [_EVENT]}.items()],
        *[F.max(F.when(of(_FILE) & (F.col("rank") == i), F.col("label"))).alias(f"_{i}") for i in places],
    )
    retold = _commit_result(F.col("h.title"), F.col("files"), F.array(*[F.col(f"_{i}") for i in places]))
    result = F.when(F.col("clones") > 1, retold).otherwise(F.col("h.result"))
    heads = merged.select("id", "clones", "files", "refs", "targets", "events", *[result.alias(c) if c == "result" else F.col(f"h.{c}") for c in wanted])
    told = _commit_units(artifacts, ["title"], True, tasks)
    none = F.lit(None).cast("string")
    targets = told.where(of(_TARGET)).select(
        "id", "key", F.lit("git-commit").alias("type"), F.coalesce(blank_to_null(F.col("label")), F.lit("Git 提交")).alias("label"), "ref.path",
        none.alias("url"), _hash_of_id().alias("hash"), F.lit("independent").alias("attribution"))
    return MergedCommits(
        heads, artifacts.select("id", F.explode("source_event_ids").alias("event_id")).distinct(), told.where(of(_FILE, _OTHER)).select("id", "ref.*"), targets)


def wiki_artifacts(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Knowledge events whose note exists, with the note's conclusion as result."""
    rows = events.where(F.col("kind").isin(*fv.KNOWLEDGE_KINDS)).withColumn("path", note_path())
    joined = rows.join(docs.select("path", wiki_conclusion(F.col("content")).alias("conclusion")), "path")
    none = F.array().cast("array<string>")
    return _artifact(
        joined, id=F.concat(F.lit("artifact:"), F.coalesce("object_key", "id")), kind=F.lit("knowledge-note"),
        problem=F.lit(None).cast("string"), result=F.col("conclusion"), validation=F.array(F.lit("知识笔记已存在于当前 Vault。")),
        limitations=F.when(F.col("confidence") == "inferred", F.array("evidence")).otherwise(none), proof=F.lit("independent"),
        source_event_ids=F.array("id"),
    )


def reported_targets(reports: DataFrame, inventory: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(id, type, target): reported files that exist, among the first 24 named, and the first 12 URLs."""
    paths = reports.select(key, F.explode(F.slice(extract_paths(F.col(content)), 1, 24)).alias("target"))
    there = paths.join(inventory.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    urls = reports.select(key, F.explode(F.slice(extract_urls(F.col(content)), 1, 12)).alias("target"))
    return there.select(key, F.lit("local-file").alias("type"), "target").unionByName(
        urls.select(key, F.lit("url").alias("type"), "target")
    )


def report_artifacts(events: DataFrame, stops: DataFrame, inventory: DataFrame, problems: DataFrame) -> DataFrame:
    """Artifacts of reported completions whose final answer states the completion directly.

    ``stops`` are answer records, ``problems`` the result of ``turn_problem`` (id, problem).
    """
    turn = ["session_id", "turn_id"]
    last = stops.where(F.col("event") == "Stop").groupBy(*turn).agg(
        F.max_by(F.struct("event_id", "content"), F.struct("captured_at", "event_id")).alias("stop")
    )
    done = events.where((F.col("kind") == "task_completed") & (F.col("confidence") == "reported"))
    rows = done.join(last, turn).where(has_direct_completion(F.col("stop.content")))
    rows = rows.join(problems.select("id", F.col("problem").alias("asked")), "id", "left").withColumn("content", F.col("stop.content"))
    targets = reported_targets(rows.select("id", "content"), inventory).where(F.col("type") == "local-file")
    rows = rows.join(targets.select("id", F.lit(True).alias("has_file")).distinct(), "id", "left")
    body = F.array_join(report_section(F.col("content")), "\n")
    found = F.coalesce("has_file", F.lit(False))
    return _artifact(
        rows, id=F.concat_ws(":", F.lit("artifact:report"), F.coalesce("session_id", F.lit("unknown")), "turn_id"),
        kind=F.when(found, "file-deliverable").otherwise("completion-report"), problem=sanitize_text(F.col("asked")),
        result=F.coalesce(blank_to_null(result_summary(F.col("content"))), blank_to_null(sanitize_text(F.col("content"))), F.col("summary")),
        validation=let(sentences(body), lambda s: matching_lines(s, fv.REPORT_VALIDATION)),
        limitations=let(sentences(body), lambda s: matching_lines(s, fv.REPORT_LIMITATION)),
        proof=F.when(found, "target-present").otherwise("report-only"), source_event_ids=F.array("id", "stop.event_id"),
    )


def attach_reports_to_commits(reports: DataFrame, commits: DataFrame, text: str = "result") -> DataFrame:
    """(report_id, commit_id, hash) where a report names exactly one known commit by hash prefix.

    Commits of one hash count as one row with their number, and every prefix is looked up once, however many reports say
    it: the join is on the first seven characters, with the rest checked behind it. ``commits`` has (commit_id, hash).
    """
    named = reports.select(F.col("id").alias("report_id"), F.explode(F.array_distinct(F.transform(
        extract_all(F.col(text), fv.REPORT_COMMIT_HASH), F.lower))).alias("prefix"))
    sought = named.select("prefix").distinct().withColumn("short", F.substring("prefix", 1, 7))
    known = commits.groupBy(F.lower("hash").alias("hash")).agg(F.min("commit_id").alias("commit_id"), F.max("commit_id").alias("last"))
    known = known.withColumn("one", F.col("commit_id") == F.col("last")).withColumn("short", F.substring("hash", 1, 7))
    at = F.struct("commit_id", "hash")
    met = sought.join(known, "short").where(F.startswith("hash", "prefix")).groupBy("prefix").agg(
        F.min(at).alias("c"), (F.bool_and("one") & (F.count(F.lit(1)) == 1)).alias("one"))
    # A report may say several prefixes: all that are known must be of the same single commit.
    return named.join(met, "prefix").groupBy("report_id").agg(
        F.min("c").alias("c"), F.max("c").alias("last"), F.bool_and("one").alias("one")
    ).where(F.col("one") & (F.col("c") == F.col("last"))).select("report_id", "c.commit_id", "c.hash")


#: Columns of an artifact that have one value; what may be many stays in bridges.
HEAD_COLUMNS = [c for c in ARTIFACT_COLUMNS if c not in ("validation", "limitations", "source_event_ids", "source_refs")]


@dataclass
class Artifacts:
    """Artifacts as tables: heads, and bridges of what each of them says, comes from and refers to."""

    heads: DataFrame  # HEAD_COLUMNS
    lines: DataFrame  # (id, field, value, place): validation and limitation lines; ``place`` orders them
    events: DataFrame  # (id, event_id)
    refs: DataFrame  # (id, type, label, path, url, line, excerpt)


def artifact_tables(artifacts: DataFrame) -> Artifacts:
    """Rows with arrays, each id once, as tables."""
    line = lambda field, column: artifacts.select(
        "id", F.lit(field).alias("field"), F.posexplode(column).alias("pos", "value")
    ).select("id", "field", "value", F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit("").alias("report"), "pos").alias("place"))
    return Artifacts(
        artifacts.select(*HEAD_COLUMNS), line("validation", "validation").unionByName(line("limitation", "limitations")),
        artifacts.select("id", F.explode("source_event_ids").alias("event_id")).distinct(),
        artifacts.select("id", F.explode("source_refs").alias("ref")).select("id", "ref.*").distinct(),
    )


def commit_tables(made: DataFrame, tasks: int | None = None) -> Artifacts:
    """Commit artifacts as tables, clones of a commit merged; every clone's references stay.

    Merged heads are written, since many tables read them; bridges are read from ``made``, which takes none of its titles.
    """
    merged = merge_commit_artifacts(made, tasks=tasks)
    heads = cut_lineage(merged.heads, "commits", "zstd")
    none = {c: F.array().cast(made.schema[c].dataType) for c in ("source_event_ids", "source_refs")}
    refs = made.select("id", F.explode("source_refs").alias("ref")).select("id", "ref.*").distinct()
    return Artifacts(heads.select(*HEAD_COLUMNS), artifact_tables(heads.withColumns(none)).lines, merged.events, refs)


def fold_reports(commits: Artifacts, reports: DataFrame, attached: DataFrame) -> tuple[Artifacts, DataFrame]:
    """Commits with all that their reports told, and the reports that belong to no commit.

    The last report that states a problem gives the commit's. Report lines follow the commit's own, in the order of the
    reports; their events and references join the bridges, so a settlement that knows the report's event finds the commit.
    """
    told = reports.join(attached.select(F.col("report_id").alias("id"), "commit_id"), "id")
    said = lambda c: F.concat(F.lit(fv.REPORT_SAID), c)
    at = F.struct("occurred_at", "id")
    stated = F.when(F.coalesce("problem", F.lit("")) != "", at)
    problems = told.groupBy("commit_id").agg(F.max_by("problem", stated).alias("_stated")).withColumnRenamed("commit_id", "id")
    heads = commits.heads.join(problems, "id", "left").withColumn("problem", F.coalesce(said(F.col("_stated")), F.col("problem")))
    line = lambda field, values: told.select(
        F.col("commit_id").alias("id"), F.lit(field).alias("field"), F.col("occurred_at").alias("at"), F.col("id").alias("report"), F.posexplode(values).alias("pos", "value")
    ).select("id", "field", "value", F.struct("at", "report", "pos").alias("place"))
    delivered = F.array(F.concat(F.lit(fv.REPORT_DELIVERED), "result"))
    lines = commits.lines.unionByName(line("validation", F.concat(delivered, F.transform("validation", said)))).unionByName(
        line("limitation", F.transform("limitations", said)))
    lines = lines.where(F.col("value").isNotNull()).groupBy("id", "field", "value").agg(F.min("place").alias("place"))
    events = commits.events.unionByName(told.select(F.col("commit_id").alias("id"), F.explode("source_event_ids").alias("event_id"))).distinct()
    refs = commits.refs.unionByName(told.select(F.col("commit_id").alias("id"), F.explode("source_refs").alias("ref")).select("id", "ref.*")).distinct()
    alone = reports.join(attached.select(F.col("report_id").alias("id")), "id", "left_anti")
    return Artifacts(heads.select(*HEAD_COLUMNS), lines, events, refs), alone


def union_tables(*tables: Artifacts) -> Artifacts:
    """Tables with different ids as one."""
    return Artifacts(*[reduce(DataFrame.unionByName, [getattr(t, f.name) for t in tables]) for f in dataclass_fields(Artifacts)])


def fingerprints(artifacts: DataFrame, columns: list[str]) -> DataFrame:
    return artifacts.withColumn("fingerprint", ids.fingerprint(*[F.col(c) for c in columns]))


# --- names, notes and the managed table ----------------------------------------------------------
def assign_unique_names(df: DataFrame, owned: DataFrame | None = None, limit: int = 99, bucket: list[str] | None = None) -> DataFrame:
    """Readable, unique names per day: ``title``, ``title（2）``, …; a name already owned stays.

    ``owned`` is (id, owned_name, local_date). Names taken by owners are left out of the numbering. Rows
    that find no name within ``limit`` get null, as the reference refuses them. No more than ``limit``
    rows of a day and title can be named, so ranks beyond it never reach the window's shuffle.
    """
    keys = bucket or ["local_date"]
    rows = df.withColumn("base_name", readable_file_title(F.col("title")))
    group = [*keys, "base_name"]
    if owned is None:
        rows = rows.withColumn("owned_name", F.lit(None).cast("string"))
        taken = None
    else:
        mine = owned.select("id", *keys, "owned_name")
        rows = rows.join(mine, ["id", *keys], "left")
        number = F.when(F.col("owned_name") == F.col("base_name"), 1).otherwise(
            F.regexp_extract("owned_name", "（(\\d+)）$", 1).try_cast("int")
        )
        stem = F.regexp_replace("owned_name", "（\\d+）$", "")
        valid = (F.col("owned_name") == F.col("base_name")) | ((stem == F.col("base_name")) & number.between(2, limit))
        rows = rows.withColumn("owned_name", F.when(F.coalesce(valid, F.lit(False)), F.col("owned_name")))
        taken_rows = mine.select(*keys, stem.alias("base_name"), number.alias("n")).where(F.col("n").between(1, limit))
        plain = mine.select(*keys, F.col("owned_name").alias("base_name"), F.lit(1).alias("n"))
        taken = taken_rows.unionByName(plain).distinct()
    named = rows.where(F.col("owned_name").isNotNull()).withColumn("name", F.col("owned_name"))
    fresh = rows.where(F.col("owned_name").isNull())
    ranked = first_rows(fresh, group, ["id"], limit, rank="rank")
    numbers = fresh.select(*group).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(limit))))
    if taken is not None:
        numbers = numbers.join(taken, [*group, "n"], "left_anti")
    free = numbers.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("n")))  # at most ``limit`` rows a group
    suffix = F.when(F.col("n") == 1, F.col("base_name")).otherwise(F.concat("base_name", F.lit("（"), F.col("n").cast("string"), F.lit("）")))
    given = ranked.join(free, [*group, "rank"], "left").withColumn("name", suffix).select("id", *keys, "name")
    rest = fresh.join(given, ["id", *keys], "left")
    return named.unionByName(rest).drop("owned_name")


def sync_managed(current: DataFrame, managed: DataFrame) -> DataFrame:
    """Desired against managed rows by path: write, unchanged, conflict or stale, one full outer join.

    Both sides are (path, id, fingerprint); a path held by another id is refused.
    """
    a, b = current.alias("a"), managed.alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    action = (
        F.when(F.col("a.path").isNull(), "stale")
        .when(F.col("b.path").isNull(), "write")
        .when(F.col("a.id") != F.col("b.id"), "conflict")
        .when(F.col("a.fingerprint") == F.col("b.fingerprint"), "unchanged")
        .otherwise("write")
    )
    return joined.select(
        F.coalesce("a.path", "b.path").alias("path"), F.coalesce("a.id", "b.id").alias("id"), action.alias("action"),
        F.coalesce("a.fingerprint", "b.fingerprint").alias("fingerprint"),
    )


def next_managed(plan: DataFrame, managed: DataFrame) -> DataFrame:
    """The managed table after a sync: written and unchanged rows, stale ones kept and marked."""
    kept = plan.where(F.col("action") != "conflict").select("path", "id", "fingerprint", (F.col("action") == "stale").alias("stale"))
    refused = plan.where(F.col("action") == "conflict").select("path")
    own = managed.join(refused, "path", "left_semi").select("path", "id", "fingerprint", F.lit(False).alias("stale"))
    return kept.unionByName(own)


def daily_artifact_index(artifacts: DataFrame, managed_dates: DataFrame | None = None) -> DataFrame:
    """Index lines of each day: (local_date, project_label, occurred_at, id, line), empty days included.

    A day's index is these rows in (project, newest first, id) order. They stay rows — a day may hold a
    third of everything — and ``write_pages`` sorts and writes them without gathering a day.
    """
    line = F.concat(F.lit("- "), "title", F.lit(" · "), choose(F.col("proof"), fv.PROOF_LABELS))
    first = F.get(non_empty(F.transform(lines_of(F.col("result")), trim_ws)), F.lit(0))
    rows = artifacts.select(
        "local_date", "project_label", "occurred_at", "id",
        F.concat(line, F.lit("\n  - "), F.coalesce(first, F.lit("暂无摘要"))).alias("line"),
    )
    if managed_dates is None:
        return rows
    empty = managed_dates.select("local_date").distinct().join(artifacts.select("local_date").distinct(), "local_date", "left_anti")
    none = F.lit(None).cast("string")
    return rows.unionByName(empty.select(
        "local_date", none.alias("project_label"), F.lit(None).cast("timestamp").alias("occurred_at"), none.alias("id"),
        F.lit("当天没有当前快照中的成果条目。").alias("line"),
    ))


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"annotations", "head_chars"}]
