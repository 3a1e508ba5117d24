"""Notes shared between a generator and a person: rendering, and merging new text into what is stored.

A managed note has front matter, one generated block and one user block, each between markers that stand on lines of their
own. A merge replaces the generated block and the managed front-matter keys and touches nothing else. Files that are not
managed notes, or are damaged, or belong to another id, are refused and stay as they are.

Everything is column algebra over one text column, so a table of notes is merged by one join on the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.text import blank_to_null, choose, lines_of, non_empty, trim_ws

PREFIX = "tracefold"


# --- text that may stand in a note ---------------------------------------------------------------
def markdown_text(value: Column) -> Column:
    """Source text that can neither open markup nor a marker."""
    return trim_ws(F.regexp_replace(value, "[<>]", ""))


def inline_text(value: Column) -> Column:
    return trim_ws(F.regexp_replace(F.regexp_replace(markdown_text(value), r"[\r\n|]", " "), r"\s+", " "))


def wikilink_text(value: Column) -> Column:
    return trim_ws(F.regexp_replace(F.regexp_replace(inline_text(value), r"[\[\]#^]", " "), r"\s+", " "))


def inline_code(value: Column) -> Column:
    return trim_ws(F.regexp_replace(F.replace(value, F.lit("`"), F.lit("'")), r"[\r\n]", " "))


def safe_url(value: Column) -> Column:
    return F.when(value.rlike(r"(?i)^https?://"), F.regexp_replace(value, r"[<>\s]", "")).otherwise("")


def yaml_string(value: Column) -> Column:
    """A JSON string on one line."""
    listed = F.to_json(F.array(F.regexp_replace(value, r"[\r\n]", " ")))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def yaml_array(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, yaml_string), ", "), F.lit("]"))


def legacy_alias(note_id: Column) -> Column:
    return F.concat(F.lit(fv.LEGACY_ALIAS), F.substring(F.sha2(note_id, 256), 1, 12))


# --- rendering -----------------------------------------------------------------------------------
def _bullets(lines: Column, fallback: Column) -> Column:
    listed = F.array_join(F.transform(lines, lambda l: F.concat(F.lit("- "), inline_text(l))), "\n")
    return F.when(F.size(lines) > 0, listed).otherwise(F.concat(F.lit("- "), fallback))


def _without_md(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md$", "")


def _source(r: Column) -> Column:
    linked = r["type"].isin("wiki", "codex", "chatgpt", "feishu") & r["path"].endswith(".md") & ~r["path"].rlike(r"^[A-Za-z]:[\\/]")
    place = F.concat(F.coalesce(r["path"], F.lit("")), F.when(r["line"] > 0, F.concat(F.lit(":"), r["line"].cast("string"))).otherwise(""))
    plain = F.concat(inline_text(r["label"]), F.when(place != "", F.concat(F.lit("：`"), inline_code(place), F.lit("`"))).otherwise(""))
    return F.concat(F.lit("- "), F.when(F.coalesce(linked, F.lit(False)), F.concat(F.lit("[["), _without_md(r["path"]), F.lit("|"), wikilink_text(r["label"]), F.lit("]]")))
        .when(F.coalesce(r["url"], F.lit("")) != "", F.concat(F.lit("["), inline_text(r["label"]), F.lit("]("), safe_url(r["url"]), F.lit(")"))).otherwise(plain))


def _target(t: Column) -> Column:
    said = F.when(t["attribution"] == "reported", F.lit(fv.REPORTED_MARK)).otherwise("")
    place = F.coalesce(t["hash"], t["path"], t["url"], t["key"])
    return F.concat(
        F.lit("- "),
        F.when((t["type"] == "vault-note") & t["path"].isNotNull(), F.concat(F.lit("[["), _without_md(t["path"]), F.lit("|"), wikilink_text(t["label"]), F.lit("]]"), said))
        .when((t["type"] == "url") & t["url"].isNotNull(), F.concat(F.lit("["), inline_text(t["label"]), F.lit("]("), safe_url(t["url"]), F.lit(")"), said))
        .otherwise(F.concat(inline_text(t["label"]), said, F.lit("：`"), inline_code(place), F.lit("`"))),
    )


def _listed(items: Column, line, fallback: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n")).otherwise(fallback)


def render_artifact_notes(artifacts: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(id, local_date, markdown): front matter, generated block, empty user block.

    ``targets`` (key, type, label, path, url, hash, attribution), where that column is there, are the real entrances.
    """
    paragraphs = lambda c: F.array_join(F.transform(non_empty(F.transform(lines_of(c), trim_ws)), markdown_text), "\n\n")
    h, none = fv.NOTE_HEADINGS, fv.NOTE_FALLBACKS
    if "targets" in artifacts.columns:
        targets = F.coalesce("targets", F.array().cast(artifacts.schema["targets"].dataType))
        primary = F.filter(targets, lambda t: t["type"].isin("git-commit", "vault-note"))
        keys = F.transform(F.slice(F.when(F.size(primary) > 0, primary).otherwise(targets), 1, fv.TARGET_KEYS), lambda t: t["key"])
        entrances = _listed(targets, _target, none["targets"])
    else:
        keys, entrances = F.array().cast("array<string>"), F.lit(none["targets"])
    front = [
        F.lit("---"), F.lit(f"{prefix}_schema: 1"), F.lit(f"{prefix}_generated: true"), F.lit(f"cssclasses: [{prefix}-artifact-note]"),
        F.concat(F.lit("aliases: "), yaml_array(F.array(legacy_alias(F.col("id"))))), F.concat(F.lit(f"{prefix}_id: "), yaml_string(F.col("id"))),
        F.concat(F.lit(f"{prefix}_fingerprint: "), yaml_string(F.col("fingerprint"))), F.lit(f"{prefix}_stale: false"),
        F.concat(F.lit("date: "), F.col("local_date").cast("string")), F.concat(F.lit("project: "), yaml_string(F.col("project_label"))),
        F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("proof: "), "proof"), F.lit("curation: auto"),
        F.concat(F.lit("source_event_ids: "), yaml_array(F.col("source_event_ids"))), F.concat(F.lit("target_keys: "), yaml_array(keys)),
        F.lit("---"), F.lit(""),
    ]
    limits = F.when(F.col("proof") == "independent", none["limits_independent"]).otherwise(none["limits"])
    section = lambda name: [F.lit(""), F.lit(h[name]), F.lit("")]
    body = [
        F.lit(marker(prefix, "generated:start")), F.concat(F.lit("# "), markdown_text(F.col("title"))), F.lit(""),
        F.concat(F.lit("> "), choose(F.col("proof"), fv.PROOF_LABELS), F.lit(" · "), choose(F.col("kind"), fv.KIND_LABELS), F.lit(fv.AUTO_MARK)),
        *section("problem"), F.coalesce(blank_to_null(paragraphs(F.col("problem"))), F.lit(none["problem"])),
        *section("result"), F.coalesce(paragraphs(F.col("result")), F.lit("")),
        *section("validation"), _bullets(F.col("validation"), F.lit(none["validation"])),
        *section("targets"), entrances,
        *section("sources"), _listed(F.col("source_refs"), _source, none["sources"]),
        *section("limits"), _bullets(F.col("limitations"), limits), F.lit(marker(prefix, "generated:end")), F.lit(""),
        F.lit(marker(prefix, "user:start")), F.lit(h["user"]), F.lit(""), F.lit(marker(prefix, "user:end")), F.lit(""),
    ]
    return artifacts.select("id", "local_date", F.array_join(F.array(*front, *body), "\n").alias("markdown"))


# --- reading -------------------------------------------------------------------------------------
def marker(prefix: str, part: str) -> str:
    return f"<!-- {prefix}-{part} -->"


def legacy_marker(prefix: str, part: str) -> str:
    return f"%% {prefix}-{part} %%"


def _count(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def _value(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]


def _scalar(value: Column) -> Column:
    """A front-matter scalar: a JSON string, or the text itself."""
    quoted = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
    return F.coalesce(F.when(value.startswith('"'), quoted).otherwise(value), F.lit(""))


def parse_notes(notes: DataFrame, text: str = "markdown", prefix: str = PREFIX, out: str = "note") -> DataFrame:
    """Adds a struct: whether the text is a managed note (``managed``), its parts and its metadata.

    ``head`` is the front matter with its fences; ``lines`` and ``entries`` are what it holds; ``before``, ``block`` and
    ``after`` are the text up to the generated block, the block with its markers, and the rest with the user block.
    """
    body = F.col(text)
    rows = notes.withColumn("_head", F.regexp_extract(body, r"(?s)\A(---\r?\n(?:.*?\n)??---[ \t]*)(?=\r?\n|\r?\z)", 1))
    lines = F.split("_head", r"\r?\n")
    rows = rows.withColumn("_lines", F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))))
    key = r"^([A-Za-z0-9_-]+):"
    rows = rows.withColumn("_entries", F.transform(
        F.filter("_lines", lambda l: l.rlike(key)),
        lambda l: F.struct(F.regexp_extract(l, key, 1).alias("key"), trim_ws(F.regexp_extract(l, key + r"[ \t]*(.*)$", 2)).alias("value")),
    ))
    ok = (F.col("_head") != "") & (F.size("_entries") == F.size(F.array_distinct(F.transform("_entries", lambda e: e["key"]))))
    places = {}
    for part in ("generated", "user"):
        now = [marker(prefix, f"{part}:{side}") for side in ("start", "end")]
        old = [legacy_marker(prefix, f"{part}:{side}") for side in ("start", "end")]
        one = lambda here, other: (_count(body, here[0]) == 1) & (_count(body, here[1]) == 1) & (_count(body, other[0]) == 0) & (_count(body, other[1]) == 0)
        rows = rows.withColumn(f"_{part}", F.when(one(now, old), 1).when(one(old, now), 2).otherwise(0))
        for side, mark, other in (("start", now[0], old[0]), ("end", now[1], old[1])):
            chosen = F.when(F.col(f"_{part}") == 2, other).otherwise(mark)
            at = f"_{part}_{side}"
            rows = rows.withColumn(at, F.locate(mark, body) + F.when(F.col(f"_{part}") == 2, F.locate(other, body)).otherwise(0))
            after = F.col(at) + F.length(chosen)
            lone = ((F.col(at) == 1) | (F.substring(body, F.col(at) - 1, F.lit(1)) == "\n")) & (
                (after > F.length(body)) | (F.substring(body, after, F.lit(1)) == "\n") | (F.substring(body, after, F.lit(2)) == "\r\n"))
            places[at] = lone
            if side == "end":
                rows = rows.withColumn(f"_{part}_stop", after)
    order = ["_generated_start", "_generated_end", "_user_start", "_user_end"]
    for a, b in zip(order, order[1:], strict=False):
        ok &= F.col(b) > F.col(a)
    for lone in places.values():
        ok &= lone
    ok &= (F.col("_generated") > 0) & (F.col("_user") > 0) & (F.col("_generated_start") > F.length("_head") + 1)
    entry = lambda name: _value(F.col("_entries"), name)
    ok &= F.coalesce((entry(f"{prefix}_schema") == "1") & (entry(f"{prefix}_generated") == "true"), F.lit(False))
    date, kind = _scalar(entry("date")), _scalar(entry("kind"))
    rows = rows.withColumns({"_date": date, "_kind": kind, "_said": _scalar(entry(f"{prefix}_id"))})
    valid = F.col("_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr("try_to_date(_date, 'yyyy-MM-dd')").isNotNull()
    rows = rows.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    note_id = F.when(F.col("_said") != "", F.col("_said")).when((F.col("_kind") == fv.DAILY_KIND) & F.col("_valid"), F.concat(F.lit("daily:"), "_date")).otherwise("")
    rows = rows.withColumn("_id", note_id)
    ok &= F.col("_valid") & (F.col("_id") != "") & (F.col("_kind") != "")
    piece = lambda a, b: F.substring(body, a, b - a)
    block = piece(F.col("_generated_start"), F.col("_generated_stop"))
    heading = lambda c: F.trim(F.regexp_extract(c, r"(?m)^#\s+(.+?)\s*$", 1))
    before = piece(F.length("_head") + 1, F.col("_generated_start"))
    rows = rows.withColumns({"_block": block, "_before": before}).withColumn("_managed", F.coalesce(ok, F.lit(False)))
    title = F.when(F.col("_kind") != fv.DAILY_KIND, F.coalesce(blank_to_null(heading(F.col("_block"))), blank_to_null(heading(F.col("_before")))))
    parsed = F.struct(
        F.col("_managed").alias("managed"), F.col("_id").alias("id"), F.col("_date").alias("date"), F.col("_kind").alias("kind"),
        F.coalesce(entry(f"{prefix}_stale") == "true", F.lit(False)).alias("stale"), title.alias("title"), F.col("_head").alias("head"),
        F.col("_lines").alias("lines"), F.col("_entries").alias("entries"), F.col("_before").alias("before"), F.col("_block").alias("block"),
        F.substring(body, F.col("_generated_stop"), F.length(body)).alias("after"),
    )
    return rows.select(*notes.columns, parsed.alias(out))


def managed_metadata(notes: DataFrame, text: str = "markdown", prefix: str = PREFIX) -> DataFrame:
    """``notes`` that are managed, with note_id, date, kind, stale and title."""
    rows = parse_notes(notes, text, prefix).where("note.managed")
    return rows.select(*notes.columns, F.col("note.id").alias("note_id"), *[F.col(f"note.{c}").alias(f"note_{c}") for c in ("date", "kind", "stale", "title")])


# --- merging -------------------------------------------------------------------------------------
def _with_values(note: Column, updates: Column) -> Column:
    """The front matter of ``note`` with the values of ``updates`` (key, value): in place, or at its end."""
    given = lambda key: F.get(F.filter(updates, lambda u: u["key"] == key), F.lit(0))["value"]
    key_of = lambda l: F.regexp_extract(l, r"^([A-Za-z0-9_-]+):", 1)
    lines = F.transform(note["lines"], lambda l: F.coalesce(F.concat(key_of(l), F.lit(": "), given(key_of(l))), l))
    present = F.transform(note["entries"], lambda e: e["key"])
    more = F.transform(F.filter(updates, lambda u: ~F.array_contains(present, u["key"])), lambda u: F.concat(u["key"], F.lit(": "), u["value"]))
    fence = F.regexp_extract(note["head"], r"\A(---\r?\n)", 1)
    return F.concat(fence, F.array_join(F.concat(lines, more), "\n"), F.lit("\n"), F.regexp_extract(note["head"], r"(---[ \t]*)\z", 1))


def _aliases(note: Column) -> Column:
    listed = F.from_json(_value(note["entries"], "aliases"), "array<string>")
    return F.coalesce(F.filter(listed, lambda a: a.isNotNull()), F.array().cast("array<string>"))


def _current_markers(text: Column, prefix: str) -> Column:
    for part in ("generated:start", "generated:end", "user:start", "user:end"):
        text = F.replace(text, F.lit(legacy_marker(prefix, part)), F.lit(marker(prefix, part)))
    return text


def merged_text(stored: Column, desired: Column, prefix: str = PREFIX) -> Column:
    """Stored note with the generated block and the managed keys of the desired one."""
    keys = [k.replace("{prefix}", prefix) for k in fv.MANAGED_KEYS if k != "aliases"]
    updates = F.filter(
        F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.struct(k.alias("key"), F.get(F.filter(desired["entries"], lambda e: e["key"] == k), F.lit(0))["value"].alias("value"))),
        lambda u: u["value"].isNotNull(),
    )
    names = F.array_union(_aliases(stored), _aliases(desired))
    alias = F.when(F.size(names) > 0, F.array(F.struct(F.lit("aliases").alias("key"), yaml_array(names).alias("value")))).otherwise(
        F.array().cast("array<struct<key:string,value:string>>"))
    before = F.when(stored["before"].rlike(r"\A\s*# [^\r\n]+\s*\z"), "\n\n").otherwise(stored["before"])
    return _current_markers(F.concat(_with_values(stored, F.concat(updates, alias)), before, desired["block"], stored["after"]), prefix)


def stale_text(note: Column, prefix: str = PREFIX) -> Column:
    """Note marked as no longer produced: a notice at the head of its block, once, and the flag in its front matter."""
    opened = F.regexp_extract(note["block"], r"(?s)\A(<!-- [^\n]*? -->|%% [^\n]*? %%)", 1)
    rest = F.regexp_replace(F.substring(note["block"], F.length(opened) + 1, F.length(note["block"])), r"\A\r?\n?", "")
    block = F.when(F.contains(note["block"], F.lit(fv.STALE_NOTICE)), note["block"]).otherwise(F.concat(opened, F.lit("\n" + fv.STALE_NOTICE + "\n\n"), rest))
    flag = F.array(F.struct(F.lit(f"{prefix}_stale").alias("key"), F.lit("true").alias("value")))
    return _current_markers(F.concat(_with_values(note, flag), note["before"], block, note["after"]), prefix)


def merge_notes(desired: DataFrame, stored: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Desired notes against stored ones, both (path, markdown): (path, action, markdown, error), a row per path.

    ``write`` and ``unchanged`` carry the merged note; ``refused`` the stored text, untouched, and why. A managed note that
    is not desired any more is marked (``stale``; ``unchanged`` where it was); daily indexes and other people's files
    (``foreign``) stay as they are. Paths must be unique on each side.
    """
    new = parse_notes(desired.select("path", F.col("markdown").alias("wanted")), "wanted", prefix, "d")
    old = parse_notes(stored.select("path", F.col("markdown").alias("kept")), "kept", prefix, "e")
    rows = old.join(new, "path", "full_outer")
    d, e = F.col("d"), F.col("e")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    error = (
        F.when(F.col("wanted").isNull(), None)
        .when(F.col("kept").isNotNull() & ~is_(e["managed"]), fv.NOTE_ERRORS["foreign"])
        .when(~is_(d["managed"]), fv.NOTE_ERRORS["invalid"])
        .when(F.col("kept").isNotNull() & (d["id"] != e["id"]), fv.NOTE_ERRORS["other_id"])
    )
    rows = rows.withColumn("error", error)
    owned = is_(e["managed"]) & ~is_(e["id"].startswith("daily:"))
    text = (
        F.when(F.col("error").isNotNull(), F.col("kept"))
        .when(F.col("kept").isNull(), F.col("wanted"))
        .when(F.col("wanted").isNotNull(), merged_text(e, d, prefix))
        .when(owned, stale_text(e, prefix)).otherwise(F.col("kept"))
    )
    rows = rows.withColumn("markdown", text)
    same = F.col("markdown").eqNullSafe(F.col("kept"))
    action = (
        F.when(F.col("error").isNotNull(), "refused")
        .when(F.col("wanted").isNull() & ~is_(e["managed"]), "foreign").when(same, "unchanged")
        .when(F.col("wanted").isNull(), "stale").otherwise("write")
    )
    return rows.select("path", action.alias("action"), "markdown", "error")


def add_aliases(notes: DataFrame, aliases: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Notes (path, markdown) with a further alias (path, alias) in their front matter: (path, markdown, error)."""
    rows = parse_notes(notes.select("path", "markdown").join(aliases.select("path", inline_text(F.col("alias")).alias("alias")), "path"), prefix=prefix)
    note, alias = F.col("note"), F.col("alias")
    refused = ~note["managed"] | note["id"].startswith("daily:") | (F.coalesce(alias, F.lit("")) == "")
    known = F.array_contains(_aliases(note), alias)
    value = F.array(F.struct(F.lit("aliases").alias("key"), yaml_array(F.array_append(_aliases(note), alias)).alias("value")))
    text = F.concat(_with_values(note, value), note["before"], note["block"], note["after"])
    return rows.select(
        "path", F.when(refused | known, F.col("markdown")).otherwise(text).alias("markdown"), F.when(refused, fv.NOTE_ERRORS["no_alias"]).alias("error"),
    )
