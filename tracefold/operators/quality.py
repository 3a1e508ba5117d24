"""Rules over documents and tables: each gives a table of violations or findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.notes import event_ids_in, front_matter, front_matter_list, has_section, heading_title, links_to, section
from tracefold.functions.text import collapse_ws, extract_all, holds_any, lines_of, redact, trim_ws


def violations(df: DataFrame, key: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per broken rule; a rule is (name, test that is true when it holds)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]), lambda r: r.isNotNull())
    return df.select(*key, F.explode(broken).alias("rule"))


# --- knowledge documents -------------------------------------------------------------------------
def validate_evidence(docs: DataFrame, expected: DataFrame, existing: DataFrame | None = None, prefix: str = "tracefold") -> DataFrame:
    """Broken rules of evidence pages (path, content, memory_path).

    ``expected`` is the bridge (path, event_id) of the contract. With ``existing`` (path, content), ids a
    page already declared must stay, and its stable id may not change. Event sets are compared as rows.
    """
    content = F.col("content")
    rows = docs
    if existing is None:
        rows = rows.withColumn("_old", F.lit(None).cast("string"))
    else:
        rows = rows.join(existing.select("path", F.col("content").alias("_old")), "path", "left")
    stable, before = front_matter(content, f"{prefix}_wiki_id"), front_matter(F.col("_old"), f"{prefix}_wiki_id")
    rules = [
        ("title", heading_title(content).isNotNull()),
        ("stable-id", (stable != "") & (F.col("_old").isNull() | (before == stable))),
        ("document-type", front_matter(content, f"{prefix}_document") == "evidence"),
        ("memory-link", links_to(content, F.col("memory_path"))),
        ("projects", F.size(front_matter_list(content, "projects")) > 0),
        *[(f"section:{h}", has_section(content, h)) for h in fv.EVIDENCE_HEADINGS],
        ("last-verified", content.rlike(r"(?m)^last_verified:\s*\d{4}-\d{2}-\d{2}\s*$")),
        ("trust", content.rlike(r"(?m)^trust:\s*(?:verified|observed|inferred)\s*$")),
    ]
    out = violations(rows, ["path"], rules)
    named = rows.select("path", F.explode(event_ids_in(content)).alias("event_id"))
    kept = rows.where(F.col("_old").isNotNull()).select("path", F.explode(event_ids_in(F.col("_old"))).alias("event_id"))
    wanted = expected.select("path", "event_id").unionByName(kept).distinct()
    differ = wanted.exceptAll(named).unionByName(named.exceptAll(wanted)).select("path").distinct()
    return out.unionByName(differ.select("path", F.lit("source-events").alias("rule")))


def validate_memory(docs: DataFrame, prefix: str = "tracefold", min_chars: int = 650, max_chars: int = 8000) -> DataFrame:
    """Broken rules of experience notes (path, content)."""
    content = F.col("content")
    title = heading_title(content)

    def told(heading: str) -> Column:
        least = 12 if heading == fv.MEMORY_TRACE_HEADING else 40
        return F.length(F.regexp_replace(section(content, heading), r"\s+", "")) >= least

    def prose(heading: str) -> Column:
        lines = F.transform(lines_of(section(content, heading)), trim_ws)
        return F.exists(lines, lambda l: (F.length(l) >= 40) & ~l.rlike(r"^(?:[-*+]\s|\d+[.)、]\s?)"))

    main_headings = [h for h in fv.MEMORY_HEADINGS if h != fv.MEMORY_TRACE_HEADING]
    main = F.concat_ws("\n", *[section(content, h) for h in main_headings])
    code_like = F.size(extract_all(main, rf"({fv.CAMEL_WORD}|`[^`]+`)"))
    rules = [
        ("natural-title", title.isNotNull() & ~title.rlike(rf"#\d+|{fv.CAMEL_WORD}")),
        ("front-matter", (front_matter(content, f"{prefix}_memory_id") != "") & (front_matter(content, f"{prefix}_document") == "memory")
         & front_matter(content, "last_reviewed").rlike(r"^\d{4}-\d{2}-\d{2}$")),
        ("projects", F.size(front_matter_list(content, "projects")) > 0),
        *[(f"section:{h}", told(h)) for h in fv.MEMORY_HEADINGS],
        *[(f"prose:{h}", prose(h)) for h in main_headings],
        ("length", F.length(content).between(min_chars, max_chars)),
        ("date-line", content.rlike(r"(?m)^>\s*\*\*发生时间\*\*[：:]\s*\d{4}-\d{2}-\d{2}")),
        ("no-code", ~main.rlike(r"(?i)```|(?:UserPromptSubmit|Stop):[0-9a-f]{32,}")),
        ("few-identifiers", code_like <= 6),
        ("plain-words", ~main.rlike(fv.JARGON)),
    ]
    return violations(docs, ["path"], rules)


def document_shape(docs: DataFrame, key: str = "path", min_chars: int = 650, max_chars: int = 8000, prose_chars: int = 40) -> DataFrame:
    """The rules of ``validate_memory`` that any text has: length, a prose line, few identifiers."""
    content = F.col("content")
    lines = F.transform(lines_of(content), trim_ws)
    rules = [
        ("length", F.length(content).between(min_chars, max_chars)),
        ("prose", F.exists(lines, lambda l: (F.length(l) >= prose_chars) & ~l.rlike(r"^(?:[-*+]\s|\d+[.)、]\s?)"))),
        ("few-identifiers", F.size(extract_all(content, rf"({fv.CAMEL_WORD}|`[^`]+`)")) <= 6),
    ]
    return violations(docs, [key], rules)


def validate_digest(rows: DataFrame, key: str = "id") -> DataFrame:
    """Broken rules of digests (about, problem, result, next_use)."""
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), trim_ws(collapse_ws(F.coalesce(F.col(n), F.lit("")))).alias("text")) for n in fv.DIGEST_LABELS]))
    long = rows.select(key, parts.alias("p")).select(key, "p.field", "p.text")
    text = F.col("text")
    rules = [
        ("length", F.length(text).between(18, 320)),
        ("specific", ~(text.rlike(fv.VAGUE_DIGEST[0]) | text.rlike(fv.VAGUE_DIGEST[1]))),
        ("no-narrator", (F.col("field") != "about") | ~text.rlike(fv.NARRATOR_DIGEST)),
        ("plain-words", ~text.rlike(fv.JARGON)),
    ]
    return violations(long, [key, "field"], rules)


def unique_key_violations(docs: DataFrame, key: Column, name: str = "path") -> DataFrame:
    """(key, copies, first): keys more than one document uses. A grouped count, whatever the number of copies."""
    rows = docs.select(F.col(name), key.alias("key")).where(F.coalesce(key, F.lit("")) != "")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("first")).where(F.col("copies") > 1)


# --- secrets and personal data -------------------------------------------------------------------
def scan_sensitive(docs: DataFrame, key: str = "doc_id", text: str = "text", denied: list[str] | None = None) -> DataFrame:
    """Findings (key, rule, position, found): denied literals, secret patterns, foreign e-mail and IPv4 addresses.

    One pass per row, all rules as one array: the text is read once and nothing is shuffled.
    """
    body = F.col(text)

    def grouped(pattern: str) -> str:
        return f"(?i)({pattern[4:]})" if pattern.startswith("(?i)") else f"({pattern})"

    def found_by(rule: str, values: Column) -> Column:
        return F.transform(values, lambda f: F.struct(F.lit(rule).alias("rule"), f.alias("found")))

    rows = docs.select(key, text, F.lower(body).alias("_lower"))
    none = F.array().cast("array<string>")

    def matches(rule: str, pattern: str) -> Column:
        return F.when(holds_any(F.col("_lower"), fv.SCAN_HINTS[rule]), extract_all(body, grouped(pattern))).otherwise(none)

    hits = [found_by(rule, matches(rule, pattern)) for rule, pattern in fv.SCAN_SECRETS]
    mails = F.filter(matches("email", fv.EMAIL), lambda m: ~F.lower(m).endswith(fv.EMAIL_RESERVED_SUFFIX))
    hosts = F.filter(matches("ipv4", fv.IPV4), lambda a: a != fv.IPV4_LOOPBACK)
    hits += [found_by("email", mails), found_by("ipv4", hosts)]
    for literal in denied or []:
        found = F.when(F.contains(body, F.lit(literal)), F.array(F.struct(F.lit("denied").alias("rule"), F.lit(literal).alias("found"))))
        hits.append(F.coalesce(found, F.array().cast("array<struct<rule:string,found:string>>")))
    return rows.select(key, F.posexplode(F.concat(*hits)).alias("position", "hit")).select(key, "position", "hit.rule", "hit.found")


def redaction_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts that redaction changes: hits per rule and lengths before and after."""
    body = F.col(text)
    lowered = F.lower(body)
    counts = [
        F.when(holds_any(lowered, fv.REDACTION_HINTS[rule]), F.regexp_count(body, F.lit(pattern))).otherwise(0).alias(rule)
        for rule, pattern, _ in fv.REDACTIONS
    ]
    rows = docs.select(key, body.alias("_body"), redact(body).alias("_clean"), *counts)
    changed = rows.where(F.col("_clean") != F.col("_body"))
    return changed.select(
        key, F.length("_body").alias("chars_before"), F.length("_clean").alias("chars_after"), *[rule for rule, _, _ in fv.REDACTIONS]
    )
