"""Text expressions: trimming, titles, status classification, sanitising, redaction."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold import fixed_values as fv


def let(value: Column, body) -> Column:
    """Bind ``value`` to a name inside ``body``, so a costly expression is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def trim_ws(value: Column) -> Column:
    return F.btrim(value, F.lit(fv.WS_CHARS))


def rtrim_ws(value: Column) -> Column:
    return F.rtrim(value, F.lit(fv.WS_CHARS))


def holds_any(lowered: Column, literals: list[str]) -> Column:
    """Whether a lower-cased text holds one of some literals: a byte search, far cheaper than a pattern."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(literal)) for literal in literals])


def collapse_ws(value: Column) -> Column:
    return F.regexp_replace(value, f"{fv.WS}+", " ")


def truncate(value: Column, length: int) -> Column:
    cut = F.concat(rtrim_ws(F.substring(value, 1, length - 1)), F.lit("…"))
    return F.when(F.length(value) <= length, value).otherwise(cut)


def head_chars(value: Column, length: int) -> Column:
    return F.substring(value, 1, length)


def lines_of(value: Column) -> Column:
    return F.split(value, fv.LINE_BREAK)


def non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def extract(value: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when the pattern does not occur."""
    return blank_to_null(F.regexp_extract(value, pattern, group))


def extract_all(value: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(group))


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def nfkc(value: Column) -> Column:
    """Compatibility normal form. Spark has no such function; ASCII text never reaches Python."""
    return F.coalesce(_nfkc(F.when(value.rlike(r"[^\x00-\x7F]"), value)), value)


# --- titles and summaries ------------------------------------------------------------------------
def concise_title(content: Column, fallback: str) -> Column:
    untagged = F.regexp_replace(content, "<[^>]+>", " ")
    cleaned = non_empty(F.transform(lines_of(untagged), lambda l: trim_ws(F.regexp_replace(l, fv.LIST_MARK, ""))))
    return truncate(collapse_ws(F.coalesce(F.get(cleaned, F.lit(0)), F.lit(fallback))), 72)


def concise_summary(content: Column) -> Column:
    return truncate(trim_ws(collapse_ws(F.regexp_replace(content, "<[^>]+>", " "))), 180)


def first_line(content: Column, length: int = 72) -> Column:
    return head_chars(F.get(non_empty(F.transform(lines_of(content), trim_ws)), F.lit(0)), length)


def strip_copy_suffix(title: Column) -> Column:
    """Struct (title, numbered): the title without a trailing "(2)", "(3)" … and whether one was there."""
    normal = trim_ws(collapse_ws(nfkc(title)))
    stripped = trim_ws(F.regexp_replace(normal, fv.COPY_SUFFIX, ""))
    return F.struct(
        F.coalesce(blank_to_null(stripped), normal).alias("title"), (stripped != normal).alias("numbered")
    )


def normalized_title(title: Column) -> Column:
    value = F.regexp_replace(nfkc(title), fv.CONVENTIONAL_PREFIX, "")
    value = F.regexp_replace(value, fv.COPY_SUFFIX, "")
    return F.lower(trim_ws(collapse_ws(value)))


def title_tokens(title: Column) -> Column:
    return tokens_of(normalized_title(title))


def tokens_of(normalized: Column) -> Column:
    """Tokens of a title that is normalised already."""
    parts = F.split(normalized, r"[^a-z0-9一-鿿]+")
    kept = F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*fv.TITLE_STOP_WORDS))
    return F.array_distinct(kept)


# --- prompts -------------------------------------------------------------------------------------
def is_automation(content: Column) -> Column:
    return content.rlike(fv.AUTOMATION_PROMPT)


def meaningful_prompt(content: Column) -> Column:
    """The user's own request inside a captured prompt; null when the prompt carries none."""
    trimmed = trim_ws(content)
    nothing = is_automation(trimmed) | trimmed.startswith(fv.SUGGESTION_PREFIX)
    delegated = blank_to_null(trim_ws(F.regexp_extract(content, fv.DELEGATION_INPUT, 1)))
    comments = non_empty(F.transform(extract_all(trimmed, fv.BROWSER_COMMENT), trim_ws))
    browser = F.when(
        trimmed.startswith(fv.BROWSER_COMMENTS_PREFIX) & (F.size(comments) > 0), F.array_join(comments, "；")
    )
    has_marker = F.contains(content, F.lit(fv.REQUEST_MARKER))
    request = blank_to_null(trim_ws(F.substring_index(content, fv.REQUEST_MARKER, -1)))
    ambient_only = F.contains(content, F.lit(fv.AMBIENT_OPEN)) & ~F.contains(
        content, F.lit("My request for Codex")
    )
    cleaned = F.regexp_replace(F.regexp_replace(trimmed, fv.AMBIENT_BLOCK, ""), fv.MENTIONED_FILES_BLOCK, "")
    return (
        F.when(nothing, F.lit(None).cast("string"))
        .when(delegated.isNotNull(), delegated)
        .when(browser.isNotNull(), browser)
        .when(has_marker, request)
        .when(ambient_only, F.lit(None).cast("string"))
        .otherwise(blank_to_null(trim_ws(cleaned)))
    )


# --- reported status -----------------------------------------------------------------------------
def _unbold(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"^(?:\*\*|__)(?=\S)", ""), r"(?:\*\*|__)$", "")


def status_units(content: Column) -> Column:
    text = F.regexp_replace(content, "<[^>]*>", " ")
    return non_empty(
        F.transform(
            F.split(text, fv.SENTENCE_BREAK), lambda l: _unbold(trim_ws(F.regexp_replace(l, fv.UNIT_MARK, "")))
        )
    )


def is_direct_completion(line: Column) -> Column:
    return ~line.rlike(fv.CONTINUING_LINE) & line.rlike(fv.COMPLETION_LINE)


def is_boundary(line: Column) -> Column:
    return line.rlike(fv.BOUNDARY_LINE)


def _first_where(units: Column, test) -> Column:
    """1-based position of the first element that passes, 0 when none does."""
    return F.array_position(F.transform(units, test), F.lit(True)).cast("int")


def _asserted(units: Column, test) -> Column:
    """An element passes within the first four, and no boundary line stands at or before it."""
    head = F.slice(units, 1, 4)
    at = _first_where(head, test)
    stop = _first_where(head, is_boundary)
    return (at > 0) & ((stop == 0) | (stop > at))


def until_boundary(section: Column, boundary=is_boundary) -> Column:
    """Elements up to, not including, the first boundary after the first element."""
    at = F.array_position(F.transform(section, lambda l, i: (i > 0) & boundary(l)), F.lit(True)).cast("int")
    return F.when(at == 0, section).otherwise(F.slice(section, F.lit(1), F.greatest(at - 1, F.lit(0))))


def _completion_section(units: Column) -> Column:
    at = F.greatest(_first_where(units, is_direct_completion), F.lit(1))
    return F.when(_asserted(units, is_direct_completion), until_boundary(F.slice(units, at, F.lit(20))))


def has_direct_completion(content: Column) -> Column:
    return F.coalesce(let(status_units(content), lambda u: _asserted(u, is_direct_completion)), F.lit(False))


def classify_status(stop: Column) -> Column:
    """completed / blocked / progress as the final answer itself reports it."""
    verdict = let(
        status_units(stop),
        lambda u: F.when(_asserted(u, lambda l: l.rlike(fv.BLOCKED_LINE)), "blocked")
        .when(F.array_join(_completion_section(u), "\n").rlike(fv.COMPLETION_EVIDENCE), "completed")
        .otherwise("progress"),
    )
    return F.when(F.coalesce(stop, F.lit("")) == "", F.lit("progress")).otherwise(verdict)


# --- sanitising ----------------------------------------------------------------------------------
_SANITIZE = [
    (r"(?i)<oai-mem-citation>[\s\S]*?</oai-mem-citation>", ""),
    (r"<!--[\s\S]*?-->", ""),
    (r"<[^>]*>", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]|]+)\|?\]\]", "$1"),
    (r"(?im)^\s*::[a-z-]+\{.*\}\s*$", ""),
    (r"(?m)^\s*```[^\r\n]*$", ""),
    (r"(?m)^\s*---\s*$", ""),
]


def sanitize_text(content: Column, managed_marker: str = "tracefold") -> Column:
    """Markdown reduced to plain lines; ``managed_marker`` names the generator whose block marks are dropped."""
    rules = _SANITIZE + [(rf"(?im)^.*{managed_marker}-(?:generated|user).*$", "")]
    stripped = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, content)
    kept = non_empty(F.transform(lines_of(stripped), lambda l: trim_ws(F.regexp_replace(l, fv.UNIT_MARK, ""))))
    return trim_ws(F.array_join(kept, "\n"))


def normalize_whitespace(content: Column) -> Column:
    value = F.regexp_replace(content, r"\u00a0", " ")
    value = F.regexp_replace(value, r"[ \t]+\n", "\n")
    value = F.regexp_replace(value, r"\n[ \t]+", "\n")
    return trim_ws(F.regexp_replace(value, r"\n{3,}", "\n\n"))


def redact(content: Column, collab_ids: bool = False) -> Column:
    """Secrets replaced by masks, rule after rule; a rule runs only where its literals occur.

    Masks hold none of the literals, so looking for them in the original text is enough.
    """

    def masked(text: Column) -> Column:
        def apply(lowered: Column) -> Column:
            value = text
            for name, pattern, mask in fv.REDACTIONS:
                hit = holds_any(lowered, fv.REDACTION_HINTS[name])
                value = let(value, lambda v: F.when(hit, F.regexp_replace(v, pattern, mask)).otherwise(v))  # noqa: B023
            return value

        return let(F.lower(text), apply)

    value = let(content, masked)
    return F.regexp_replace(value, fv.COLLAB_ID, fv.COLLAB_ID_MASK) if collab_ids else value


# --- completion reports --------------------------------------------------------------------------
def report_units(content: Column) -> Column:
    clean = sanitize_text(content)
    return non_empty(F.transform(F.split(clean, fv.SENTENCE_BREAK), lambda l: _unbold(trim_ws(l))))


def report_section(content: Column) -> Column:
    """Lines of the direct completion section, cut at a prompt, discussion or follow-up boundary."""

    def cut(units: Column) -> Column:
        at = _first_where(units, is_direct_completion)
        section = until_boundary(F.slice(units, F.greatest(at, F.lit(1)), F.lit(20)))
        label = _first_where(section, lambda l: l.rlike(fv.REPORT_BOUNDARY))
        kept = F.slice(section, F.lit(1), F.greatest(label - 1, F.lit(0)))
        edge = let(
            F.get(section, label - 1),
            lambda l: trim_ws(F.get(F.split(l, fv.REPORT_BOUNDARY), F.lit(0))),
        )
        return (
            F.when(at == 0, F.array().cast("array<string>"))
            .when(label == 0, section)
            .otherwise(F.concat(kept, F.filter(F.array(edge), lambda v: v != "")))
        )

    return let(report_units(content), cut)


def result_summary(content: Column) -> Column:
    picked = F.filter(
        report_section(content),
        lambda l, i: (i == 0)
        | l.rlike(fv.REPORT_COMMIT_LINE)
        | (
            ~l.rlike(fv.REPORT_SECTION_LABEL)
            & ~l.rlike(fv.REPORT_LIMITATION)
            & ~l.rlike(fv.REPORT_VALIDATION_SKIP)
        ),
    )
    return trim_ws(head_chars(F.array_join(F.slice(picked, 1, 6), "\n"), 1200))


def matching_lines(lines: Column, pattern: str, count: int = 8) -> Column:
    """First ``count`` distinct lines matching ``pattern``."""
    hits = F.filter(lines, lambda l: (l != "") & l.rlike(pattern))
    return F.slice(F.array_distinct(hits), 1, count)


def sentences(content: Column) -> Column:
    return F.transform(F.split(content, r"\r?\n|(?<=[。！？])"), trim_ws)


# --- keyed choice --------------------------------------------------------------------------------
def rank_of(value: Column, ranks: dict[str, int | float], default: int | float = 0) -> Column:
    expr = F.lit(default)
    for name, rank in ranks.items():
        expr = F.when(value == name, F.lit(rank)).otherwise(expr)
    return expr


def choose(value: Column, names: dict[str, str], default: str | None = None) -> Column:
    expr = F.lit(default).cast("string")
    for key, name in names.items():
        expr = F.when(value == key, F.lit(name)).otherwise(expr)
    return expr


def event_dimension(kind: Column) -> Column:
    return (
        F.when(kind.isin(*fv.TASK_KINDS), "task")
        .when(kind == "output_created", "output")
        .when(kind == "knowledge_reused", "reuse")
        .when(kind == "research_activity", "research")
        .otherwise("knowledge")
    )
