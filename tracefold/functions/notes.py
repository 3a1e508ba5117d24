"""Markdown-note expressions: front matter, sections, digests, links, paths, URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.text import (
    blank_to_null, collapse_ws, extract, extract_all, head_chars, let, lines_of, non_empty, sanitize_text, trim_ws,
    truncate,
)


def front_matter_block(content: Column) -> Column:
    return F.regexp_extract(content, r"^---\s*\r?\n([\s\S]*?)\r?\n---\s*(?:\r?\n|$)", 1)


def front_matter(content: Column, key: str) -> Column:
    return trim_ws(F.regexp_extract(front_matter_block(content), rf"(?m)^{re.escape(key)}:[ \t]*([^\r\n]+)$", 1))


def _unquote(value: Column) -> Column:
    return F.regexp_replace(trim_ws(value), "^([\"'])(.*)\\1$", "$2")


def front_matter_list(content: Column, key: str) -> Column:
    """Values of an inline ``[a, b]`` list or of an indented ``- a`` block."""
    meta = front_matter_block(content)
    name = re.escape(key)
    inline = extract(meta, rf"(?m)^{name}:\s*(\[[^\]]*])\s*$")
    block = F.regexp_extract(meta, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]+-[ \t]+.*(?:\r?\n|$))*)", 1)
    from_inline = F.split(F.regexp_replace(inline, r"^\[|\]$", ""), ",")
    from_block = F.transform(lines_of(block), lambda l: F.regexp_replace(l, r"^\s*-\s*", ""))
    return non_empty(F.transform(F.coalesce(from_inline, from_block), _unquote))


def section(content: Column, heading: str) -> Column:
    """Body of a level-two section, empty when the note has none."""
    pattern = rf"(?m)^##\s+{re.escape(heading)}\s*$([\s\S]*?)(?=^##\s+|\z)"
    return trim_ws(F.regexp_extract(content, pattern, 1))


def has_section(content: Column, heading: str) -> Column:
    return content.rlike(rf"(?m)^##\s+{re.escape(heading)}\s*$")


def heading_title(content: Column) -> Column:
    return blank_to_null(trim_ws(F.regexp_extract(content, r"(?m)^#\s+(.+)$", 1)))


def file_title(path: Column, fallback: str = "知识笔记") -> Column:
    last = F.element_at(F.split(path, r"[\\/]"), -1)
    return F.coalesce(blank_to_null(F.regexp_replace(last, r"(?i)\.md$", "")), F.lit(fallback))


def note_title(path: Column, content: Column) -> Column:
    return truncate(F.coalesce(heading_title(content), file_title(path, "未命名知识")), 72)


def wiki_conclusion(content: Column) -> Column:
    body = blank_to_null(section(content, fv.CONCLUSION_HEADING))
    return F.coalesce(blank_to_null(sanitize_text(F.coalesce(body, content))), F.lit("知识笔记已形成。"))


def _clean_line(line: Column) -> Column:
    for pattern, replacement in [
        (r"^[-*+]\s+", ""), (r"^\d+[.)]\s+", ""), (r"\*\*", ""), (r"`([^`]+)`", "$1"),
        (r"\[([^\]]+)]\([^)]+\)", "$1"), (r"\[\[([^|\]]+)(?:\|[^\]]+)?]]", "$1"),
    ]:
        line = F.regexp_replace(trim_ws(line), pattern, replacement)
    return trim_ws(line)


def _section_lines(content: Column, heading: str) -> Column:
    lines = F.transform(lines_of(section(content, heading)), _clean_line)
    return F.slice(F.filter(lines, lambda l: (l != "") & (l != "本次来源事件")), 1, 8)


def _join_lines(lines: Column) -> Column:
    return truncate(trim_ws(collapse_ws(F.array_join(F.slice(lines, 1, 2), "；"))), 320)


def derive_digest(content: Column) -> Column:
    """Struct (about, problem, result, next_use) from a note, null when it states none."""

    def labelled(lines: Column) -> Column:
        def value(label: str) -> Column:
            hits = F.filter(
                F.transform(lines, lambda l: trim_ws(F.regexp_extract(l, rf"^{label}\s*[：:]\s*(.+)$", 1))),
                lambda v: v != "",
            )
            return F.get(hits, F.lit(0))

        parts = {name: value(label) for name, label in fv.DIGEST_LABELS.items()}
        complete = None
        for part in parts.values():
            complete = part.isNotNull() if complete is None else complete & part.isNotNull()
        return F.when(complete, F.struct(*[v.alias(n) for n, v in parts.items()]))

    problems, results, steps = (_section_lines(content, h) for h in fv.DIGEST_LEGACY)
    opening = truncate(trim_ws(collapse_ws(F.get(problems, F.lit(0)))), 240)
    legacy = F.when(
        (F.size(problems) > 0) & (F.size(results) > 0) & (F.size(steps) > 0),
        F.struct(
            F.concat(F.lit(fv.DIGEST_LEGACY_PREFIX), opening).alias("about"), _join_lines(problems).alias("problem"),
            _join_lines(results).alias("result"), _join_lines(steps).alias("next_use"),
        ),
    )
    return F.coalesce(let(_section_lines(content, fv.DIGEST_OVERVIEW), labelled), legacy)


def normalize_link(target: Column) -> Column:
    value = F.regexp_replace(trim_ws(target), r"\\", "/")
    value = F.coalesce(F.try_url_decode(F.regexp_replace(value, r"\+", "%2B")), value)
    for pattern in [r"^<|>$", r"[?#].*$", r"(?i)\.md$", r"^\.?/", r"^(?:\.\./)+", "^/+"]:
        value = F.regexp_replace(value, pattern, "")
    return value


def link_targets(content: Column) -> Column:
    """Normalised targets of ``[[wiki]]`` and ``[text](path)`` links."""
    wiki = extract_all(content, r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]")
    plain = extract_all(content, r"\[[^\]]+]\(([^)]+)\)")
    return F.transform(F.concat(wiki, plain), normalize_link)


def links_to(content: Column, path: Column) -> Column:
    full = normalize_link(path)
    names = F.array(full, F.regexp_replace(full, "(?i)^wiki/", ""), F.element_at(F.split(full, "/"), -1))
    return F.exists(
        link_targets(content),
        lambda t: F.array_contains(names, t) | F.array_contains(names, F.element_at(F.split(t, "/"), -1)),
    )


def event_ids_in(content: Column) -> Column:
    """Source event ids a note declares in its front matter, else those spelled in its text."""
    declared = front_matter_list(content, "source_event_ids")
    spelled = extract_all(content, r"(?i)([^\s\"'`]+:(?:UserPromptSubmit|Stop):[0-9a-f]{64})")
    return F.array_distinct(F.when(F.size(declared) > 0, declared).otherwise(spelled))


def extract_paths(content: Column) -> Column:
    """Drive-letter paths in links and backticks, line suffixes dropped."""
    linked = extract_all(content, r"\[[^\]]*\]\((/?[A-Za-z]:[\\/][^)#]+)(?:#[^)]*)?\)")
    ticked = extract_all(content, r"`(/?[A-Za-z]:[\\/][^`\r\n]+)`")
    tidy = F.transform(
        F.concat(linked, ticked),
        lambda p: trim_ws(
            F.regexp_replace(F.regexp_replace(p, r"^/(?=[A-Za-z]:[\\/])", ""), r":\d+(?::\d+)?$", "")
        ),
    )
    return F.array_distinct(F.filter(tidy, lambda p: p.rlike(r"^[A-Za-z]:[\\/]")))


def extract_urls(content: Column) -> Column:
    """Valid http(s) URLs, surrounding punctuation trimmed, in order of first appearance."""
    linked = extract_all(content, r"(?i)\]\(\s*(https?://[^\s)]+)(?:\s+[\"'][^)]*)?\)")
    bare = extract_all(content, r"(?i)(https?://[^\s<>()\[\]{}\"'`，。；：！？、」』【】）》（]+)")
    tidy = F.transform(
        F.concat(linked, bare),
        lambda u: F.regexp_replace(
            F.regexp_replace(u, "^[<(`]+", ""), r"[`，。；：！？、」』】）》.,;!?]+$", ""
        ),
    )
    return F.array_distinct(F.filter(tidy, lambda u: F.try_parse_url(u, F.lit("HOST")).isNotNull()))


def safe_id(value: Column) -> Column:
    return F.regexp_replace(trim_ws(F.coalesce(value, F.lit(""))), "[^A-Za-z0-9._:-]", "")


def safe_url(value: Column) -> Column:
    ok = (F.try_parse_url(value, F.lit("PROTOCOL")) == "https") & F.try_parse_url(value, F.lit("HOST")).isNotNull()
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise("")


def readable_file_title(title: Column) -> Column:
    """Title usable as a file name: at most 96 characters, the last of which say so where it was longer."""
    value = F.regexp_replace(title, "<!--|-->", " ")
    value = F.regexp_replace(value, r'[<>:"/\\|?*\u0000-\u001f\[\]#^`]', " ")
    value = collapse_ws(F.regexp_replace(value, "[*_~]+", " "))
    value = trim_ws(F.regexp_replace(value, rf"^[.\s-]+|[.\s-]+$", ""))
    value = F.coalesce(blank_to_null(value), F.lit(fv.FILE_TITLE_FALLBACK))
    return F.when(F.length(value) <= fv.FILE_TITLE_CHARS, value).otherwise(
        F.concat(F.substring(value, 1, fv.FILE_TITLE_CHARS - len(fv.FILE_TITLE_SUFFIX)), F.lit(fv.FILE_TITLE_SUFFIX))
    )


def conversation_id_from_url(url: Column) -> Column:
    """Id after the last ``c`` path segment of a known chat host."""
    host = F.try_parse_url(url, F.lit("HOST"))
    segments = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda s: s != "")
    back = F.array_position(F.reverse(segments), "c").cast("int")
    found = F.try_url_decode(F.get(segments, F.size(segments) - back + 1))
    return F.when(host.isin(*fv.CHAT_HOSTS) & (back > 1) & found.rlike(fv.CONVERSATION_ID), found)


def redact_remote(url: Column) -> Column:
    """Remote address without user, password, query or fragment."""
    trimmed = trim_ws(url)
    with_scheme = F.regexp_replace(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]*@", "$1")
    with_scheme = F.regexp_replace(with_scheme, r"[?#].*$", "")
    bare = F.regexp_replace(trimmed, r"^[^@/\s]+@(?=[^:/\s]+[:/])", "")
    return F.when(trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), with_scheme).otherwise(bare)


def repository_name(remote: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(remote, r"[\\/]$", ""), r"(?i)\.git$", "")
    parts = non_empty(F.split(clean, r"[\\/:]"))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("Git 项目"))
