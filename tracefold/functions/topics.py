"""Topic expressions: automation class, explicit anchors, goals, titles, priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions import ids
from tracefold.functions.projects import normalized_project
from tracefold.functions.text import (
    blank_to_null, collapse_ws, extract, first_line, head_chars, let, lines_of, nfkc, trim_ws,
)


def _text(prompt: Column, stop: Column) -> Column:
    return F.concat(F.coalesce(prompt, F.lit("")), F.lit("\n"), F.coalesce(stop, F.lit("")))


def normalize_text(value: Column) -> Column:
    return F.lower(trim_ws(collapse_ws(nfkc(F.coalesce(value, F.lit(""))))))


def automation_class(prompt: Column, stop: Column) -> Column:
    """no-op / substantive / ordinary. A durable result or a state transition beats an empty one."""
    prompt, stop = F.coalesce(prompt, F.lit("")), F.coalesce(stop, F.lit(""))
    return (
        F.when(prompt.rlike(fv.OPT_OUT_PROMPT) | prompt.rlike(fv.SUGGESTION_PROMPT), "no-op")
        .when(~prompt.rlike(fv.AUTOMATION_HEADER), "ordinary")
        .when(stop.rlike(fv.DURABLE_RESULT) | stop.rlike(fv.STATE_TRANSITION), "substantive")
        .when(stop.rlike(fv.NO_OP_RESULT), "no-op")
        .otherwise("substantive")
    )


def automation_kind(prompt: Column, stop: Column) -> Column:
    text = _text(prompt, stop)
    named = blank_to_null(trim_ws(F.regexp_extract(F.coalesce(prompt, F.lit("")), fv.AUTOMATION_ID_TAG, 1)))
    expr = F.coalesce(named, F.lit(fv.AUTOMATION_DEFAULT_KIND))
    for pattern, name in reversed(fv.AUTOMATION_KINDS):
        expr = F.when(text.rlike(pattern), F.lit(name)).otherwise(expr)
    suggestion = F.coalesce(prompt, F.lit("")).rlike(fv.SUGGESTION_PROMPT)
    return F.when(suggestion, fv.AUTOMATION_SUGGESTION_KIND).otherwise(expr)


def automation_display_name(prompt: Column, stop: Column) -> Column:
    text = _text(prompt, stop)
    expr = F.lit(fv.AUTOMATION_DEFAULT_NAME)
    for pattern, name in reversed(fv.AUTOMATION_KINDS):
        expr = F.when(text.rlike(pattern), F.lit(name)).otherwise(expr)
    return expr


def durable_automation_id(prompt: Column, stop: Column) -> Column:
    text = _text(prompt, stop)
    issue, feedback = extract(text, fv.LINKED_ISSUE), extract(text, fv.FEEDBACK_ID)
    return F.when(issue.isNotNull(), F.concat(F.lit("issue:"), issue)).when(
        feedback.isNotNull(), F.concat(F.lit("feedback:"), F.lower(feedback))
    )


def substantive_automation(prompt: Column, stop: Column) -> Column:
    return F.when(automation_class(prompt, stop) == "substantive", automation_kind(prompt, stop))


def _resource_anchor() -> Column:
    return F.concat(
        F.lit("feishu:"), F.coalesce(blank_to_null(F.col("resource_type")), F.lit("record")), F.lit(":"),
        F.coalesce(blank_to_null(F.col("resource_id")), F.col("session_id")),
    )


def _chat_anchor() -> Column:
    return F.concat(F.lit("chatgpt:"), F.coalesce(blank_to_null(F.col("conversation_id")), F.col("session_id")))


def explicit_anchor(kind: Column) -> Column:
    """Anchor that a pair names itself, over the columns of a pair row; null when it names none.

    ``kind`` is the pair's ``substantive_automation``, computed once by the caller.
    """
    prompt, stop = F.col("prompt_content"), F.col("stop_content")
    project = normalized_project(F.col("cwd"))
    text = _text(prompt, stop)
    issue = extract(text, fv.TOPIC_ISSUE)
    by_issue = F.when(issue.isNotNull(), F.concat(F.lit("codex:"), project, F.lit(":issue:"), issue))
    folder = F.lower(extract(F.regexp_replace(text, r"\\", "/"), fv.AGENT_TASK_FOLDER))
    by_folder = F.when(folder.isNotNull(), F.concat(F.lit("codex:"), project, F.lit(":agent-task:"), folder))
    durable = F.when(kind == "平台反馈", durable_automation_id(prompt, stop))
    automation = F.concat(F.lit("automation:"), normalize_text(kind), F.lit(":"), F.coalesce(durable, F.col("date").cast("string")))
    return (
        F.when(F.col("source") == "feishu", F.coalesce(by_issue, _resource_anchor()))
        .when(F.col("source") == "chatgpt_web", _chat_anchor())
        .when(kind.isNotNull(), automation)
        .otherwise(F.coalesce(by_folder, by_issue))
    )


def session_anchor() -> Column:
    return F.concat(F.lit("codex:"), normalized_project(F.col("cwd")), F.lit(":session:"), F.col("session_id"))


def fallback_anchor(index_title: Column) -> Column:
    numbered = blank_to_null(trim_ws(F.regexp_extract(F.coalesce(index_title, F.lit("")), r"^(.*?)\s*\((?:[2-9]|\d{2,})\)\s*$", 1)))
    by_family = F.concat(
        F.lit("codex:"), normalized_project(F.col("cwd")), F.lit(":numbered:"), normalize_text(numbered)
    )
    return (
        F.when(F.col("source") == "feishu", _resource_anchor())
        .when(F.col("source") == "chatgpt_web", _chat_anchor())
        .when(numbered.isNotNull(), by_family)
        .otherwise(session_anchor())
    )


def segment_anchor(goal: Column, first: Column) -> Column:
    """Anchor derived for a segment that names none: the session, or a hash of the goal after a break."""
    mark = F.substring(F.sha2(F.coalesce(blank_to_null(goal), F.col("id")), 256), 1, 16)
    return (
        F.when(F.col("source") == "feishu", _resource_anchor())
        .when(F.col("source") == "chatgpt_web", _chat_anchor())
        .when(first, session_anchor())
        .otherwise(F.concat(session_anchor(), F.lit(":segment:"), mark))
    )


def humanize_title(value: Column) -> Column:
    title = trim_ws(value)
    issue = extract(title, fv.ISSUE_HEADLINE)
    short = trim_ws(F.regexp_replace(issue, r"^\[[^\]]{1,24}\]\s*", ""))
    return F.coalesce(short, trim_ws(F.regexp_replace(title, r"(?i)[。.]\s*严格遵循\s*[:：].*$", "")))


def prompt_title(prompt: Column) -> Column:
    """First line of a prompt that states something, skipping metadata and bare paths."""
    raw = F.coalesce(prompt, F.lit(""))
    inside = F.coalesce(extract(raw, r"(?i)<input\b[^>]*>([\s\S]*?)</input>"), raw)

    def tidy(line: Column) -> Column:
        line = F.regexp_replace(line, r"^\s*(?:[-*+]|\d+[.)])\s+", "")
        line = F.regexp_replace(line, r"^\s*#{1,6}\s+", "")
        return trim_ws(F.regexp_replace(line, "<[^>]+>", ""))

    stated = F.filter(
        F.transform(lines_of(inside), tidy),
        lambda l: (l != "")
        & ~l.rlike(fv.PROMPT_METADATA_LINE)
        & ~l.rlike(r"^[A-Za-z]:[\\/][^\s]+$")
        & ~l.rlike(r"^[^:：]{1,120}:\s*[A-Za-z]:[\\/]"),
    )
    return let(F.get(stated, F.lit(0)), lambda l: head_chars(humanize_title(l), 72))


def new_goal(stated: Column) -> Column:
    """Goal announced by a prompt's stated line, whole: it becomes part of the topic's anchor."""
    return blank_to_null(trim_ws(F.regexp_extract(F.coalesce(stated, F.lit("")), fv.NEW_GOAL, 1)))


def is_short_continuation(stated: Column) -> Column:
    text = F.regexp_replace(normalize_text(stated), "[，,。.!！]", " ")
    return (text != "") & (F.length(text) <= 24) & text.rlike(fv.SHORT_CONTINUATION)


def is_delegation(prompt: Column) -> Column:
    return prompt.rlike(r"(?i)<codex_delegation\b") & prompt.rlike(r"(?i)<input\b")


def _titled(title: Column, source: str) -> Column:
    return F.when(title.isNotNull(), F.struct(title.alias("title"), F.lit(source).alias("source")))


def topic_title(index_title: Column, kind: Column) -> Column:
    """Struct (title, source) for a pair row without segment context."""
    prompt, stop, own = F.col("prompt_content"), F.col("stop_content"), blank_to_null(F.col("title"))
    inbox = extract(F.coalesce(stop, F.lit("")), fv.INBOX_ITEM_TITLE)
    automation = F.coalesce(
        _titled(inbox, "automation-result"), _titled(F.concat(kind, F.lit(" · "), F.col("date").cast("string")), "automation")
    )
    record = F.coalesce(
        _titled(own, "source-title"), _titled(F.coalesce(first_line(stop), F.lit("飞书记录")), "content")
    )
    chat = F.coalesce(
        _titled(own, "source-title"), _titled(F.coalesce(first_line(prompt), F.lit("ChatGPT 对话")), "prompt")
    )
    session = F.coalesce(
        _titled(index_title, "session-index"), _titled(F.coalesce(first_line(prompt), F.lit("Codex 任务")), "prompt")
    )
    return (
        F.when(F.col("source") == "feishu", record)
        .when(F.col("source") == "chatgpt_web", chat)
        .when(kind.isNotNull(), automation)
        .otherwise(session)
    )


def segment_title(index_title: Column, restored_title: Column, goal: Column, stated: Column, short: Column, kind: Column, own: Column) -> Column:
    """Struct (title, source) for the row that opens a segment; ``own`` is its ``topic_title`` without an index."""
    derived = F.col("source").isin("chatgpt_web", "feishu") | kind.isNotNull()
    restored = F.when(~restored_title.rlike("(?i)^恢复任务"), head_chars(humanize_title(restored_title), 72))
    return F.when(derived, own).otherwise(
        F.coalesce(
            _titled(restored, "restored-session-index"),
            _titled(goal, "segment-prompt"),
            _titled(F.when(~short, stated), "prompt"),
            _titled(index_title, "session-index"),
            _titled(stated, "prompt"),
            _titled(F.lit("Codex 任务"), "fallback"),
        )
    )


def restored_session(prompt: Column) -> Column:
    return extract(F.coalesce(prompt, F.lit("")), fv.RESTORED_TASK)


def pair_chars() -> Column:
    return F.length(F.coalesce(F.col("prompt_content"), F.lit(""))) + F.length(F.coalesce(F.col("stop_content"), F.lit("")))


def priority_flags(prompt: Column, stop: Column) -> list[Column]:
    """One boolean per priority rule; or-ed over a topic's pairs."""
    text = _text(prompt, stop)
    return [text.rlike(pattern) for pattern, _ in fv.PRIORITY_RULES]


def work_identifier(text: Column) -> Column:
    issue, task = extract(text, fv.WORK_ISSUE), extract(text, fv.WORK_TASK)
    return F.when(issue.isNotNull(), F.concat(F.lit("issue:"), issue)).when(
        task.isNotNull(), F.concat(F.lit("task:"), F.lower(task))
    )


def system_outcome_id(category: str, key: Column) -> Column:
    return F.concat(F.lit(f"outcome:system:{category}:"), F.substring(F.sha2(key, 256), 1, 20))


def topic_id(anchor: Column) -> Column:
    return F.concat(F.lit("topic:"), F.substring(F.sha2(anchor, 256), 1, 24))


__all__ = [name for name in dir() if not name.startswith("_") and name not in {"annotations", "ids"}]
