"""Expressions over collaboration records: kinds, access, errors, messages, scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.text import choose


def infer_resource_kind(module: Column, status: Column) -> Column:
    """Activity kind of a stored resource row that carries none."""
    status = F.coalesce(status, F.lit(""))
    return (
        F.when(module.isin("tasks", "base") & status.rlike(fv.KIND_TASK_DONE), "task_completed")
        .when(module.isin("tasks", "base") & status.rlike(fv.KIND_TASK_BLOCKED), "task_blocked")
        .when(module.isin("tasks", "base"), "task_progress")
        .when(module.isin("minutes", "documents"), "knowledge_updated")
        .when(module == "approvals", "output_created")
        .otherwise("research_activity")
    )


def activity_kind(module: Column, status: Column, content: Column, seen: Column) -> Column:
    """Activity kind given to a resource while it is read, knowing whether it was seen before."""
    text = F.concat_ws(" ", status, content)
    work = F.when(seen, "task_progress").otherwise("task_started")
    note = F.when(seen, "knowledge_updated").otherwise("knowledge_created")
    return (
        F.when((module == "tasks") & text.rlike(fv.KIND_TASK_DONE), "task_completed")
        .when((module == "tasks") & text.rlike(fv.ACTIVITY_TASK_BLOCKED), "task_blocked")
        .when((module == "base") & text.rlike(fv.ACTIVITY_BASE_DONE), "task_completed")
        .when((module == "base") & text.rlike(fv.ACTIVITY_BASE_BLOCKED), "task_blocked")
        .when(module.isin("tasks", "base"), work)
        .when(module.isin("minutes", "documents"), note)
        .when((module == "approvals") | content.rlike(fv.ACTIVITY_OUTPUT), "output_created")
        .otherwise("research_activity")
    )


def module_label(module: Column) -> Column:
    return choose(module, fv.COLLAB_LABELS, fv.COLLAB_DEFAULT_LABEL)


def classify_error(subtype: Column, message: Column, missing_scopes: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(subtype, F.lit("unknown")), message)
    return (
        F.when(missing_scopes, "missing_scope")
        .when(text.rlike(fv.ERROR_RATE_LIMIT), "rate_limit")
        .when(text.rlike(fv.ERROR_AUTH), "auth_expired")
        .when(text.rlike(fv.ERROR_PERMISSION), "permission")
        .otherwise(F.coalesce(subtype, F.lit("unknown")))
    )


def access_status(category: Column) -> Column:
    return choose(category, fv.ERROR_ACCESS, fv.ERROR_ACCESS_DEFAULT)


def is_safe_message(chat_type: Column, sender_type: Column, msg_type: Column, text: Column) -> Column:
    return (
        ~F.lower(F.coalesce(chat_type, F.lit(""))).isin("p2p", "private")
        & ~F.lower(F.coalesce(sender_type, F.lit(""))).isin("bot", "app")
        & (F.lower(F.coalesce(msg_type, F.lit(""))) != "system")
        & (F.trim(F.coalesce(text, F.lit(""))) != "")
    )


def is_substantive(text: Column) -> Column:
    return text.rlike(fv.MESSAGE_SUBSTANTIVE)


def is_noise(text: Column) -> Column:
    return text.rlike(fv.MESSAGE_CHATTER) | text.rlike(fv.MESSAGE_BROADCAST)
