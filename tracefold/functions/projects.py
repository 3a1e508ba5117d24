"""Project identity from working directories, note paths and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.text import blank_to_null, collapse_ws, extract, nfkc, trim_ws

_WORKTREE = r"(?i)\\\.codex\\worktrees\\[^\\]+\\([^\\]+)"
_NESTED_WORKTREE = r"(?i)^(.+?)\\\.worktrees(?:\\|$)"
_HOME_WORKTREE = r"(?i)^(?:[A-Za-z]:/Users/[^/]+|/(?:Users|home)/[^/]+)/\.codex/worktrees/[^/]+/(.+)$"


def project_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), f"{fv.WS}+", "-")


def _last_segment(path: Column, separator: str) -> Column:
    parts = F.filter(F.split(path, separator), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def project_label_from_cwd(cwd: Column) -> Column:
    """Folder that names the project; worktrees fold onto their repository; null for system paths."""
    path = F.regexp_replace(F.regexp_replace(cwd, "/", r"\\\\"), r"\\+$", "")
    system = reduce(lambda a, p: a | path.rlike(p), fv.SYSTEM_PATHS, (path == "") | (path == "chatgpt.com"))
    nested = _last_segment(extract(path, _NESTED_WORKTREE), r"\\")
    label = F.coalesce(extract(path, _WORKTREE), nested, _last_segment(path, r"\\"))
    return F.when(~system & (label != ".codex"), label)


def project_label_from_note(path: Column) -> Column:
    segments = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    folder = F.when(F.size(segments) >= 3, F.get(segments, F.lit(1))).otherwise(fv.GENERAL)
    return F.when((folder == "补充") | folder.startswith("_"), fv.KNOWLEDGE_BASE).otherwise(folder)


def normalized_project(cwd: Column) -> Column:
    """Lower-case path without trailing slashes, worktree folded; the queue's project key."""
    path = F.coalesce(blank_to_null(cwd), F.lit("unassigned"))
    path = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", "")
    return F.lower(F.coalesce(extract(path, _HOME_WORKTREE), path))


def normalized_project_key(label: Column) -> Column:
    value = F.regexp_replace(F.lower(trim_ws(nfkc(label))), f"{fv.WS}+", "-")
    return F.coalesce(blank_to_null(value), F.lit("unassigned"))


def topic_project_label(source: Column, cwd: Column) -> Column:
    path = normalized_project(cwd)
    own = F.coalesce(_last_segment(path, "/"), blank_to_null(path), F.lit(fv.UNASSIGNED))
    return (
        F.when(source == "chatgpt_web", "ChatGPT")
        .when(source == "feishu", F.coalesce(blank_to_null(cwd), F.lit(fv.COLLAB_DEFAULT_LABEL)))
        .otherwise(own)
    )


def directory_name(project: Column) -> Column:
    """A project name usable as a folder."""
    asked = F.coalesce(blank_to_null(trim_ws(project)), F.lit(fv.UNASSIGNED))
    clean = trim_ws(collapse_ws(F.regexp_replace(asked, r'[<>:"/\\|?*\u0000-\u001F]', " ")))
    return F.coalesce(blank_to_null(F.substring(clean, 1, 80)), F.lit(fv.UNASSIGNED))


def label_priority(source_types: Column) -> Column:
    expr = F.lit(0.0)
    for name, rank in reversed(fv.LABEL_PRIORITY):
        expr = F.when(F.array_contains(source_types, name), F.lit(rank)).otherwise(expr)
    return expr
