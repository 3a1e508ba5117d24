"""Turns, pairs and completion events out of captured records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions import ids
from tracefold.functions.collab import infer_resource_kind, module_label
from tracefold.functions.projects import project_key, project_label_from_cwd
from tracefold.functions.text import (
    blank_to_null, classify_status, concise_summary, concise_title, has_direct_completion, is_automation,
    meaningful_prompt, trim_ws,
)
from tracefold.operators.sequence import first_rows, ordinal_block, running_total
from tracefold.session import cut_lineage

TURN = ["source", "session_id", "turn_id"]
PROMPT, STOP = "UserPromptSubmit", "Stop"


def dedup_records(records: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """One row per event id; the record read last wins."""
    return first_rows(records, ["event_id"], [F.col(seq).desc()])


def exclude_automation(records: DataFrame) -> DataFrame:
    """Drop every record of a turn in which any prompt came from an automation."""
    automated = records.where((F.col("event") == PROMPT) & is_automation(F.col("content"))).select(*TURN).distinct()
    return records.join(automated, TURN, "left_anti")


def opt_out_turns(records: DataFrame) -> DataFrame:
    """Drop turns whose prompt asks not to be kept, together with their answers."""
    turn = ["session_id", "turn_id"]
    opted = records.where((F.col("event") == PROMPT) & F.col("content").rlike(fv.OPT_OUT_PROMPT)).select(*turn).distinct()
    return records.join(opted, turn, "left_anti")


def meaningful_prompts(records: DataFrame) -> DataFrame:
    prompts = records.where(F.col("event") == PROMPT).withColumn("request", meaningful_prompt(F.col("content")))
    return prompts.where(F.col("request").isNotNull())


def eligible_turns(records: DataFrame, titles: DataFrame) -> DataFrame:
    """Turn keys with a meaningful, non-automated prompt in an indexed session."""
    prompts = meaningful_prompts(records.where(F.col("source") == "codex"))
    return prompts.join(titles.select("session_id"), "session_id", "left_semi").select("session_id", "turn_id").distinct()


def eligible_stops(records: DataFrame, turns: DataFrame) -> DataFrame:
    """Final answers of eligible turns that report a direct, evidenced completion."""
    stops = records.where((F.col("source") == "codex") & (F.col("event") == STOP))
    done = stops.where(has_direct_completion(F.col("content")) & (classify_status(F.col("content")) == "completed"))
    return done.join(turns, ["session_id", "turn_id"], "left_semi")


def title_lookup(turns: DataFrame, titles: DataFrame) -> DataFrame:
    """Indexed session title of each turn; assistant sessions without an index entry are left out.

    ``titles`` has one row per session. No broadcast is asked for: the index grows with the data, and
    adaptive execution broadcasts it when its measured size allows.
    """
    looked = turns.join(titles.select("session_id", F.col("title").alias("index_title")), "session_id", "left")
    return looked.where((F.col("source") == "chatgpt_web") | F.col("index_title").isNotNull())


def turn_groups(records: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """One row per turn. Summaries and status are taken before the shuffle, so no full text crosses it."""
    rows = dedup_records(records, seq).where(F.col("source") != "feishu")
    is_prompt, is_stop = F.col("event") == PROMPT, F.col("event") == STOP
    rows = rows.select(
        *TURN, "event", "event_id", "captured_at", "date", "cwd", "title", "url", "conversation_id", "source_path",
        "source_line", is_automation(F.col("content")).alias("automated"),
        F.when(is_prompt, meaningful_prompt(F.col("content"))).alias("request"),
        F.when(is_stop, concise_summary(F.col("content"))).alias("stop_summary"),
        F.when(is_stop, classify_status(F.col("content"))).alias("status"),
    )
    rows = rows.withColumn("summary", concise_summary(F.col("request"))).withColumn(
        "request_title", concise_title(F.col("request"), "")
    )
    at = F.struct("captured_at", "event_id")
    asked = is_prompt & F.col("request").isNotNull()
    head = F.struct(
        "event_id", "captured_at", "date", "cwd", "title", "url", "conversation_id", "summary", "request_title",
        "source_path", "source_line",
    )
    tail = F.struct("event_id", "captured_at", "date", "stop_summary", "status", "source_path", "source_line")
    return rows.groupBy(*TURN).agg(
        F.bool_or(is_prompt & F.col("automated")).alias("automated"),
        F.count_if(asked).alias("requests"),
        F.min_by(head, F.when(asked, at)).alias("prompt"),
        F.max_by(tail, F.when(is_stop, at)).alias("stop"),
        F.min("captured_at").alias("first_at"),
    )


def mark_first_turn(turns: DataFrame) -> DataFrame:
    """Flag the earliest turn of each task. A grouped minimum and a join: no window over a hot task."""
    at = F.struct("first_at", "session_id", "turn_id")
    head = turns.groupBy("task_key").agg(F.min(at).alias("head"))
    return turns.join(head, "task_key", "left").withColumn("first_turn", at == F.col("head")).drop("head")


def _refs(*items: tuple[Column, Column]) -> Column:
    """Array of the given references whose condition holds."""
    return F.filter(F.array(*[F.when(test, ref) for test, ref in items]), lambda r: r.isNotNull())


def source_ref(kind: Column, label: str, path=None, url=None, line=None, excerpt=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        kind.alias("type"), F.lit(label).alias("label"), (none if path is None else path).alias("path"),
        (none if url is None else url).alias("url"),
        (F.lit(None).cast("int") if line is None else line.cast("int")).alias("line"),
        (none if excerpt is None else excerpt).alias("excerpt"),
    )


def described_turns(records: DataFrame, titles: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Turns that count as activity, with project, task, title and references."""
    # Slim rows, read four times from here on: twice to find first turns, for turn and for completion events.
    turns = cut_lineage(turn_groups(records, seq).where(~F.col("automated") & (F.col("requests") > 0)))
    turns = title_lookup(turns, titles)
    chat = F.col("source") == "chatgpt_web"
    kind = F.when(chat, "chatgpt").otherwise("codex")
    label = F.coalesce(F.when(~chat, project_label_from_cwd(F.col("prompt.cwd"))), F.lit(fv.UNASSIGNED))
    named = F.coalesce(
        F.col("index_title"), F.col("prompt.title"), blank_to_null(F.col("prompt.request_title")),
        F.when(chat, "ChatGPT 对话").otherwise("Codex 任务"),
    )
    assigned = ~chat & project_label_from_cwd(F.col("prompt.cwd")).isNotNull()
    turns = (
        turns.withColumn("source_type", kind)
        .withColumn("project_label", label)
        .withColumn("project_key", F.when(chat, project_key(label)).when(assigned, project_key(label)).otherwise("unassigned"))
        .withColumn("activity_session", F.when(chat, F.coalesce("prompt.conversation_id", "session_id")).otherwise(F.col("session_id")))
        .withColumn("display_title", concise_title(named, fv.UNTITLED_ACTIVITY))
    )
    turns = turns.withColumn("task_key", F.concat_ws(":", "source_type", "project_key", "activity_session"))
    page = lambda day: F.concat(F.lit("raw/"), kind, F.lit("/daily/"), day.cast("string"), F.lit(".md"))
    has_stop, late = F.col("stop").isNotNull(), F.col("stop.date") != F.col("prompt.date")
    refs = _refs(
        (chat & F.col("prompt.url").isNotNull(), source_ref(kind, "打开 ChatGPT 对话", url=F.col("prompt.url"))),
        (F.lit(True), source_ref(kind, "来源页", page(F.col("prompt.date")), excerpt=F.col("prompt.summary"))),
        (F.lit(True), source_ref(kind, "原始事件", F.col("prompt.source_path"), line=F.col("prompt.source_line"), excerpt=F.col("prompt.summary"))),
        (has_stop & late, source_ref(kind, "终态来源页", page(F.col("stop.date")), excerpt=F.col("stop.stop_summary"))),
        (has_stop, source_ref(kind, "Stop 事件", F.col("stop.source_path"), line=F.col("stop.source_line"), excerpt=F.col("stop.stop_summary"))),
    )
    return mark_first_turn(turns.withColumn("source_refs", refs))


def turn_events(turns: DataFrame) -> DataFrame:
    """The activity event of each turn: started or progress for a task, research for a web conversation."""
    chat, paired = F.col("source") == "chatgpt_web", F.col("stop").isNotNull()
    many = F.concat(F.col("prompt.summary"), F.lit("（同一 turn 共 "), F.col("requests").cast("string"), F.lit(" 条指令）"))
    return turns.select(
        F.concat_ws(":", F.lit("turn"), "source_type", "session_id", "turn_id").alias("id"),
        F.when(chat, "research_activity").when(F.col("first_turn"), "task_started").otherwise("task_progress").alias("kind"),
        F.col("prompt.captured_at").alias("occurred_at"),
        F.coalesce("stop.captured_at", "prompt.captured_at").alias("observed_at"),
        F.col("prompt.date").alias("local_date"), F.lit("captured").alias("time_basis"),
        F.col("display_title").alias("title"),
        F.when(F.col("requests") > 1, many).otherwise(F.col("prompt.summary")).alias("summary"),
        "project_key", "project_label", F.when(~chat, F.col("task_key")).alias("task_key"),
        F.lit(None).cast("string").alias("object_key"), F.col("activity_session").alias("session_id"), "turn_id",
        F.when(paired, "observed").otherwise("inferred").alias("confidence"),
        F.when(chat, F.when(paired, "已捕获完整 ChatGPT 问答").otherwise("仅捕获到用户消息"))
        .otherwise(F.when(paired, "已捕获完整 Codex turn").otherwise("仅捕获到任务指令，未发现 Stop 事件")).alias("evidence"), "source_refs",
    )


def completion_events(turns: DataFrame) -> DataFrame:
    """A second event, dated on the answer, where it reports completion or a blocker."""
    told = turns.where((F.col("source") != "chatgpt_web") & F.col("stop.status").isin("completed", "blocked"))
    blocked = F.col("stop.status") == "blocked"
    return told.select(
        F.concat_ws(":", F.lit("turn-outcome"), "source_type", "session_id", "turn_id").alias("id"),
        F.when(blocked, "task_blocked").otherwise("task_completed").alias("kind"),
        F.col("stop.captured_at").alias("occurred_at"), F.col("stop.captured_at").alias("observed_at"),
        F.col("stop.date").alias("local_date"), F.lit("captured").alias("time_basis"),
        F.col("display_title").alias("title"), F.col("stop.stop_summary").alias("summary"), "project_key",
        "project_label", "task_key", F.lit(None).cast("string").alias("object_key"),
        F.col("activity_session").alias("session_id"), "turn_id", F.lit("reported").alias("confidence"),
        F.when(blocked, "Codex 最终回答报告任务受阻").otherwise("最终回答报告完成并包含验证描述，尚未与独立产出绑定").alias("evidence"), "source_refs",
    )


def resource_events(records: DataFrame) -> DataFrame:
    """Activity events of collaboration records."""
    rows = records.where((F.col("source") == "feishu") & F.col("resource_type").isNotNull() & F.col("resource_id").isNotNull())
    label = F.coalesce(
        blank_to_null(trim_ws(F.col("project_hint"))), blank_to_null(trim_ws(F.col("cwd"))), F.lit(fv.COLLAB_DEFAULT_LABEL)
    )
    kind = F.coalesce("activity_kind", infer_resource_kind(F.col("resource_type"), F.col("resource_status")))
    open_ = F.col("access_status") == "available"
    summary = concise_summary(F.col("content"))
    feishu = F.lit("feishu")
    page = F.concat(F.lit("raw/feishu/daily/"), F.col("date").cast("string"), F.lit(".md"))
    refs = _refs(
        (F.col("resource_url").isNotNull() & (F.col("resource_url") != ""), source_ref(feishu, "打开飞书来源", url=F.col("resource_url"))),
        (F.lit(True), source_ref(feishu, "飞书每日来源", page, excerpt=summary)),
        (F.lit(True), source_ref(feishu, "飞书原始事件", F.col("source_path"), line=F.col("source_line"), excerpt=summary)),
    )
    object_key = F.concat_ws(":", feishu, "resource_type", "resource_id")
    task_key = F.concat_ws(":", feishu, project_key(label), F.col("resource_type"), F.col("resource_id"))
    return rows.select(
        F.concat(F.lit("feishu:"), "event_id").alias("id"), kind.alias("kind"),
        F.coalesce("occurred_at", "captured_at").alias("occurred_at"),
        F.coalesce("updated_at", "captured_at").alias("observed_at"), F.col("date").alias("local_date"),
        F.lit("source").alias("time_basis"),
        concise_title(F.coalesce(blank_to_null(F.col("title")), F.col("content")), "飞书活动").alias("title"),
        summary.alias("summary"), project_key(label).alias("project_key"), label.alias("project_label"),
        F.when(kind.isin(*fv.TASK_KINDS), task_key).alias("task_key"), object_key.alias("object_key"), "session_id",
        "turn_id", F.when(open_, "observed").otherwise("reported").alias("confidence"),
        F.when(open_, F.concat(F.lit("只读同步已捕获"), module_label(F.col("resource_type")), F.lit("及来源版本")))
        .otherwise("来源已删除或访问权限被撤回，历史证据仅供追溯").alias("evidence"),
        refs.alias("source_refs"),
    )


def build_turns(records: DataFrame, titles: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """All activity events of captured records, before identities are merged."""
    turns = described_turns(records, titles, seq)
    resources = resource_events(dedup_records(records, seq).where(F.col("source") == "feishu"))
    return turn_events(turns).unionByName(completion_events(turns)).unionByName(resources)


def resource_pairs(records: DataFrame) -> DataFrame:
    rows = records.where((F.col("source") == "feishu") & F.col("resource_type").isNotNull() & F.col("resource_id").isNotNull())
    text = lambda value, default: F.coalesce(blank_to_null(value), F.lit(default))
    ask = F.concat(
        F.lit("飞书"), module_label(F.col("resource_type")), F.lit("："), text(F.col("title"), "未命名记录"),
        F.lit("\n状态："), text(F.col("resource_status"), fv.COLLAB_RECORDED),
    )
    return rows.select(
        F.substring(ids.digest(F.lit("feishu"), F.col("event_id")), 1, 24).alias("id"), "source", "date",
        F.coalesce("session_id", F.concat_ws(":", F.lit("feishu"), "resource_type", "resource_id")).alias("session_id"),
        F.coalesce("turn_id", F.substring(F.sha2(F.coalesce("resource_version", "event_id"), 256), 1, 20)).alias("turn_id"),
        F.lit("").alias("conversation_id"), F.array("event_id").alias("source_event_ids"),
        F.coalesce("occurred_at", "captured_at").alias("captured_at"),
        F.coalesce(blank_to_null(F.col("project_hint")), blank_to_null(F.col("cwd")), F.lit("飞书")).alias("cwd"),
        text(F.col("title"), "飞书记录").alias("title"), text(F.col("resource_url"), "").alias("url"), "resource_type",
        "resource_id", ask.alias("prompt_content"), text(F.col("content"), "该来源只保留了状态与追溯信息。").alias("stop_content"),
    )


def build_pairs(records: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Question and answer of each turn: the prompt read first and the answer read last, both required."""
    rows = records.where((F.col("source") != "feishu") & F.col("event").isin(PROMPT, STOP))
    rows = rows.where(F.col("session_id").isNotNull() & F.col("turn_id").isNotNull() & F.col("event_id").isNotNull())
    at = F.col(seq)
    ask = F.struct("event_id", "captured_at", "date", "conversation_id", "cwd", "title", "url", "content")
    grouped = rows.groupBy(*TURN).agg(
        F.min_by(ask, F.when(F.col("event") == PROMPT, at)).alias("prompt"),
        F.max_by(F.struct("event_id", "content"), F.when(F.col("event") == STOP, at)).alias("stop"),
    )
    paired = grouped.where(F.col("prompt").isNotNull() & F.col("stop").isNotNull())
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    pairs = paired.select(
        F.substring(ids.digest(F.col("source"), F.col("prompt.event_id"), F.col("stop.event_id")), 1, 24).alias("id"),
        "source", "prompt.date", "session_id", "turn_id", text("prompt.conversation_id").alias("conversation_id"),
        F.array("prompt.event_id", "stop.event_id").alias("source_event_ids"), "prompt.captured_at",
        text("prompt.cwd").alias("cwd"), text("prompt.title").alias("title"), text("prompt.url").alias("url"),
        F.lit(None).cast("string").alias("resource_type"), F.lit(None).cast("string").alias("resource_id"),
        text("prompt.content").alias("prompt_content"), text("stop.content").alias("stop_content"),
    )
    both = pairs.unionByName(resource_pairs(records))
    folder = F.when(F.col("source") == "chatgpt_web", "chatgpt").when(F.col("source") == "feishu", "feishu").otherwise("codex")
    return both.withColumn(
        "daily_path", F.concat(F.lit("raw/"), folder, F.lit("/daily/"), F.col("date").cast("string"), F.lit(".md"))
    )


def pair_messages(messages: DataFrame, block: int = 4096) -> DataFrame:
    """Transcript rows (conv_id, turn, role) to (user turn, first assistant turn before the next user)."""
    numbered = running_total(
        messages, ["conv_id"], ["turn"], ordinal_block(F.col("turn"), block), (F.col("role") == "user").cast("int"), "ask"
    )
    grouped = numbered.where(F.col("ask") > 0).groupBy("conv_id", "ask").agg(
        F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("user_turn"),
        F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("assistant_turn"),
    )
    return grouped.where(F.col("assistant_turn").isNotNull()).select("conv_id", "user_turn", "assistant_turn")


def latest_stop(events: DataFrame, records: DataFrame) -> DataFrame:
    """Last answer of the turn an event belongs to."""
    turn = ["session_id", "turn_id"]
    last = records.where(F.col("event") == STOP).groupBy(*turn).agg(
        F.max_by("event_id", F.struct("captured_at", "event_id")).alias("stop_event_id")
    )
    return events.join(last, turn, "inner")


def turn_problem(events: DataFrame) -> DataFrame:
    """Each completion with the first started or progress event of its turn."""
    turn = ["session_id", "turn_id"]
    asked = events.where(F.col("kind").isin("task_started", "task_progress")).groupBy(*turn).agg(
        F.min_by(F.struct(F.col("id").alias("problem_id"), F.col("summary").alias("problem")), F.struct("occurred_at", "id")).alias("p")
    )
    done = events.where(F.col("kind") == "task_completed")
    return done.join(asked, turn, "left").select(*turn, "id", "p.problem_id", "p.problem")


def build_diagnostics(records: DataFrame, titles: DataFrame, rejects: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """One row of counters about a build. Each input is aggregated once and the single rows are added up."""
    turns = turn_groups(records, seq)
    kept = turns.where(~F.col("automated") & (F.col("requests") > 0)).join(
        titles.select("session_id", F.lit(True).alias("indexed")), "session_id", "left"
    )
    codex = F.col("source") != "chatgpt_web"
    indexed = F.coalesce("indexed", F.lit(False))
    parts = [
        ("malformed_lines", rejects.agg(F.count(F.lit(1)).alias("n"))),
        ("duplicate_records", records.groupBy("event_id").agg((F.count(F.lit(1)) - 1).alias("d")).agg(F.sum("d").alias("n"))),
        ("excluded_automations", turns.where("automated").agg(F.count(F.lit(1)).alias("n"))),
        ("excluded_supporting_sessions", kept.where(codex & ~indexed).agg(F.count(F.lit(1)).alias("n"))),
        ("codex_sessions", kept.where(codex & indexed).agg(F.count_distinct("session_id").alias("n"))),
        ("chatgpt_conversations", kept.where(~codex).agg(
            F.count_distinct(F.coalesce("prompt.conversation_id", "session_id")).alias("n"))),
        ("collab_records", records.where(F.col("source") == "feishu").agg(F.count_distinct("event_id").alias("n"))),
    ]
    rows = [df.select(F.lit(name).alias("counter"), F.coalesce("n", F.lit(0)).cast("long").alias("n")) for name, df in parts]
    return reduce(DataFrame.unionByName, rows)
