"""Selecting work messages, source health, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.functions.collab import is_noise, is_safe_message, is_substantive
from tracefold.functions.dates import is_stale
from tracefold.operators.sequence import ordinal_block, previous_value
from tracefold.session import cut_lineage


def capture_message(user: str, text: Column) -> Column:
    """Whether a message is kept on its own account."""
    safe = is_safe_message(F.col("chat_type"), F.col("sender_type"), F.col("msg_type"), text)
    mentioned = F.coalesce(F.exists("mentions", lambda m: m.isin(user, "all-current-user")), F.lit(False))
    return safe & ~is_noise(F.trim(text)) & (mentioned | is_substantive(text))


def select_messages(messages: DataFrame, user: str, keys: tuple[str, ...] = ("chat_id",), order: tuple[str, ...] = ("position",)) -> DataFrame:
    """Kept messages, and the safe message just before and after each kept mention, marked ``context_only``.

    Neighbours are found with blocked windows over (chat, position); a busy chat is cut into blocks. Where messages
    have a column ``selected_group``, those of a group that was not selected are refused before anything else.
    """
    if "selected_group" in messages.columns:
        messages = messages.where((F.col("chat_type") != "group") | F.coalesce("selected_group", F.lit(False)))
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = capture_message(user, text)
    mentioned = F.coalesce(F.exists("mentions", lambda m: m.isin(user, "all-current-user")), F.lit(False))
    safe = is_safe_message(F.col("chat_type"), F.col("sender_type"), F.col("msg_type"), text)
    place = [*keys, *order]
    flags = messages.select(
        *place, F.coalesce(kept, F.lit(False)).alias("kept"), F.coalesce(kept & mentioned, F.lit(False)).alias("pulls"), safe.alias("safe")
    )
    # Two ordered passes over flags alone; the texts are joined to the chosen places.
    rows = cut_lineage(flags)
    at = F.col(order[0])
    rows = previous_value(rows, list(keys), list(order), ordinal_block(at), F.struct("pulls"), "before")
    flipped = rows.withColumn("_back", -at)
    rows = previous_value(flipped, list(keys), ["_back"], ordinal_block(F.col("_back")), F.struct("pulls"), "after")
    near = F.coalesce(F.col("before.pulls"), F.lit(False)) | F.coalesce(F.col("after.pulls"), F.lit(False))
    chosen = rows.where(F.col("kept") | (F.col("safe") & near)).select(*place, (~F.col("kept")).alias("context_only"))
    return messages.join(chosen, place)


def source_health(records: DataFrame, config: DataFrame, now: Column, hours: float = fv.STALE_HOURS) -> DataFrame:
    """State of each configured source (source, configured, supported, error): ready, starting or unavailable."""
    last = records.groupBy("source").agg(F.max("captured_at").alias("last_event_at"))
    rows = config.join(last, "source", "left").withColumn("stale", is_stale(F.col("last_event_at"), now, hours))
    down = ~F.col("configured") | ~F.col("supported") | (F.coalesce("error", F.lit("")) != "")
    state = F.when(down, "unavailable").when(F.col("last_event_at").isNull() | F.col("stale"), "starting").otherwise("ready")
    return rows.withColumn("state", state)


def required_scopes(enabled: DataFrame, scopes: DataFrame) -> DataFrame:
    """Distinct permissions of the enabled modules: (owner, scope)."""
    return enabled.join(scopes, "module").select("owner", "scope").distinct()


def module_scopes(spark) -> DataFrame:
    rows = [(module, scope) for module, names in fv.COLLAB_SCOPES.items() for scope in names]
    return spark.createDataFrame(rows, "module string, scope string")


def missing_scopes(required: DataFrame, granted: DataFrame) -> DataFrame:
    return required.select("owner", "scope").exceptAll(granted.select("owner", "scope").distinct()).distinct()


def pending_backlog(records: DataFrame, processed: DataFrame, files: int | None = None) -> DataFrame:
    """Unprocessed records of all days, or of the newest ``files``, whose list then prunes partitions."""
    recent = records
    if files is not None:
        recent = records.join(records.select("date").distinct().orderBy(F.col("date").desc()).limit(files), "date", "left_semi")
    return recent.join(processed.select("event_id").distinct(), "event_id", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
