"""Capture streams: reading, deduplication, pairing, quiet sessions, staleness, incremental refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracefold import fixed_values as fv
from tracefold.functions.ids import stable_id
from tracefold.functions.text import redact, trim_ws
from tracefold.sources.captures import parse_capture_lines
from tracefold.operators.once import append_once, read_once

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store; a cluster that names its own provider keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, ROCKSDB)


def stream_captures(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Capture records of log files that have landed; a writer rotates its log, and whole files are moved here."""
    source = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    lines = source.text(path).select(
        "value", F.col("_metadata.file_path").alias("source_path"), F.lit(None).cast("int").alias("source_line")
    )
    records, _ = parse_capture_lines(lines)
    return records


def dedup_captures(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First copy of each event id within the watermark; older repeats are caught by ``append_batch``."""
    return stream.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def append_batch(path: str, stream_id: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: rows whose id the table does not hold yet, under whatever date, appended by date.

    Read the table with ``read_once``. ``stream_id`` names the stream's checkpoint (a new checkpoint is a new name): a
    batch that is replayed after its commit then need not be planned. Without it the batch's ids are found, and it adds
    nothing either.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_once(batch, path, key="event_id", partition=("date",), batch_id=f"{stream_id}:{number}" if stream_id else None)

    return write


def bootstrap_cutoff(stream: DataFrame, last_stored: str | None, now: str, lookback_hours: int = 24) -> DataFrame:
    """On a first run, only events after the last stored one, or after a look-back when nothing is stored."""
    edge = F.lit(last_stored).cast("timestamp") if last_stored else F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(lookback_hours))
    return stream.where(F.col("captured_at") > edge)


def stream_pairs(stream: DataFrame, bound: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Prompt and answer of a turn joined within a time bound; a later answer gives a later row.

    Readers of the result keep the latest ``stop_at`` per turn, as the batch pairing does.
    """
    prompts = stream.where(F.col("event") == "UserPromptSubmit").select(
        F.col("session_id").alias("p_session"), F.col("turn_id").alias("p_turn"), F.col("event_id").alias("prompt_id"),
        F.col("captured_at").alias("prompt_at"), F.col("content").alias("prompt_content"),
    ).withWatermark("prompt_at", delay)
    stops = stream.where(F.col("event") == "Stop").select(
        "session_id", "turn_id", F.col("event_id").alias("stop_id"), F.col("captured_at").alias("stop_at"), F.col("content").alias("stop_content")
    ).withWatermark("stop_at", delay)
    near = (F.col("stop_at") >= F.col("prompt_at")) & (F.col("stop_at") <= F.col("prompt_at") + F.expr(f"INTERVAL {bound}"))
    same = (F.col("session_id") == F.col("p_session")) & (F.col("turn_id") == F.col("p_turn"))
    return prompts.join(stops, same & near).drop("p_session", "p_turn")


def close_quiet_sessions(stream: DataFrame, key: str = "session_id", quiet: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Sessions that have been silent for ``quiet``: emitted once, when the watermark passes their end."""
    windowed = stream.withWatermark("captured_at", delay).groupBy(key, F.session_window("captured_at", quiet).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("events"), F.max("captured_at").alias("last_seen")).select(
        key, F.col("w.start").alias("first_seen"), "last_seen", F.col("w.end").alias("quiet_until"), "events"
    )


def reopened_sessions(batch: DataFrame, closed: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions already closed that a batch adds evidence to: late rows are kept, and reopen their topic."""
    ended = closed.groupBy(key).agg(F.max("quiet_until").alias("quiet_until"))
    return batch.join(ended, key).groupBy(key).agg(F.count(F.lit(1)).alias("new_events"), F.max("captured_at").alias("last_seen"))


def refresh_partitions(path: str, events_path: str, build: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("local_date", "project_key")):
    """``foreachBatch`` sink: append events, then rebuild only the partitions the batch touched.

    Partitions are overwritten dynamically, so untouched days and projects are neither read nor written.
    """

    def write(batch: DataFrame, _: int) -> None:
        verdicts = append_once(batch, events_path, key="id", partition=keys)
        # Replays too: the batch may have been appended by a writer that died before it rebuilt anything.
        touched = verdicts.where("verdict <> 'rejected'").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        scoped = read_once(batch.sparkSession, events_path).join(touched, same, "left_semi")
        build(scoped).write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return write


# --- state carried per key -----------------------------------------------------------------------
_SESSION_STATE = "session_id string, cwd string, originator string, version string, subagent boolean, turn string"
_SESSION_FIELDS = ["session_id", "cwd", "originator", "version", "subagent", "turn"]
SESSION_OUTPUT = "file string, line long, event string, captured_at timestamp, session_id string, turn_id string, cwd string, content string"


class ProducerSessions(StatefulProcessor):
    """Session context and active turn of one producer file, carried from batch to batch."""

    def __init__(self, originator: str = "Codex Desktop"):
        self.originator = originator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.context = handle.getValueState("context", _SESSION_STATE)

    @staticmethod
    def _supported(version: str | None) -> bool:
        parts = (version or "").split(".")
        if len(parts) < 3 or not (parts[0].isdigit() and parts[1].isdigit()):
            return False
        return int(parts[0]) == fv.VERIFIED_PRODUCER_MAJOR and int(parts[1]) in fv.VERIFIED_PRODUCER_MINORS

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.context.get() if self.context.exists() else None
        now = dict(zip(_SESSION_FIELDS, held)) if held is not None else dict.fromkeys(_SESSION_FIELDS)
        out = []
        batch = pd.concat(list(rows)).sort_values("line")  # one file's lines of one micro-batch
        text = lambda value: value if isinstance(value, str) and value else None
        for row in batch.itertuples(index=False):
            turn = text(row.turn_id)
            if row.type == "session_meta":
                now.update(
                    session_id=text(row.meta_id), cwd=text(row.cwd), originator=text(row.originator), version=text(row.producer_version),
                    subagent=bool(row.subagent),
                )
                continue
            if now["originator"] != self.originator or not self._supported(now["version"]) or now["subagent"] or not now["session_id"]:
                continue
            if row.type == "turn_context" and turn:
                now["turn"], now["cwd"] = turn, text(row.cwd) or now["cwd"]
            elif row.type == "event_msg" and row.event_type == "task_started":
                now["turn"] = turn
            elif row.type == "event_msg" and row.event_type in ("user_message", "task_complete", "turn_aborted"):
                prompt = row.event_type == "user_message"
                at = row.timestamp if pd.notna(row.timestamp) else row.completed_at
                named = now["turn"] if prompt else (turn or now["turn"])
                content = text(row.message) if prompt else fv.ABORTED_TEXT if row.event_type == "turn_aborted" else text(row.answer)
                if pd.notna(at) and named and content:
                    out.append((key[0], row.line, "UserPromptSubmit" if prompt else "Stop", at, now["session_id"], named, now["cwd"], content))
                if not prompt and named == now["turn"]:
                    now["turn"] = None
        self.context.update(tuple(now[f] for f in _SESSION_FIELDS))
        yield pd.DataFrame(out, columns=["file", "line", "event", "captured_at", "session_id", "turn_id", "cwd", "content"])

    def close(self) -> None:
        pass


def stateful_producer_sessions(records: DataFrame) -> DataFrame:
    """Streaming twin of ``read_producer_sessions`` over parsed producer lines."""
    use_state_store(records.sparkSession)
    rows = records.groupBy("file").transformWithStateInPandas(
        statefulProcessor=ProducerSessions(), outputStructType=SESSION_OUTPUT, outputMode="Append", timeMode="None"
    )
    content = trim_ws(redact(F.col("content")))
    event_id = stable_id("codex:", 32, *[F.col(c) for c in ("event", "session_id", "turn_id", "cwd")], content)
    return rows.withColumn("event_id", event_id).withColumn("content", content)


class SilenceAlarm(StatefulProcessor):
    """Emits a source when nothing arrived from it for a while (processing time)."""

    def __init__(self, seconds: float):
        self.wait = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(chunk["captured_at"].max() for chunk in rows)
        held = self.last.get()[0] if self.last.exists() else None
        self.last.update((newest if held is None else max(newest, held),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield pd.DataFrame({
            "source": pd.Series(dtype="object"), "last_event_at": pd.Series(dtype="datetime64[ns]"), "stale": pd.Series(dtype="bool"),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"source": [key[0]], "last_event_at": [self.last.get()[0]], "stale": [True]})

    def close(self) -> None:
        pass


def stream_staleness(stream: DataFrame, seconds: float = fv.STALE_HOURS * 3600) -> DataFrame:
    use_state_store(stream.sparkSession)
    return stream.groupBy("source").transformWithStateInPandas(
        statefulProcessor=SilenceAlarm(seconds), outputStructType="source string, last_event_at timestamp, stale boolean",
        outputMode="Update", timeMode="ProcessingTime",
    )


# --- incremental module sync ---------------------------------------------------------------------
def sync_window(state: DataFrame, now: Column) -> DataFrame:
    """Since and until per module: an hour before its cursor, thirty days back on a first run, thirty ahead."""
    since = F.coalesce(
        F.col("cursor") - F.make_interval(mins=F.lit(fv.SYNC_OVERLAP_MINUTES)), now - F.make_interval(days=F.lit(fv.SYNC_FIRST_DAYS))
    )
    return state.withColumn("since", since).withColumn("until", now + F.make_interval(days=F.lit(fv.SYNC_AHEAD_DAYS)))


def incremental_rows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each module inside its window. The window table has one row per module and is tiny."""
    return rows.join(windows.select("module", "since", "until"), "module").where(
        (F.col("updated_at") >= F.col("since")) & (F.col("updated_at") <= F.col("until"))
    ).drop("since", "until")


def advance_cursors(state: DataFrame, accepted: DataFrame, now: Column) -> DataFrame:
    """Next cursor per module: the newest accepted update, else the old cursor, else now."""
    newest = accepted.groupBy("module").agg(F.max("updated_at").alias("_newest"), F.count(F.lit(1)).alias("accepted"))
    joined = state.join(newest, "module", "left")
    return joined.withColumn("cursor", F.coalesce("_newest", "cursor", now)).withColumn("accepted", F.coalesce("accepted", F.lit(0))).drop("_newest")


def module_failures(state: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Module states after a run: failures count up and back off, successes clear, other modules stand.

    ``state`` (module, failure_count, retry_at, access_status); ``results`` (module, ok, category, retry_after_ms).
    """
    from tracefold.functions.collab import access_status
    from tracefold.functions.dates import backoff_until

    joined = state.join(results, "module", "left")
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    count = F.when(F.col("ok").isNull(), F.col("failure_count")).when(failed, F.coalesce("failure_count", F.lit(0)) + 1).otherwise(0)
    retry = backoff_until(now, F.coalesce("failure_count", F.lit(0)) + 1, F.col("retry_after_ms"))
    return joined.select(
        "module", count.alias("failure_count"),
        F.when(failed, retry).when(F.col("ok").isNull(), F.col("retry_at")).alias("retry_at"),
        F.when(failed, access_status(F.col("category"))).when(F.col("ok"), "available").otherwise(F.col("access_status")).alias("access_status"),
        failed.alias("failed"),
    )


def run_state(modules: DataFrame, accepted: int | Column) -> DataFrame:
    """Status of a run over its modules: succeeded, partial or failed, and the earliest retry."""
    got = accepted if isinstance(accepted, Column) else F.lit(accepted)
    rows = modules.agg(F.count_if("failed").alias("failed_modules"), F.min("retry_at").alias("retry_at"))
    return rows.withColumn("status", F.when(F.col("failed_modules") == 0, "succeeded").when(got > 0, "partial").otherwise("failed"))
