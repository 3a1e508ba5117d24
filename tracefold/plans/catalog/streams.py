"""Streaming queries over the given events, drained with ``availableNow`` into tables that are then read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracefold.operators.metrics import calendar_days
from tracefold.operators.once import append_once, compact_once, read_once
from tracefold.plans.catalog import query, with_ctes
from tracefold.plans.catalog.conversations import PRODUCER, producer_rows
from tracefold.plans.catalog.given_sql import ACT, RES
from tracefold.session import ensure_checkpoint_dir
from tracefold.sources import given_tables as g
from tracefold.streaming import captures as sc
from tracefold.streaming.pairing import paired_turns, stream_turns
from tracefold.streaming.silence import session_states, source_states


def work_dir(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_of(spark, sf, table: str):
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    stream = spark.readStream.schema(df.schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)
    for field in df.schema:
        if field.dataType.typeName() == "timestamp_ntz":
            stream = stream.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return stream


def drain(stream, spark, name: str, mode: str = "append"):
    """Run a stream to its end into a parquet table and read the table."""
    out = work_dir(spark, name)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-cursor").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_with(stream, spark, name: str, sink):
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", work_dir(spark, f"{name}-cursor")).trigger(availableNow=True).start()
    q.awaitTermination()


def event_captures(spark, sf):
    e = stream_of(spark, sf, "events")
    number = F.col("event_id")
    return e.select(
        F.concat(F.lit("v"), F.floor(number / 2).cast("string")).alias("event_id"), F.col("ts").alias("captured_at"), F.to_date("ts").alias("date"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.concat(F.lit("t"), F.floor(number / 2 % 40).cast("string")).alias("turn_id"),
        F.when(number % 2 == 0, "UserPromptSubmit").otherwise("Stop").alias("event"), F.col("props").alias("content"), number.alias("n"), F.col("event_type").alias("source"),
    )


@query("stream_dedup", "SELECT count(DISTINCT event_id // 2) AS kept FROM events")
def _stream_dedup(spark, sf):
    rows = drain(sc.dedup_captures(event_captures(spark, sf), "60 days").select("event_id"), spark, "dedup")
    return rows.agg(F.count(F.lit(1)).alias("kept"))


@query("stream_append", "SELECT CAST(ts AS DATE) AS date, count(*) AS rows FROM events GROUP BY 1")
def _stream_append(spark, sf):
    path = work_dir(spark, "table")
    stream = event_captures(spark, sf).withColumn("event_id", F.concat(F.lit("n"), F.col("n").cast("string")))
    for attempt in ("first", "again"):  # the second run replays everything and must add nothing
        drain_with(stream, spark, f"append-{attempt}", sc.append_batch(path, attempt))
    return read_once(spark, path).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query("append_once", """
SELECT event_id // 2 AS pair, min(event_id) AS n, CASE WHEN min(event_id) % 7 = 3 THEN NULL ELSE CAST(min_by(ts, event_id) AS DATE) END AS date FROM events GROUP BY event_id // 2""")
def _append_once(spark, sf):
    """Events in three batches; each id comes twice, later under another date or none, and every batch is replayed."""
    path, n = work_dir(spark, "once"), F.col("event_id")
    rows = g.read(spark, sf, "events").select(
        F.concat(F.lit("p"), F.floor(n / 2).cast("string")).alias("id"), F.floor(n / 2).alias("pair"), n.alias("n"),
        F.when(n % 7 != 3, F.to_date("ts")).alias("date"),
    )
    batches = [rows.where(n % 2 == 0), rows.where(n % 3 == 0), rows]
    for number in (0, 1, 0, 2, 1):
        append_once(batches[number], path, key="id", seq="n", partition=("date",), batch_id=f"b{number}" if number else None)
    compact_once(spark, path, key="id")
    append_once(rows, path, key="id", partition=("date",))
    return read_once(spark, path).select("pair", "n", "date")


@query("stream_bootstrap_cutoff", "SELECT event_id AS n FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def _stream_bootstrap_cutoff(spark, sf):
    return drain(sc.bootstrap_cutoff(event_captures(spark, sf), None, "2024-01-21 00:00:00").select("n"), spark, "cutoff")


@query("stream_pairs", """
WITH e AS (SELECT 'u' || user_id AS s, 't' || ((event_id // 2) % 40) AS t, 'v' || (event_id // 2) AS id, ts, event_id FROM events)
SELECT p.id AS prompt_id, x.id AS stop_id FROM e p JOIN e x ON p.s = x.s AND p.t = x.t AND x.ts BETWEEN p.ts AND p.ts + INTERVAL 1 DAY WHERE p.event_id % 2 = 0 AND x.event_id % 2 = 1""")
def _stream_pairs(spark, sf):
    return drain(sc.stream_pairs(event_captures(spark, sf)).select("prompt_id", "stop_id"), spark, "pairs")


@query("stream_turns", """
WITH e AS (SELECT event_type AS source, 'u' || user_id AS session_id, 't' || ((event_id // 2) % 40) AS turn_id, 'v' || (event_id // 2) AS id, CAST(ts AS TIMESTAMP) AS ts, event_id % 2 = 0 AS asks FROM events)
SELECT source, session_id, turn_id, arg_min(id, (ts, id)) FILTER (asks) AS prompt_id, arg_max(id, (ts, id)) FILTER (NOT asks) AS stop_id FROM e GROUP BY ALL
HAVING count(*) FILTER (NOT asks) > 0""")
def _stream_turns(spark, sf):
    """Every turn that has an answer; questions still waiting are told by a timer, which a drained stream does not reach."""
    rows = drain(stream_turns(event_captures(spark, sf)), spark, "turns")
    return paired_turns(rows).where(F.col("stop_id").isNotNull()).select("source", "session_id", "turn_id", "prompt_id", "stop_id")


@query("stream_quiet_sessions", """
WITH e AS (SELECT 'u' || user_id AS session_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
runs AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS run FROM e)
SELECT session_id, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) + INTERVAL 2 HOUR AS quiet_until, count(*) AS events FROM runs GROUP BY session_id, run
HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _stream_quiet_sessions(spark, sf):
    return drain(sc.close_quiet_sessions(event_captures(spark, sf)), spark, "quiet")


@query("stream_refresh", with_ctes(ACT, """
SELECT local_date, project_key, count(DISTINCT CASE WHEN kind LIKE 'task%' THEN task_key END) AS tasks FROM act WHERE kind LIKE 'task%' OR kind IN ('output_created', 'knowledge_created', 'knowledge_updated') GROUP BY ALL"""))
def _stream_refresh(spark, sf):
    from tracefold.sources.given_tables import activity_columns

    out, events = work_dir(spark, "days"), work_dir(spark, "events")

    def build(scoped):
        key = F.concat_ws("|", "local_date", "project_key")
        days = calendar_days(scoped.withColumn("day", F.col("local_date")).withColumn("local_date", key))
        return days.select(
            F.to_date(F.substring_index("local_date", "|", 1)).alias("local_date"), F.substring_index("local_date", "|", -1).alias("project_key"), "tasks", "outputs", "knowledge"
        )

    drain_with(activity_columns(stream_of(spark, sf, "events")), spark, "refresh", sc.refresh_partitions(out, events, build))
    return spark.read.parquet(out).select("local_date", "project_key", "tasks")


@query("stream_producer_sessions", with_ctes(PRODUCER, """
SELECT 'f' || user_id AS file, line, CASE event_type WHEN 'click' THEN 'UserPromptSubmit' ELSE 'Stop' END AS event, turn_id FROM placed WHERE turn_id IS NOT NULL"""))
def _stream_producer_sessions(spark, sf):
    lines = work_dir(spark, "lines")
    producer_rows(spark, sf).write.parquet(lines)
    stream = spark.readStream.schema(spark.read.parquet(lines).schema).option("maxFilesPerTrigger", 1000).parquet(lines)
    return drain(sc.stateful_producer_sessions(stream).select("file", "line", "event", "turn_id"), spark, "sessions")


@query("sync_window", """
WITH st AS (SELECT event_type AS module, CASE WHEN event_type <> 'view' THEN max(ts) - INTERVAL 5 DAY END AS cursor FROM events GROUP BY 1)
SELECT event_id FROM events JOIN st ON module = event_type WHERE ts >= coalesce(cursor - INTERVAL 60 MINUTE, TIMESTAMP '2024-02-10' - INTERVAL 30 DAY) AND ts <= TIMESTAMP '2024-02-10' + INTERVAL 30 DAY""")
def _sync_window(spark, sf):
    rows = g.read(spark, sf, "events").select("event_id", F.col("event_type").alias("module"), F.col("ts").alias("updated_at"))
    state = rows.groupBy("module").agg(F.max("updated_at").alias("last")).select(
        "module", F.when(F.col("module") != "view", F.col("last") - F.expr("INTERVAL 5 DAYS")).alias("cursor")
    )
    return sc.incremental_rows(rows, sc.sync_window(state, F.lit("2024-02-10").cast("timestamp"))).select("event_id")


@query("advance_cursors", with_ctes(RES, """
old AS (SELECT resource_type AS module, min(captured_at) AS cursor FROM res GROUP BY 1), fresh AS (SELECT resource_type AS module, max(captured_at) AS newest, count(*) AS accepted FROM res WHERE resource_type <> 'base' AND o_orderkey % 3 = 0 GROUP BY 1)""", """
SELECT module, coalesce(newest, cursor) AS cursor, coalesce(accepted, 0) AS accepted FROM old LEFT JOIN fresh USING (module)"""))
def _advance_cursors(spark, sf):
    rows = g.orders_as_resources(spark, sf).withColumnRenamed("resource_type", "module")
    state = rows.groupBy("module").agg(F.min("captured_at").alias("cursor"))
    accepted = rows.where((F.col("module") != "base") & (F.col("ingest_seq") % 3 == 0))
    return sc.advance_cursors(state, accepted, F.lit("2024-01-01").cast("timestamp"))


@query("module_failures", """
WITH st AS (SELECT c_custkey AS module, c_custkey % 4 AS failure_count FROM customer)
SELECT module, CASE WHEN module % 3 = 0 THEN failure_count WHEN module % 3 = 1 THEN failure_count + 1 ELSE 0 END AS failure_count,
  CASE WHEN module % 3 = 1 THEN TIMESTAMP '2024-01-01' + to_seconds(60 * pow(2, failure_count)) END AS retry_at,
  CASE WHEN module % 3 = 0 THEN 'unknown' WHEN module % 3 = 1 THEN 'revoked' ELSE 'available' END AS access_status, module % 3 = 1 AS failed FROM st""")
def _module_failures(spark, sf):
    key = F.col("c_custkey")
    base = g.read(spark, sf, "customer")
    state = base.select(key.alias("module"), (key % 4).alias("failure_count"), F.lit(None).cast("timestamp").alias("retry_at"), F.lit("unknown").alias("access_status"))
    results = base.where(key % 3 != 0).select(key.alias("module"), (key % 3 == 2).alias("ok"), F.lit("permission").alias("category"), F.lit(0).alias("retry_after_ms"))
    return sc.module_failures(state, results, F.lit("2024-01-01").cast("timestamp"))


# --- silence -------------------------------------------------------------------------------------
def landed_out_of_order(spark, sf, key):
    """Events landed in blocks of six days, every fifth one block late, and one far event that lets the watermark pass all."""
    path = work_dir(spark, "landed")
    rows = g.read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("captured_at"), key)
    day = F.datediff("captured_at", F.lit("2024-01-01"))
    rows = rows.withColumn("block", F.floor(day / 6) + (F.col("event_id") % 5 == 0).cast("int"))
    last = rows.agg(F.max("captured_at").alias("at"), F.max("block").alias("block")).first()
    end = rows.limit(1).withColumn("captured_at", F.lit(last.at) + F.make_interval(years=F.lit(1))).withColumn("event_id", F.lit(-1).cast(rows.schema["event_id"].dataType))
    end = end.withColumn(rows.columns[2], F.lit("~end"))
    for block in range(last.block + 1):
        rows.where(F.col("block") == block).repartition(4).write.mode("append").parquet(path)
    end.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def silence_sql(key: str, label: str, wait: str, quiet: str, active: str) -> str:
    return f"""
WITH e AS (SELECT {key} AS {label}, ts, lag(ts) OVER w AS prev, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id))
SELECT {label}, '{quiet}' AS state, ts + INTERVAL {wait} AS at, ts AS last_seen FROM e WHERE next IS NULL OR next >= ts + INTERVAL {wait}
UNION ALL SELECT {label}, '{active}', ts, ts FROM e WHERE ts >= prev + INTERVAL {wait}"""


@query("stream_session_states", silence_sql("'u' || user_id", "session_id", "2 HOUR", "ready", "reopened"))
def _stream_session_states(spark, sf):
    stream = landed_out_of_order(spark, sf, F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"))
    return drain(session_states(stream, delay="13 days"), spark, "session-states").where("session_id <> '~end'")


@query("stream_source_states", silence_sql("event_type || (user_id % 40)", "source", "36 HOUR", "stale", "fresh"))
def _stream_source_states(spark, sf):
    stream = landed_out_of_order(spark, sf, F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("source"))
    return drain(source_states(stream, delay="13 days"), spark, "source-states").where("source <> '~end'")
