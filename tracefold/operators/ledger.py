"""The settlement ledger: receipts, merges, processed events, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.operators.common import dealt
from tracefold.operators.sequence import first_rows


def same_event_sets(left: DataFrame, right: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Per key, whether two bridges (key, event_id) hold the same set of events: (key, same).

    Counting shared and distinct events needs no set per key, so a key may own any number of events. ``tasks`` deals
    rows to so many tasks, where their number is known to grow.
    """
    l = dealt(left.select(key, "event_id"), tasks, key, "event_id").distinct().withColumn("_l", F.lit(1))
    r = dealt(right.select(key, "event_id"), tasks, key, "event_id").distinct().withColumn("_r", F.lit(1))
    both = l.join(r, [key, "event_id"], "full_outer")
    return both.groupBy(key).agg((F.count_if(F.col("_l").isNull() | F.col("_r").isNull()) == 0).alias("same"))


def validate_receipts(
    receipts: DataFrame, receipt_events: DataFrame, contract: DataFrame, contract_events: DataFrame
) -> DataFrame:
    """Each contract topic and each stray receipt with a verdict; null ``error`` means accepted.

    ``receipts`` (id, status, reason, seq), bridges (id, event_id). A receipt that is blank, repeated or
    outside the contract fails every topic of its run, as it does in the reference; the run's fault is a
    scalar over one aggregate, not a collected list.
    """
    known = contract.select("id").withColumn("_known", F.lit(True))
    counted = receipts.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("status", "reason"), "seq").alias("r"))
    judged = counted.join(known, "id", "full_outer")
    stray = F.col("copies").isNotNull() & (F.col("_known").isNull() | (F.coalesce("id", F.lit("")) == ""))
    repeated = F.coalesce(F.col("copies") > 1, F.lit(False))
    sets = same_event_sets(receipt_events, contract_events, "id")
    faults = receipts.join(known, "id", "left").agg(
        (F.count_if(F.col("_known").isNull()) + F.count(F.lit(1)) - F.count_distinct(F.coalesce("id", F.lit("")))).alias("n")
    ).scalar()
    rows = judged.join(sets, "id", "left")
    status, reason = F.col("r.status"), F.coalesce("r.reason", F.lit(""))
    error = (
        F.when(stray, "unknown-topic")
        .when(repeated, "duplicate-topic")
        .when(faults > 0, "run-rejected")
        .when(F.col("copies").isNull(), "missing-topic")
        .when(~F.coalesce("same", F.lit(True)), "source-events-differ")
        .when(~F.coalesce(status.isin("succeeded", "pending", "not-applicable"), F.lit(False)), "not-successful")
        .when(status.isin("pending", "not-applicable") & (F.trim(reason) == ""), "reason-required")
    )
    return rows.select("id", status.alias("status"), F.col("r.reason").alias("reason"), error.alias("error"))


def system_receipts_cover(receipt_events: DataFrame, pair_events: DataFrame) -> DataFrame:
    """System receipts that do not cover whole pairs: (outcome id, pair id, missing event)."""
    touched = receipt_events.join(pair_events, "event_id").select("outcome_id", "pair_id").distinct()
    needed = touched.join(pair_events, "pair_id").select("outcome_id", "pair_id", "event_id")
    return needed.join(receipt_events.select("outcome_id", "event_id").distinct(), ["outcome_id", "event_id"], "left_anti")


def superseded(ledger: DataFrame, ledger_events: DataFrame, incoming_events: DataFrame) -> DataFrame:
    """Pending or failed settlements that share a source event with an incoming one of another id: (id)."""
    open_ = ledger.where(F.col("status").isin("pending", "failed")).select(F.col("id").alias("settlement_id"))
    theirs = ledger_events.join(open_, "settlement_id", "left_semi")
    fresh = incoming_events.select(F.col("settlement_id").alias("incoming_id"), "event_id").distinct()
    # How many different incoming ids touch an event, and one of them: enough to tell "another id" without pairs.
    seen = fresh.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("incoming_id").alias("one"))
    hit = theirs.join(seen, "event_id").where((F.col("n") > 1) | (F.col("one") != F.col("settlement_id")))
    return hit.select(F.col("settlement_id").alias("id")).distinct()


def merge_settlements(
    ledger: DataFrame, ledger_events: DataFrame, receipts: DataFrame, receipt_events: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Ledger after a commit, and its event bridge.

    ``receipts`` (id, status, updated_at, …) hold one row per topic. A topic that already succeeded keeps
    its row: a later result that did not succeed is written beside it as ``status:topic:hash``. A failed
    result is written as ``failed:topic``. Open settlements that share events are superseded.
    """
    won = ledger.where(F.col("status") == "succeeded").select("id", F.lit(True).alias("_won"))
    # Only results beside a success carry a mark; other topics' events are not summed.
    marked = receipts.where(~F.col("status").isin("succeeded", "failed")).join(won, "id", "left_semi").select("id")
    marks = receipt_events.join(marked, "id", "left_semi").groupBy("id").agg(
        F.substring(F.sha2(F.sum(F.xxhash64("event_id").cast("decimal(38,0)")).cast("string"), 256), 1, 16).alias("_mark")
    )
    rows = receipts.join(won, "id", "left").join(marks, "id", "left")
    beside = F.col("_won").isNotNull() & (F.col("status") != "succeeded")
    new_id = F.when(F.col("status") == "failed", F.concat(F.lit("failed:"), "id")).when(
        beside, F.concat_ws(":", "status", "id", "_mark")
    ).otherwise(F.col("id"))
    named = rows.withColumn("settlement_id", new_id)
    incoming = named.drop("id", "_won", "_mark").withColumnRenamed("settlement_id", "id").select(*receipts.columns)
    events = receipt_events.join(named.select("id", "settlement_id"), "id").select("settlement_id", "event_id").distinct()
    gone = superseded(ledger, ledger_events, events).unionByName(incoming.select("id")).distinct()
    kept = ledger.join(gone, "id", "left_anti")
    kept_events = ledger_events.join(gone.withColumnRenamed("id", "settlement_id"), "settlement_id", "left_anti")
    merged = kept.unionByName(incoming, allowMissingColumns=True)
    return merged, kept_events.select("settlement_id", "event_id").unionByName(events)


def advance_processed(processed: DataFrame, receipts: DataFrame, receipt_events: DataFrame, tasks: int | None = None) -> DataFrame:
    """Processed event ids after a commit: settled receipts add theirs, open ones take theirs back.

    Topics of one run do not share events; where they do, an open topic wins, so its evidence stays pending. ``tasks``
    deals events to so many tasks, where their number is known to grow.
    """
    done = receipts.where(F.col("status").isin("succeeded", "not-applicable")).select("id")
    added = receipt_events.join(done, "id", "left_semi").select("event_id")
    back = receipt_events.join(receipts.where(F.col("status").isin("pending", "failed")).select("id"), "id", "left_semi").select("event_id")
    held = dealt(processed.select("event_id").unionByName(added), tasks, "event_id").distinct()
    return held.join(dealt(back, tasks, "event_id").distinct(), "event_id", "left_anti")


def run_rollup(results: DataFrame, run: str = "run_id", first_failures: int | None = None) -> DataFrame:
    """Run status from topic results (run, id, status, title, error) and system pairs; failures listed, all or the first so many."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = results.groupBy(run).agg(
        is_("succeeded").alias("committed"), is_("not-applicable").alias("skipped"), is_("pending").alias("pending"),
        is_("failed").alias("failed"), is_("system").alias("system_pairs"), F.count(F.lit(1)).alias("rows"),
    )
    some = (F.col("committed") > 0) | (F.col("skipped") > 0) | (F.col("system_pairs") > 0)
    final = (
        F.when(F.col("rows") == 0, "idle")
        .when(F.col("failed") > 0, F.when(some, "partial").otherwise("failed"))
        .when(F.col("pending") > 0, "partial")
        .otherwise("succeeded")
    )
    failed = results.where(F.col("status") == "failed")
    if first_failures is not None:
        failed = first_rows(failed, [run], ["id"], first_failures, rank="n")
    listed = failed.groupBy(run).agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("failures"))
    return counts.withColumn("final_status", final).join(listed, run, "left").withColumn("failures", F.coalesce("failures", F.lit("")))


def cycle_rollup(batches: DataFrame, cycle: str = "cycle_id") -> DataFrame:
    """Cycle status and token use from its batches."""
    bad = F.count_if(F.col("final_status").isin("failed", "partial"))
    return batches.groupBy(cycle).agg(
        F.count(F.lit(1)).alias("batches"), F.when(bad > 0, "partial").otherwise("succeeded").alias("status"),
        F.sum("tokens_used").alias("tokens_used"),
    )


def token_usage(lines: DataFrame, key: str, text: str = "value") -> DataFrame:
    """Largest total reported by the usage records of a writer's JSON lines."""
    v = F.try_parse_json(text)
    total = F.coalesce(*[
        F.try_variant_get(v, f"$.{p}usage.{n}", "double") for p in ("", "item.", "turn.") for n in ("total_tokens", "total")
    ])
    return lines.groupBy(key).agg(F.coalesce(F.max(total), F.lit(0.0)).cast("long").alias("tokens_used"))


def append_run_history(attempts: DataFrame, payload: list[str], run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """Distinct attempts by content hash (the last write of each kept), and each run's status from its latest."""
    mark = F.concat(F.lit("attempt:"), F.substring(F.sha2(F.to_json(F.struct(*payload)), 256), 1, 20))
    rows = attempts.withColumn("attempt_id", mark)
    kept = rows.groupBy(run, "attempt_id").agg(F.max_by(F.struct("finished_at", *payload), "finished_at").alias("a")).select(run, "attempt_id", "a.*")
    runs = kept.groupBy(run).agg(F.count(F.lit(1)).alias("attempts"), F.max_by("status", F.struct("finished_at", "attempt_id")).alias("status"))
    return kept, runs


def _run_time() -> Column:
    return F.coalesce("finished_at", "started_at")


def merge_runs(
    structured: DataFrame, legacy: DataFrame, current: DataFrame | None = None, limit: int | None = None, seconds: int = 300,
    owner: list[str] | None = None,
) -> DataFrame:
    """Structured runs, legacy runs they do not cover, and the current one unless it repeats a recent structured run.

    A report may ask for the newest ``limit`` runs; by default all are kept. With ``owner`` the report
    is per owner.
    """
    keys = owner or []
    cols = [*keys, "id", "run_id", "status", "started_at", "finished_at", "origin"]
    rows = structured.select(*cols).unionByName(
        legacy.join(structured.select(*keys, "run_id").distinct(), [*keys, "run_id"], "left_anti").select(*cols)
    )
    if current is not None:
        c, s = current.alias("c"), structured.alias("s")
        near = F.abs(F.unix_micros(F.coalesce("c.finished_at", "c.started_at")) - F.unix_micros(F.coalesce("s.finished_at", "s.started_at"))) < seconds * 1_000_000
        on = (F.col("c.run_id") == F.col("s.run_id")) & (F.col("c.status") == F.col("s.status")) & near
        for k in keys:
            on = on & (F.col(f"c.{k}") == F.col(f"s.{k}"))
        rows = rows.unionByName(c.join(s, on, "left_anti").select(*cols))
    if limit is None:
        return rows
    order = [_run_time().desc(), F.col("id").desc()]
    return first_rows(rows, keys, order, limit) if keys else rows.orderBy(*order).limit(limit)


def legacy_before(
    structured: DataFrame, legacy: DataFrame, limit: int | None = None, owner: list[str] | None = None
) -> DataFrame:
    """Legacy logs older than every structured run: all, or the newest ``limit`` (of each owner).

    Structured runs are never dropped here, so their number does not matter.
    """
    newest = [F.col("started_at").desc(), F.col("id").desc()]
    if owner:
        edge = structured.groupBy(*owner).agg(F.min("started_at").alias("_edge"))
        rows = legacy.join(edge, owner, "left").where(F.col("_edge").isNull() | (F.col("started_at") < F.col("_edge"))).drop("_edge")
        return rows if limit is None else first_rows(rows, owner, newest, limit)
    edge = structured.agg(F.min("started_at")).scalar()
    rows = legacy.where(edge.isNull() | (F.col("started_at") < edge))
    return rows if limit is None else rows.orderBy(*newest).limit(limit)


def path_claims(claims: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Violations over claimed paths (topic_id, role, path): claimed twice, wrong folder, managed page not reused.

    ``existing`` (topic_id, role, path) lists the managed pages each topic must keep updating.
    """
    rows = claims.withColumn("path", F.regexp_replace("path", r"\\", "/"))
    inside = F.startswith("path", F.lit(f"wiki/{fv.EXPERIENCE_FOLDER}/"))
    memory = F.col("role") == "memory"
    rule = (
        F.when(memory & ~inside, "memory-outside-folder")
        .when(memory & F.col("path").rlike(f"(?i)^wiki/{fv.EXPERIENCE_FOLDER}/项目/"), "memory-in-generic-folder")
        .when(~memory & inside, "evidence-inside-memory-folder")
    )
    out = rows.where(rule.isNotNull()).select("topic_id", "path", rule.alias("rule"))
    twice = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("topic_id").alias("topic_id")).where(F.col("n") > 1)
    out = out.unionByName(twice.select("topic_id", "path", F.lit("path-claimed-twice").alias("rule")))
    if existing is not None:
        lost = existing.join(rows.select("topic_id", "role", "path"), ["topic_id", "role", "path"], "left_anti")
        out = out.unionByName(lost.select("topic_id", "path", F.lit("managed-page-not-reused").alias("rule")))
    return out


def check_write_intent(updates: DataFrame, current: DataFrame) -> DataFrame:
    """Compare-and-set over (path, action, expected, content_hash) and the current (path, content_hash)."""
    now = current.select("path", F.col("content_hash").alias("current_hash"))
    rows = updates.join(now, "path", "left")
    there, same = F.col("current_hash").isNotNull(), F.col("current_hash") == F.col("content_hash")
    expected = F.coalesce("expected", F.lit(""))
    error = (
        F.when(~F.coalesce(F.col("action").isin("created", "updated"), F.lit(False)), "unknown-action")
        .when((F.col("action") == "created") & there & ~same, "created-but-exists")
        .when((F.col("action") == "updated") & ~there, "updated-but-missing")
        .when((F.col("action") == "updated") & (expected == ""), "expected-hash-required")
        .when((expected != "") & ~F.coalesce((F.col("current_hash") == expected) | same, F.lit(False)), "changed-meanwhile")
    )
    return rows.select("path", "action", error.alias("error"))
