"""The knowledge cycle: a contract of selected topics out, receipts in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import fixed_values as fv
from tracefold.operators import ledger as ld
from tracefold.operators import queue as q
from tracefold.operators.turns import build_pairs
from tracefold.session import cut_lineage


@dataclass
class Contract:
    topics: DataFrame  # selected topics with place, lane and what was taken of them
    topic_events: DataFrame  # (id, event_id) each topic's receipt must cover exactly
    system: DataFrame  # settled without a writer
    system_events: DataFrame
    status: DataFrame  # (counter, value)


def prepare_contract(
    records: DataFrame, titles: DataFrame, processed: DataFrame, ledger: DataFrame, ledger_events: DataFrame, now: Column,
    since: str | None = None, backfill: bool = False, batch_index: int = 1, **limits: int,
) -> Contract:
    """Pair, sort, segment and select. Slim rows are materialised once and read by every later step."""
    pairs = build_pairs(records)
    pending = q.pending_pairs(pairs, processed, ledger, ledger_events, since, backfill)
    sorted_pairs = q.sort_pairs(q.mark_pending(pairs, pending), titles)
    kept = sorted_pairs.where(F.col("queue_class").isin("substantive", "candidate"))
    rows = cut_lineage(q.with_topics(q.segment_sessions(kept, titles)))
    topics = cut_lineage(q.build_topics(rows, ledger, ledger_events, now))
    chosen = q.select_topics(topics, rows, lane_offset=(batch_index - 1) % 3, **limits)
    taken = q.fit_slice(rows.join(chosen.select("topic_id"), "topic_id", "left_semi"), limits.get("max_pairs", fv.SELECTION_PAIRS), limits.get("max_chars", fv.SELECTION_CHARS))
    taken = taken.join(chosen.select("topic_id", F.col("id").alias("contract_id"), F.col("pairs").alias("_taken")), "topic_id").where(F.col("place") <= F.col("_taken"))
    events = taken.select(F.col("contract_id").alias("id"), F.explode("source_event_ids").alias("event_id")).distinct()
    system, system_events = q.system_outcomes(sorted_pairs)
    detail = topics.drop("lane").join(chosen.select("topic_id", "lane", "place", "pairs", "chars", "partial"), "topic_id")
    return Contract(detail, events, system, system_events, q.queue_status(sorted_pairs, topics, chosen))


@dataclass
class Commit:
    verdicts: DataFrame
    ledger: DataFrame
    ledger_events: DataFrame
    processed: DataFrame


def commit_receipts(
    contract: Contract, receipts: DataFrame, receipt_events: DataFrame, ledger: DataFrame, ledger_events: DataFrame,
    processed: DataFrame, now: Column,
) -> Commit:
    """Validate receipts, settle them and move the processed set. A rejected or missing receipt settles as failed."""
    verdicts = cut_lineage(ld.validate_receipts(receipts, receipt_events, contract.topics.select("id"), contract.topic_events))
    own = verdicts.join(contract.topics.select("id"), "id", "left_semi")
    rows = own.select(
        "id", F.when(F.col("error").isNull(), F.col("status")).otherwise("failed").alias("status"), "reason", F.col("error").alias("last_error"), now.alias("updated_at")
    )
    merged, events = ld.merge_settlements(ledger, ledger_events, rows, contract.topic_events)
    system = contract.system.select("id", "status", "category", "reason", now.alias("updated_at"))
    merged = merged.join(system.select("id"), "id", "left_anti").unionByName(system, allowMissingColumns=True)
    events = events.unionByName(contract.system_events).distinct()
    settled = rows.select("id", "status").unionByName(contract.system.select("id", "status"))
    touched = contract.topic_events.unionByName(contract.system_events.select(F.col("settlement_id").alias("id"), "event_id"))
    return Commit(verdicts, merged, events, ld.advance_processed(processed, settled, touched))


def fail_run(contract: Contract, reason: str) -> DataFrame:
    """Receipts of a run that produced none: every topic failed."""
    return contract.topics.select("id", F.lit("failed").alias("status"), F.lit(reason).alias("reason"), F.lit(0).alias("seq"))
