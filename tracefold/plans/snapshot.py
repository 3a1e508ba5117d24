"""From captured records, notes and commits to events, tasks, artifacts and outcomes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators import artifacts as a
from tracefold.operators import metrics, outcomes, wiki
from tracefold.operators import turns as u
from tracefold.operators.identity import merge_explicit_identities, merge_numbered_copies
from tracefold.schemas import ACTIVITY_COLUMNS
from tracefold.session import cut_lineage


def unify_events(*sources: DataFrame) -> DataFrame:
    """One activity table from turn, wiki, reuse and commit events; the owner defaults to one."""
    rows = [df if "owner" in df.columns else df.withColumn("owner", F.lit("me")) for df in sources]
    return reduce(DataFrame.unionByName, [df.select(*ACTIVITY_COLUMNS) for df in rows])


@dataclass
class Sources:
    records: DataFrame
    titles: DataFrame
    docs: DataFrame
    links: DataFrame
    commits: DataFrame  # activity events of commits, as ``parse_commit_log`` gives them


def build_events(sources: Sources) -> DataFrame:
    """All activity events, identities and project labels reconciled. Write the result: four outputs read it."""
    # Each merge reads its input several times over; the turns are derived once and written between steps.
    turns = cut_lineage(merge_numbered_copies(cut_lineage(u.build_turns(sources.records, sources.titles))))
    turns = merge_explicit_identities(turns)
    notes = wiki.wiki_activity(sources.docs, wiki.wiki_contributions(sources.docs, sources.records))
    reuse = wiki.reuse_edges(sources.links, sources.docs)
    return metrics.reconcile_project_labels(cut_lineage(unify_events(turns, notes, reuse, sources.commits)))


def build_artifacts(events: DataFrame, sources: Sources, inventory: DataFrame, tasks: int | None = None) -> a.Artifacts:
    """Artifacts of commits, notes and reports; a report that names one known commit is told in the commit instead.

    ``tasks`` are those among which commits are dealt; as many as the session's shuffles have, if None.
    """
    commits = a.commit_tables(a.commit_artifacts(events), tasks)
    stops = u.eligible_stops(sources.records, u.eligible_turns(sources.records, sources.titles))
    reports = cut_lineage(a.report_artifacts(events, stops, inventory, u.turn_problem(events)), "reports")
    hashes = commits.heads.select(F.col("id").alias("commit_id"), F.regexp_extract("id", "([0-9a-f]{40})$", 1).alias("hash")).where(F.col("hash") != "")
    attached = cut_lineage(a.attach_reports_to_commits(reports, hashes), "attached")
    told, alone = a.fold_reports(commits, reports, attached)
    # A note written and updated is two events and one artifact: the first event heads it, the others stay in the bridge.
    notes = cut_lineage(a.wiki_artifacts(events, sources.docs), "note-artifacts", "zstd")
    first = notes.groupBy("id").agg(F.min(F.struct("occurred_at", F.col("source_event_ids")[0].alias("event"))).alias("_first"))
    heads = notes.join(first, "id").where((F.col("occurred_at") == F.col("_first.occurred_at")) & (F.col("source_event_ids")[0] == F.col("_first.event"))).drop("_first")
    kept = a.artifact_tables(heads.dropDuplicates(["id"]))
    every = a.artifact_tables(notes)
    return a.union_tables(told, a.artifact_tables(alone), a.Artifacts(kept.heads, kept.lines, every.events, every.refs))


def build_outcomes(artifacts: a.Artifacts, events: DataFrame, ledger: DataFrame, ledger_events: DataFrame, reuse: DataFrame | None = None) -> DataFrame:
    """Outcomes of artifacts and of settlements no artifact claims."""
    heads, claimed = cut_lineage(artifacts.heads, "artifact-heads"), cut_lineage(artifacts.events, "artifact-events")
    files = artifacts.refs.where("type = 'file'").select("id", F.col("label").alias("file"))
    made = outcomes.aggregate_outcomes(heads, files, claimed, ledger, ledger_events, events, reuse=reuse)
    free = cut_lineage(outcomes.unclaimed_settlements(ledger, ledger_events, claimed), "unclaimed")
    own = free.select(F.col("id").alias("settlement_id"))
    told = outcomes.settlement_outcomes(free, outcomes.settlement_events(ledger_events.join(own, "settlement_id", "left_semi"), events), events)
    return made.unionByName(told, allowMissingColumns=True)
