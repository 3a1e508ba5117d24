"""Explicit identities: texts are searched once, and identities fold without a distinct count."""

from pyspark.sql import functions as F

from tracefold.operators.identity import explicit_identities

SCHEMA = """id string, task_key string, project_key string, title string, summary string, kind string, occurred_at timestamp,
 source_refs array<struct<type: string, url: string, excerpt: string>>"""


def found(spark, *rows):
    """Rows: (task, types of its sources)."""
    data = [(f"e{n}", task, "p", f"T{n}", "issue #7", "task_started", None, None if types is None else [(t, None, None) for t in types]) for n, (task, types) in enumerate(rows)]
    events = spark.createDataFrame(data, SCHEMA).withColumn("occurred_at", F.timestamp_seconds(F.substring("id", 2, 3).cast("long")))
    return explicit_identities(events)


def test_two_tasks_and_two_kinds_of_source_are_told_by_ends(spark):
    keys = lambda *rows: sorted(r.task_key for r in found(spark, *rows).collect())
    assert keys(("a", ["git"]), ("b", ["codex"])) == ["a", "b"]
    assert keys(("a", ["git", "codex"]), ("b", None)) == ["a", "b"]
    assert keys(("a", ["git"]), ("b", [None])) == ["a", "b"]  # an unnamed source is a kind of its own
    assert keys(("a", ["git"]), ("b", ["git"])) == keys(("a", [None]), ("b", [])) == keys(("a", ["git", "codex"]), ("a", ["codex"])) == []


def test_texts_are_not_searched_by_each_aggregate(spark):
    plan = found(spark, ("a", ["git"]), ("b", ["codex"]))._jdf.queryExecution().toString()
    assert "regexp_extract" not in plan and "distinct task_key" not in plan
