import pytest

from tracefold.operators import ledger as ld
from tracefold.sources import given_tables as g

RECEIPTS = [("a", "succeeded"), ("b", "pending"), ("c", "not-applicable"), ("d", "failed"), ("e", "other")]
EVENTS = [("a", "1"), ("a", "2"), ("a", None), ("b", "2"), ("b", "3"), ("b", None), ("c", "4"), ("d", "5"), ("e", "6")]


@pytest.mark.parametrize("tasks", [None, 7])
def test_events_dealt_to_tasks_come_out_the_same(spark, tasks):
    receipts, events = spark.createDataFrame(RECEIPTS, "id string, status string"), spark.createDataFrame(EVENTS, "id string, event_id string")
    before = spark.createDataFrame([("0",), ("3",), ("5",)], "event_id string")
    moved = ld.advance_processed(before, receipts, events, tasks)
    assert sorted(map(str, (r.event_id for r in moved.collect()))) == ["0", "1", "4", "None"]
    other = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "4"), ("c", "4"), ("d", "7"), ("x", "1")], "id string, event_id string")
    same = {r.id: r.same for r in ld.same_event_sets(events, other, "id", tasks).collect()}
    assert same == {"a": False, "b": False, "c": True, "d": False, "e": False, "x": False}


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    few = g.line_tasks(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(g, "LINES_A_TASK", 100)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert few < g.line_tasks(spark, "/root/testdata/sf0.001") == lines // 100 + 1


def test_only_results_beside_a_success_carry_a_mark(spark):
    ledger = spark.createDataFrame([(i, "succeeded") for i in "abcd"], "id string, status string")
    receipts, events = spark.createDataFrame(RECEIPTS, "id string, status string"), spark.createDataFrame(EVENTS, "id string, event_id string")
    merged, _ = ld.merge_settlements(ledger, spark.createDataFrame([], "settlement_id string, event_id string"), receipts, events)
    ids = sorted(r.id.rpartition(":")[0] + ":*" if r.id.count(":") == 2 else r.id for r in merged.collect())
    assert ids == ["a", "b", "c", "d", "e", "failed:d", "not-applicable:c:*", "pending:b:*"]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan or plan.count("LeftSemi") >= 2  # marks are summed for marked topics alone
