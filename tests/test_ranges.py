"""Ordered passes over range blocks: equal to plain windows, and spread although one owner has everything in one hour."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracefold.operators.metrics import focus_switches
from tracefold.operators.sequence import RANGE, previous_value, range_blocks, running_total

START = dt.datetime(2026, 1, 1, 9)


def test_one_owner_one_hour(spark):
    """A million rows of one key within one hour are many blocks of like size."""
    rows = spark.range(1_000_000).select(
        F.lit("me").alias("k"), (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.pmod(F.col("id") * 7919, F.lit(3600)))).alias("at"), F.col("id"),
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"),
    )
    keys, order = ["k"], ["at", "id"]
    blocks = range_blocks(rows, keys, order, 40)
    sizes = [r["count"] for r in blocks.groupBy(RANGE).count().collect()]
    assert len(sizes) >= 35 and max(sizes) < 3 * 1_000_000 / 40
    got = running_total(previous_value(blocks, keys, order, F.col(RANGE), F.col("v"), "last"), keys, order, F.col(RANGE), F.lit(1), "n")
    w = Window.partitionBy("k").orderBy("at", "id")
    want = rows.withColumn("last", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = got.select("id", "last", "n").exceptAll(want.select("id", "last", "n"))
    assert both.count() == 0 and got.count() == 1_000_000


def test_focus_switches_over_blocks(spark):
    """Switches do not depend on where blocks end, and projects of one instant keep their order."""
    rows = []
    for i in range(500):
        at = START + dt.timedelta(seconds=(i * 37) % 9000)
        rows.append((f"o{i % 3}", at.date(), (f"e{i:03d}", at, f"p{(i * 5) % 4}" if i % 9 else "unassigned")))
    units = spark.createDataFrame(rows, "owner string, local_date date, anchor struct<id:string,occurred_at:timestamp,project_key:string>")
    got = {blocks: sorted(map(tuple, focus_switches(units, 10, blocks).collect())) for blocks in (None, 1, 5, 64)}
    last, want = {}, []
    for owner, day, (i, at, project) in sorted(rows, key=lambda r: (r[0], r[2][1], r[2][0])):
        if project == "unassigned":
            continue
        if owner in last and at - last[owner][0] <= dt.timedelta(minutes=10) and last[owner][1] != project:
            want.append((owner, day, i, at, project, last[owner][1]))
        last[owner] = (at, project)
    assert all(rows == sorted(want) for rows in got.values()) and len(want) > 50


def test_empty(spark):
    rows = spark.createDataFrame([], "k string, at timestamp, id string, v long")
    assert range_blocks(rows, ["k"], ["at", "id"]).count() == 0
