"""Appends that never double: dates, replays, writers at the same time, writers that die."""

import datetime as dt
import threading

import pytest

from tracefold.operators import once
from tracefold.operators.once import append_new, append_once, compact_once, read_once
from tracefold.streaming import captures as sc

SCHEMA = "id string, date date, n long"
DAY = dt.date(2026, 7, 1)


def put(spark, path, rows, **options):
    plan = append_once(spark.createDataFrame(rows, SCHEMA), path, key="id", partition=("date",), **options)
    return sorted((r.id or "", r.verdict) for r in plan.collect())


def held(spark, path):
    return sorted(((r.id, r.date, r.n) for r in read_once(spark, path).collect()), key=repr)


def test_dates_do_not_matter(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_once(spark, path) is None
    rows = [("a", DAY, 1), ("b", None, 2), ("b", DAY, 3), (None, DAY, 4)]
    assert put(spark, path, rows, seq="n") == [("", "rejected"), ("a", "accepted"), ("b", "accepted"), ("b", "duplicate")]
    for again in (rows, [("a", None, 9), ("b", dt.date(2025, 1, 1), 9)], [("b", None, 2)]):
        assert all(v != "accepted" for _, v in put(spark, path, again))
    assert held(spark, path) == [("a", DAY, 1), ("b", None, 2)]


def test_rows_that_tie_are_added_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert [v for _, v in put(spark, path, [("a", DAY, 1)] * 5 + [("b", DAY, None)] * 3, seq="n")].count("accepted") == 2
    assert put(spark, path, []) == []


def test_replayed_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [("a", DAY, 1)], batch_id="s:0")
    assert put(spark, path, [("a", DAY, 1), ("x", DAY, 1)], batch_id="s:0") == [("a", "duplicate"), ("x", "duplicate")]  # a batch id is its content
    assert held(spark, path) == [("a", DAY, 1)]
    sink = sc.append_batch(str(tmp_path / "u"))
    rows = spark.createDataFrame([("e", None), ("f", DAY)], "event_id string, date date")
    for number in (0, 0, 7):
        sink(rows, number)
    assert read_once(spark, str(tmp_path / "u")).count() == 2


def test_two_writers_do_not_double(spark, tmp_path, monkeypatch):
    """Both plan against the same log; the slower one plans again."""
    path, gate, tried = str(tmp_path / "t"), threading.Barrier(2, timeout=60), []
    claim = once._claim

    def together(*args):
        if len(tried) < 2:
            tried.append(args[1])
            gate.wait()
        return claim(*args)

    monkeypatch.setattr(once, "_claim", together)
    out = {}
    batches = {1: [(f"i{i}", DAY, 1) for i in range(0, 60)], 2: [(f"i{i}", None, 2) for i in range(30, 90)]}
    threads = [threading.Thread(target=lambda w=w: out.update({w: put(spark, path, batches[w])})) for w in batches]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert tried == [0, 0]
    assert sum(v == "accepted" for rows in out.values() for _, v in rows) == 90
    ids = [r[0] for r in held(spark, path)]
    assert len(ids) == len(set(ids)) == 90


def test_a_write_without_an_entry_was_never_made(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, [("a", DAY, 1)])

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(once, "_claim", dies)
        with pytest.raises(RuntimeError):
            put(spark, path, [("b", DAY, 2)])
    assert held(spark, path) == [("a", DAY, 1)]
    (tmp_path / "t" / "log" / "000000000001.json").write_text("")  # claimed a number, and died before it wrote
    monkeypatch.setattr(once._log, "__defaults__", (0.5,))
    assert put(spark, path, [("b", DAY, 3)]) == [("b", "accepted")]
    assert held(spark, path) == [("a", DAY, 1), ("b", DAY, 3)]
    assert compact_once(spark, path, key="id")
    assert len(list((tmp_path / "t" / "rows").glob("write=*"))) == len(list((tmp_path / "t" / "ids").glob("write=*"))) == 1
    assert put(spark, path, [("b", None, 4), ("c", DAY, 5)]) == [("b", "duplicate"), ("c", "accepted")]
    assert held(spark, path) == [("a", DAY, 1), ("b", DAY, 3), ("c", DAY, 5)]


def test_only_buckets_of_the_batch_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(f"i{i}", DAY, i) for i in range(3000)])
    files = once._Files(spark, path)
    ids = once._ids(spark, files, once._log(spark, files)[0], "_key", spark.createDataFrame([], SCHEMA).schema["id"].dataType)
    found = once._known(spark.createDataFrame([("i1",), (None,)], "_key string"), ids)
    assert found.where("_key = 'i1'").count() == 1
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in scan and 0 < found.count() < 40


def test_captures_without_content_are_rejected(spark, tmp_path):
    row = ("e", "Stop", "s", "t", "c", None, 1)
    batch = spark.createDataFrame([row, (None, *row[1:]), ("f", "Stop", "s", "t", " ", None, 2)], "event_id string, event string, session_id string, turn_id string, content string, date date, ingest_seq long")
    for accepted in (1, 0, 0):
        got = append_new(batch, str(tmp_path / "t")).first()
        assert (got.accepted, got.rejected) == (accepted, 2)
