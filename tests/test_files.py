"""Readers and writers against real files."""

import datetime as dt

from pyspark.sql import functions as F

from tracefold.operators.once import append_new, read_once
from tracefold.operators.sinks import write_pages
from tracefold.sources.captures import read_capture_log
from tracefold.sources.notes import read_wiki_docs


def test_capture_log_keeps_file_and_line(spark, tmp_path):
    line = '{"event_id": "%s", "captured_at": "2026-07-16T08:00:00Z", "session_id": "s", "turn_id": "t", "event": "Stop", "content": "c"}'
    (tmp_path / "2026-07-16.jsonl").write_text("\n".join([line % "e1", "", "{bad", line % "e2"]) + "\n")
    records, rejects = read_capture_log(spark, str(tmp_path))
    assert {r.event_id: r.source_line for r in records.collect()} == {"e1": 1, "e2": 4}
    assert [(r.source_line, r.reason) for r in rejects.collect()] == [(3, "not-json")]
    assert {str(r.date) for r in records.collect()} == {"2026-07-16"}


def test_notes_without_temporary_files(spark, tmp_path):
    for name in ("wiki/a/n.md", "wiki/_tmp1.md", "wiki/b.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# t\nbody")
    assert {r.path for r in read_wiki_docs(spark, str(tmp_path)).collect()} == {"wiki/a/n.md", "wiki/b.md"}


def test_pages_read_back_in_order(spark, tmp_path):
    at = dt.datetime(2026, 7, 16)
    rows = [("p", at + dt.timedelta(minutes=i), f"{i:03d}", f"block {i:03d}") for i in range(50)] + [("p", None, "", "# head")]
    out = str(tmp_path / "pages")
    write_pages(spark.createDataFrame(rows, "daily_path string, captured_at timestamp, id string, block string"), out)
    files = sorted((tmp_path / "pages" / "daily_path=p").glob("part-*"))
    text = "".join(f.read_text() for f in files).split("\n")
    assert text[0] == "# head" and text[1:51] == [f"block {i:03d}" for i in range(50)]


def test_appending_twice_adds_nothing(spark, tmp_path):
    batch = spark.range(20).select(
        F.concat(F.lit("e"), (F.col("id") % 15).cast("string")).alias("event_id"), F.lit("Stop").alias("event"), F.lit("s").alias("session_id"), F.lit("t").alias("turn_id"),
        F.lit("c").alias("content"), F.lit("2026-07-16").cast("date").alias("date"), F.col("id").alias("ingest_seq"),
    )
    path = str(tmp_path / "table")
    assert append_new(batch, path).first().asDict() == {"accepted": 15, "duplicates": 5, "rejected": 0, "acknowledged": 20}
    assert append_new(batch, path).first()["accepted"] == 0 and read_once(spark, path).count() == 15
