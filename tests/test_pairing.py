"""Pairs whose halves come late, in any order, or after the state forgot the other half."""

import datetime as dt
import random

from tracefold.streaming.pairing import paired_turns, stream_turns

START = dt.datetime(2026, 1, 1)
SCHEMA = "source string, session_id string, turn_id string, event string, event_id string, captured_at timestamp, content string"


def half(turn, event, i, minutes):
    return ("codex", "s", turn, event, i, START + dt.timedelta(minutes=minutes), f"text {i}")


def run(spark, tmp_path, batches, forget=False):
    """Each batch in a run of its own; ``forget`` starts every run with an empty state."""
    src, out, schema = tmp_path / "in", str(tmp_path / "out"), None
    for n, batch in enumerate(batches):
        here = str(src / str(n)) if forget else str(src)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(here)
        stream = stream_turns(spark.readStream.schema(SCHEMA).parquet(here))
        rows, schema = stream.coalesce(4), stream.schema
        sink = rows.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out))
        sink.option("checkpointLocation", str(tmp_path / (f"cursor{n}" if forget else "cursor"))).trigger(availableNow=True).start().awaitTermination(120)
    return {r.turn_id: (r.prompt_id, r.stop_id) for r in paired_turns(spark.read.schema(schema).parquet(out)).collect()}


def test_halves_in_any_order_and_days_late(spark, tmp_path):
    rng = random.Random(1)
    rows, want = [], {}
    for t in range(30):
        asks = [half(f"t{t}", "UserPromptSubmit", f"p{t}-{i}", rng.randrange(5000)) for i in range(rng.randrange(1, 3))]
        answers = [half(f"t{t}", "Stop", f"a{t}-{i}", rng.randrange(5000) + 2 * 1440) for i in range(rng.randrange(1, 3))]
        rows += asks + answers
        want[f"t{t}"] = (min(asks, key=lambda r: (r[5], r[4]))[4], max(answers, key=lambda r: (r[5], r[4]))[4])
    rows += [("codex", "s", None, "Stop", "x", START, "c"), ("codex", "s", "t1", "Stop", None, START, "c"), ("codex", "s", "t1", "Other", "y", START, "c")]
    rng.shuffle(rows)
    assert run(spark, tmp_path, [rows[i::3] for i in range(3)]) == want


def test_an_answer_finds_its_question_after_the_state_is_gone(spark, tmp_path):
    early = [half("t1", "Stop", "a1", 9), half("t2", "UserPromptSubmit", "p2", 1), half("t2", "Stop", "a2", 2)]
    late = [half("t1", "UserPromptSubmit", "p1", 1), half("t1", "Stop", "a0", 3), half("t2", "Stop", "a3", 3000)]
    got = run(spark, tmp_path, [early, late, [half("t3", "UserPromptSubmit", "p3", 4)]], forget=True)
    assert got == {"t1": ("p1", "a1"), "t2": ("p2", "a3"), "t3": ("p3", None)}
