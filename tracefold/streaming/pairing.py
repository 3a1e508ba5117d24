"""Questions and answers paired as they come, without losing what comes late.

No watermark drops a half: an answer may be days late. A turn's first question and last answer are kept in state, and
whenever they change a row with both is emitted, the other half null where it has not come yet. Rows correct earlier ones;
none is ever taken back. ``paired_turns`` unites the rows of a turn, so whatever was emitted once is never lost, also where
a state was forgotten because its time to live was over.

Turns are dealt to buckets by hash, and a bucket's state is a map by turn: an event reads and writes its own turn's entry
only. A checkpoint of the form with one group a turn cannot be taken on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracefold.streaming.captures import use_state_store

TURN = ["source", "session_id", "turn_id"]
#: Groups that turns are dealt to. A turn of its own as a group costs a call of the processor; a bucket costs one for many.
BUCKETS = 1024
_HALF = ["id", "at", "content"]
_NONE = (None, None, None)
_KEY = ", ".join(f"{k} string" for k in TURN)
_STATE = "prompt_id string, prompt_at long, prompt_content string, stop_id string, stop_at long, stop_content string"
_NAMES = [f"{half}_{c}" for half in ("prompt", "stop") for c in _HALF]
OUTPUT = f"{_KEY}, {_STATE}"


class TurnHalves(StatefulProcessor):
    """The first question and the last answer of each turn of a bucket, by time and then id."""

    def __init__(self, keep_seconds: float | None):
        self.keep = None if keep_seconds is None else int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.halves = handle.getMapState("halves", _KEY, _STATE, ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = lambda half: (half[1], half[0])
        come: dict[tuple, list[tuple]] = {}
        for chunk in rows:
            for event, *turn, i, at, content in zip(*(chunk[c] for c in ("event", *TURN, "event_id", "micros", "content")), strict=True):
                halves, half = come.setdefault(tuple(turn), [_NONE, _NONE]), (i, int(at), content)
                if event == "UserPromptSubmit" and (halves[0] is _NONE or order(half) < order(halves[0])):
                    halves[0] = half
                if event == "Stop" and (halves[1] is _NONE or order(half) > order(halves[1])):
                    halves[1] = half
        out = []
        for turn, (prompt, stop) in come.items():
            held = self.halves.getValue(turn)
            before = (None,) * 6 if held is None else tuple(held)
            if before[0] is not None and (prompt is _NONE or order(before[:3]) <= order(prompt)):
                prompt = before[:3]
            if before[3] is not None and (stop is _NONE or order(before[3:]) >= order(stop)):
                stop = before[3:]
            now = (*prompt, *stop)
            if now != before:
                self.halves.updateValue(turn, now)
                out.append((*turn, *now))
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[*TURN, *_NAMES], dtype="object")
        return frame.astype({c: "Int64" for c in _NAMES if c.endswith("_at")})

    def close(self) -> None:
        pass


def stream_turns(stream: DataFrame, keep_seconds: float | None = None) -> DataFrame:
    """Rows of (source, session_id, turn_id) with the halves known so far, to be read through ``paired_turns``.

    State lives for ever, or ``keep_seconds`` of processing time; then the stream never runs out of batches, so it
    cannot be drained. Rows without a turn, a time or an id are no halves.
    """
    use_state_store(stream.sparkSession)
    rows = stream.where(F.col("event").isin("UserPromptSubmit", "Stop") & F.col("captured_at").isNotNull())
    for c in (*TURN, "event_id"):
        rows = rows.where(F.col(c).isNotNull())
    slim = rows.select(*TURN, "event", "event_id", F.unix_micros("captured_at").alias("micros"), "content")
    dealt = slim.withColumn("bucket", F.pmod(F.xxhash64(*TURN), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TurnHalves(keep_seconds), outputStructType=OUTPUT, outputMode="Append", timeMode="None" if keep_seconds is None else "ProcessingTime"
    )


def paired_turns(rows: DataFrame) -> DataFrame:
    """One row a turn: its first question and its last answer, either null where nothing is known of it yet."""
    half = lambda name: F.struct(*[f"{name}_{c}" for c in _HALF])
    order = lambda name: F.when(F.col(f"{name}_id").isNotNull(), F.struct(f"{name}_at", f"{name}_id"))
    one = rows.groupBy(*TURN).agg(F.min_by(half("prompt"), order("prompt")).alias("p"), F.max_by(half("stop"), order("stop")).alias("s"))
    return one.select(
        *TURN, "p.prompt_id", F.timestamp_micros("p.prompt_at").alias("prompt_at"), "p.prompt_content",
        "s.stop_id", F.timestamp_micros("s.stop_at").alias("stop_at"), "s.stop_content",
    )
