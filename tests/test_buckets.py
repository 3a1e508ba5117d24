"""Stream processors whose groups are buckets of keys: one call takes the rows of many keys."""

import datetime as dt
from types import SimpleNamespace

import pandas as pd

from tracefold.streaming.pairing import TurnHalves
from tracefold.streaming.silence import SilenceStates


class Entries(dict):
    """A map or list state in memory."""

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


class Rows(list):
    def exists(self):
        return bool(self)

    def get(self):
        return iter(list(self))

    def put(self, rows):
        self[:] = rows

    appendList = list.extend


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_, **__):
        return Entries()

    def getListState(self, *_, **__):
        return Rows()

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_turns_of_a_bucket_stay_apart():
    halves = TurnHalves(None)
    halves.init(Handle())

    def take(*rows):
        frame = pd.DataFrame(rows, columns=["source", "session_id", "turn_id", "event", "event_id", "micros", "content"])
        (out,) = halves.handleInputRows((7,), iter([frame]), None)
        return {r.turn_id: (r.prompt_id, r.stop_id) for r in out.astype(object).where(out.notna(), None).itertuples()}

    first = take(("c", "s", "t1", "UserPromptSubmit", "p1", 5, "x"), ("c", "s", "t2", "Stop", "a2", 9, "x"), ("c", "s", "t1", "UserPromptSubmit", "p0", 6, "x"))
    assert first == {"t1": ("p1", None), "t2": (None, "a2")}
    assert take(("c", "s", "t1", "Stop", "a1", 8, "x"), ("c", "s", "t2", "Stop", "a0", 3, "x")) == {"t1": ("p1", "a1")}
    assert take(("c", "s", "t2", "UserPromptSubmit", "p2", 1, "x")) == {"t2": ("p2", "a2")}


def test_silence_is_told_key_by_key():
    handle, states = Handle(), SilenceStates(10e-6 * 1000, "ready", "reopened")  # ten thousand micros: ten timer ticks
    states.init(handle)
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    tick = lambda us: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)

    def come(*rows):
        list(states.handleInputRows((3,), iter([pd.DataFrame(rows, columns=["key", "micros"])]), clock(0)))

    def pass_to(ms):
        got = []
        while any(t <= ms for t in handle.timers):
            handle.timers.remove(min(handle.timers))
            for frame in states.handleExpiredTimer((3,), clock(ms), None):
                got += [(r.key, r.state, r.at) for r in frame.itertuples()]
        return sorted(got)

    come(("a", 1000), ("b", 2000), ("a", 4000), ("b", 50_000))
    assert pass_to(20) == [("a", "ready", tick(14_000)), ("b", "ready", tick(12_000))]
    come(("a", 40_000), ("c", 41_000))
    assert pass_to(45) == [("a", "reopened", tick(40_000))]
    assert pass_to(1000) == [
        ("a", "ready", tick(50_000)), ("b", "ready", tick(60_000)), ("b", "reopened", tick(50_000)), ("c", "ready", tick(51_000)),
    ]
    assert not handle.timers
