"""Outcome components against every pair, where the rules of task and title leave days in several components."""

import random

from tracefold.operators import outcomes, overlap

WORDS = ["alpha", "beta", "gamma", "delta", "omega"]


def brute(arts, files, events):
    tokens = lambda a: set(a["title"].split())
    root = {a["id"]: a["id"] for a in arts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in arts:
        for b in arts:
            if a["id"] >= b["id"] or (a["local_date"], a["project_key"]) != (b["local_date"], b["project_key"]):
                continue
            f, g = files.get(a["id"], set()), files.get(b["id"], set())
            by_files = tokens(a) & tokens(b) and f & g and (len(f & g) >= 2 or len(f & g) / min(len(f), len(g)) >= 0.6)
            same = a["task_key"] and a["task_key"] == b["task_key"]
            if same or a["title"] == b["title"] or by_files or events.get(a["id"], set()) & events.get(b["id"], set()):
                x, y = sorted((top(a["id"]), top(b["id"])))
                root[y] = x
    return {i: top(i) for i in root}


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    arts, files, events = [], {}, {}
    for i in range(160):
        title = " ".join(rng.sample(WORDS, 2)) + f" n{i}" * (rng.random() < 0.8)
        key = f"a{i:03d}"
        arts.append({"id": key, "local_date": f"2024-01-{1 + i % 8:02d}", "project_key": "p", "task_key": f"t{i % 29}" if i % 11 == 0 else None, "title": title, "result": ""})
        files[key] = set(rng.sample([f"f{n}" for n in range(24)], rng.choice([0, 1, 2, 2, 3, 4])))
        events[key] = {f"e{i}", f"s{i % 40}"} if i % 13 == 0 else {f"e{i}"}
    df = spark.createDataFrame([tuple(a.values()) for a in arts], ", ".join(f"{k} string" for k in arts[0]))
    bridge = lambda of, name: spark.createDataFrame([(i, v) for i, vs in of.items() for v in vs], f"id string, {name} string")
    got = {r.id: r.component for r in outcomes.outcome_components(df, bridge(files, "file"), bridge(events, "event_id")).collect()}
    assert got == brute(arts, files, events)
    assert len(set(got.values())) < len(got)


def test_overlaps_join_what_ids_belong_to(spark):
    rows = [("s", "a", "x", "A"), ("s", "a", "y", "A"), ("s", "b", "x", "B"), ("s", "b", "y", "B"), ("s", "c", "x", "A"), ("s", "d", "x", "D"), ("s", "d", "z", "D")]
    entries = spark.createDataFrame(rows, "scope string, id string, item string, component string")
    none = spark.createDataFrame([], "src string, dst string")
    got = {r.node: r.component for r in overlap.overlap_components(entries, ["scope"], none, node="component").collect()}
    assert got == {"A": "A", "B": "A"}
