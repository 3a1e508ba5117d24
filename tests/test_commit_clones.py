"""Clones of a commit move once and fold into one artifact, with all the references and targets they have."""

import datetime as dt
import random

import pytest

from tests.test_reports import SCHEMA, row
from tracefold import session
from tracefold.operators import artifacts as a
from tracefold.plans.catalog import load

HASHES = [f"{n:040x}" for n in (0xA1, 0xB2, 0xC3)]


def made(spark, seed=1):
    """Artifacts of clones in any order, with files in both cases, repeated and null names, and repositories alike but for case."""
    rng, rows = random.Random(seed), []
    for c in range(60):
        commit = rng.choice([*(f"artifact:git:{h}" for h in HASHES), "artifact:no-hash", f"artifact:git:{c:040x}"])
        files = [("file", rng.choice("aAbBcCdDeEfFgGhHiIjJ") + ".py", f"/c{c}/f", None, None, f"x{c}") for _ in range(rng.randrange(13))]
        gits = [("git", rng.choice(["own", "other"]), rng.choice([None, "/r", "/R", f"/c{c}"]), rng.choice([None, "u"]), rng.choice([None, 3]), None) for _ in range(rng.randrange(3))]
        refs = [*gits, *files, *([(None, "n", None, None, None, None)] if c % 9 == 0 else [])]
        events = [f"e{rng.randrange(40)}", *(["more"] if c % 5 == 0 else [])]
        told = f"say {c}" + (f"\nGit 提交记录列出 {len(files)} 个相关文件：{'、'.join(f[1] for f in files[:8])}{'等' if len(files) > 8 else ''}。" if files and c % 2 else "")
        line = list(row(commit, rng.randrange(3), events, None if c == 7 else refs, result=None if c == 11 else told))
        line[8] = f"T{c}"
        rows.append(tuple(line))
    return rows, spark.createDataFrame(rows, SCHEMA)


def merged_one_by_one(rows):
    """The reference's merge, clone after clone in the order of time, event and title."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[14][0], r[8])):
        i = r[0]
        m = out.setdefault(i, {"clones": 0, "title": r[8], "result": r[10], "refs": {}, "targets": {}, "events": set()})
        m["clones"] += 1
        m["events"] |= set(r[14])
        for ref in r[15] or []:
            kind, label, path, url, line, _ = ref
            lead = f"file:{label.lower()}" if kind == "file" else f":{kind or ''}:{path or ''}:{url or ''}:{line or ''}"
            m["refs"].setdefault(lead, ref)
            if kind == "git":
                own = i[-40:] if i.startswith("artifact:git:") else r[14][0]
                m["targets"].setdefault(f"git:{own}:{label if path is None else path.lower()}", (label, path))
        if m["clones"] > 1:
            files = [ref[1] for ref in m["refs"].values() if ref[0] == "file"]
            m["result"] = m["title"] + (f"\nGit 提交记录列出 {len(files)} 个相关文件：{'、'.join(files[:8])}{'等' if len(files) > 8 else ''}。" if files else "")
    return out


@pytest.mark.parametrize("crowded", [None, True, False])
def test_clones_merge_as_one_after_the_other(spark, crowded):
    rows, df = made(spark)
    merged, want = a.merge_commit_artifacts(df.repartition(5), ["title", "result", "kind"], 7, crowded), merged_one_by_one(rows)
    heads = {r.id: r for r in merged.heads.collect()}
    assert heads.keys() == want.keys()
    for i, m in want.items():
        r = heads[i]
        files = [x for x in m["refs"].values() if x[0] == "file"]
        assert (r.clones, r.title, r.result, r.kind) == (m["clones"], m["title"], m["result"], "git-commit")
        assert (r.files, r.refs, r.targets, r.events) == (len(files), len(m["refs"]), len(m["targets"]), len(m["events"]))
    assert {(r.id, tuple(r)[1:]) for r in merged.refs.collect()} == {(i, x) for i, m in want.items() for x in m["refs"].values()}
    assert merged.refs.count() == sum(len(m["refs"]) for m in want.values())
    assert {(r.id, r.key, r.label, r.path) for r in merged.targets.collect()} == {(i, k, *v) for i, m in want.items() for k, v in m["targets"].items()}
    assert {tuple(r) for r in merged.events.collect()} == {(i, e) for i, m in want.items() for e in m["events"]}


def test_a_crowding_commit_is_seen(spark, monkeypatch):
    df = made(spark)[1]
    assert not a._crowded(df, 4) and not a._crowded(df.limit(0), 4)
    monkeypatch.setattr(a, "CROWD", 5)
    assert a._crowded(df.where(f"id = 'artifact:git:{HASHES[0]}'"), 4) and not a._crowded(df, 1)


def test_the_query_moves_clones_once_and_writes_no_stage(spark):
    before = len(session._STAGES)
    out = load()[0]["merge_commit_artifacts"](spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count() and len(session._STAGES) == before
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3 and "Join Inner" not in plan  # lines and orders by their key, clones by their commit


def test_the_query_counts_united_references_and_targets(spark):
    out = load()[0]["merge_commit_artifacts"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.refs == r.files + 2 and r.targets == 2 and r.events == 1 for r in out)


def test_of_clones_merged_heads_alone_are_written(spark):
    from tracefold.plans.catalog.whole import _artifacts

    before = set(session._STAGES)
    tables, _ = _artifacts(spark, "/root/testdata/sf0.001")
    staged = [spark.read.parquet(p) for p in session._STAGES if p not in before and "/commits-" in p]
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert [s.count() for s in staged] == [orders] and "source_refs" not in staged[0].columns
    assert all(".zstd." in f for f in staged[0].inputFiles())
    stages = [spark.read.parquet(p) for p in session._STAGES if p not in before]
    assert not any(s.where("kind = 'output_created'").count() for s in stages if "object_key" in s.columns)
    refs = tables.refs.where("id like 'artifact:git:%' and type = 'git'")
    assert refs.count() == 2 * orders and tables.events.where("id like 'artifact:git:%' and event_id like 'git:%'").count() == orders
