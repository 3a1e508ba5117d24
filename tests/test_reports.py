"""Reports folded into the commits they name."""

import datetime as dt

from tracefold.operators import artifacts as a
from tracefold.plans import snapshot

REF = "struct<type:string,label:string,path:string,url:string,line:int,excerpt:string>"
SCHEMA = (
    "id string, local_date date, occurred_at timestamp, time_basis string, project_key string, project_label string, task_key string, kind string, title string, problem string, "
    f"result string, validation array<string>, limitations array<string>, proof string, source_event_ids array<string>, source_refs array<{REF}>"
)
DAY, HASH = dt.date(2026, 1, 1), "a1bb5a21234567890abcdef01234567890abcdef"


def row(i, hour, events, refs, problem=None, result="r", validation=(), limitations=(), kind="git-commit"):
    return (i, DAY, dt.datetime(2026, 1, 1, hour), "source", "p", "P", None, kind, "T", problem, result, list(validation), list(limitations), "independent", events, refs)


def ref(kind, label, path=None):
    return (kind, label, path, None, None, None)


def folded(spark, reports, clones=1):
    commit = f"artifact:git:{HASH}"
    made = [row(commit, 1 + c, [f"git:{c}"], [ref("git", "a1bb", f"/c{c}"), ref("file", "x.py", f"/c{c}/x.py")], validation=["there"]) for c in range(clones)]
    commits = a.commit_tables(spark.createDataFrame(made, SCHEMA))
    told = spark.createDataFrame(reports, SCHEMA)
    attached = a.attach_reports_to_commits(told, spark.createDataFrame([(commit, HASH)], "commit_id string, hash string"))
    return *a.fold_reports(commits, told, attached), commit


def test_a_commit_gains_all_its_report_says(spark):
    first = row("r1", 3, ["e1", "s1"], [ref("codex", "page", "a.md")], "why", f"已提交 commit {HASH[:8]}", ["tests pass", "built"], ["slow"], "completion-report")
    last = row("r2", 4, ["e2", "s1"], [ref("codex", "page", "a.md"), ref("codex", "other", "b.md")], "why now", f"commit {HASH[:9]} again", ["tests pass"], [], "completion-report")
    free = row("r3", 5, ["e3"], [], "x", "nothing named", kind="completion-report")
    tables, alone, commit = folded(spark, [last, free, first], clones=2)
    head = tables.heads.collect()
    assert [(r.id, r.problem, r.kind) for r in head] == [(commit, "Codex 报告：why now", "git-commit")]
    lines = [(r.field, r.value) for r in tables.lines.orderBy("field", "place").collect()]
    assert lines == [
        ("limitation", "Codex 报告：slow"), ("validation", "there"), ("validation", f"Codex 交付说明：已提交 commit {HASH[:8]}"), ("validation", "Codex 报告：tests pass"),
        ("validation", "Codex 报告：built"), ("validation", f"Codex 交付说明：commit {HASH[:9]} again"),
    ]
    assert {r.event_id for r in tables.events.collect()} == {"git:0", "git:1", "e1", "s1", "e2"}
    assert sorted((r.type, r.path) for r in tables.refs.collect()) == [("codex", "a.md"), ("codex", "b.md"), ("file", "/c0/x.py"), ("file", "/c1/x.py"), ("git", "/c0"), ("git", "/c1")]
    assert [r.id for r in alone.collect()] == ["r3"]


def test_heads_do_not_depend_on_partitions(spark):
    rows = [row(f"artifact:git:{HASH}", 1, [f"git:{c}"], [], result=f"result {c}") for c in range(20)]
    seen = {a.commit_tables(spark.createDataFrame(rows, SCHEMA).repartition(n)).heads.first().title for n in (1, 3, 7)}
    got = {tuple(a.commit_tables(spark.createDataFrame(rows[::s], SCHEMA).repartition(n)).heads.first()) for n in (1, 5) for s in (1, -1)}
    assert len(seen) == len(got) == 1


def test_settlement_of_a_reports_event_finds_the_commit(spark):
    report = row("r1", 3, ["e1"], [], None, f"commit {HASH[:8]}", kind="completion-report")
    tables, _, _ = folded(spark, [report])
    ledger = spark.createDataFrame([("s", "succeeded", dt.datetime(2026, 1, 2), "durable-output", "L")], "id string, status string, updated_at timestamp, category string, title string")
    events = spark.createDataFrame([("e1", DAY, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1), "p", "P", "k", "task_started", "t", "s", "sess", "turn")],
        "id string, local_date date, occurred_at timestamp, observed_at timestamp, project_key string, project_label string, task_key string, kind string, title string, summary string, session_id string, turn_id string")
    out = snapshot.build_outcomes(tables, events, ledger, spark.createDataFrame([("s", "e1")], "settlement_id string, event_id string")).collect()
    assert [(r.id, r.settlement_status, r.event_count) for r in out] == [("s", "succeeded", 2)]


def test_no_reports(spark):
    tables, alone, commit = folded(spark, [])
    assert alone.count() == 0 and tables.heads.first().problem is None and tables.lines.count() == 1
