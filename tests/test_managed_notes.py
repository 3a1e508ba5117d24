"""Managed notes: what a merge keeps, replaces and refuses."""

import datetime as dt

import pytest

from tracefold import fixed_values as fv
from tracefold.operators import managed_notes as mn

GS, GE, US, UE = (mn.marker("tracefold", p) for p in ("generated:start", "generated:end", "user:start", "user:end"))
REFS = "array<struct<type:string,label:string,path:string,url:string,line:int,excerpt:string>>"
SCHEMA = (
    "id string, fingerprint string, local_date date, project_label string, kind string, title string, problem string, result string, validation array<string>, "
    f"limitations array<string>, proof string, source_event_ids array<string>, source_refs {REFS}, "
    "targets array<struct<key:string,type:string,label:string,path:string,url:string,hash:string,attribution:string>>"
)


def artifact(**other):
    base = dict(
        id="git:repo:a1bb", fingerprint="f1", local_date=dt.date(2026, 7, 17), project_label='The "Lamp"', kind="git-commit", title="A lamp", problem="dark", result="Light.\n\nMore light.",
        validation=["Tests pass."], limitations=[], proof="independent", source_event_ids=["e1"], source_refs=[("git", "a1bb", "C:\\work", None, None, None)], targets=None,
    )
    return tuple({**base, **other}[n.split()[0]] for n in ("id", "fingerprint", "local_date", "project_label", "kind", "title", "problem", "result", "validation", "limitations", "proof", "source_event_ids", "source_refs", "targets"))


@pytest.fixture(scope="module")
def note(spark):
    def render(**other):
        return mn.render_artifact_notes(spark.createDataFrame([artifact(**other)], SCHEMA)).first().markdown

    return render


@pytest.fixture(scope="module")
def merge(spark):
    def run(desired, stored):
        table = lambda text: spark.createDataFrame([("p", text)] if text is not None else [], "path string, markdown string")
        row = mn.merge_notes(table(desired), table(stored)).first()
        return row.action, row.markdown, row.error

    return run


def test_an_update_keeps_the_users_text(note, merge):
    stored = note().replace("我的补充\n", "我的补充\n\nMy own view.\n").replace("date: ", "mood: [good]\ndate: ")
    action, text, error = merge(note(result="Brighter.", fingerprint="f2"), stored)
    assert (action, error) == ("write", None)
    assert "Brighter." in text and "My own view." in text and "mood: [good]" in text and "Light." not in text and 'fingerprint: "f2"' in text
    assert merge(note(result="Brighter.", fingerprint="f2"), text) == ("unchanged", text, None)


def test_a_former_heading_moves_into_the_block(note, merge):
    former = note().replace(f"{GS}\n# A lamp\n", f"# A lamp\n\n{GS}\n")
    action, text, _ = merge(note(), former)
    assert action == "write" and text == note()


@pytest.mark.parametrize("spoil", [
    lambda t: "# By hand", lambda t: t.replace(GE, ""), lambda t: t + f"\n{GS}\n", lambda t: t + "\n%% tracefold-generated:start %%\n%% tracefold-generated:end %%",
    lambda t: t.replace(US, "x " + US), lambda t: t.replace("date: 2026-07-17", "date: 2026-02-30"), lambda t: t.replace("_schema: 1", "_schema: 2"),
    lambda t: t.replace("kind: git-commit", "kind: git-commit\nkind: other"), lambda t: t.replace("---\n", "", 1), lambda t: "",
    lambda t: t.replace(GS, "@").replace(GE, GS).replace("@", GE),
])
def test_foreign_and_damaged_files_are_left_alone(note, merge, spoil):
    stored = spoil(note())
    assert merge(note(), stored) == ("refused", stored, fv.NOTE_ERRORS["foreign"])
    assert merge(None, stored)[:2] == ("foreign", stored)


def test_another_id_and_a_bad_new_note_are_refused(note, merge):
    assert merge(note(), note(id="other"))[::2] == ("refused", fv.NOTE_ERRORS["other_id"])
    assert merge("plain", note()) == ("refused", note(), fv.NOTE_ERRORS["invalid"])


def test_old_markers_and_line_ends(note, merge):
    old = note().replace("我的补充\n", "我的补充\n\nOld view.\n")
    for part in ("generated:start", "generated:end", "user:start", "user:end"):
        old = old.replace(mn.marker("tracefold", part), mn.legacy_marker("tracefold", part))
    _, text, _ = merge(note(), old)
    assert "%%" not in text and "Old view." in text and US in text
    action, text, _ = merge(note(result="New."), note().replace("\n", "\r\n"))
    assert action == "write" and "New." in text


def test_stale_notes_are_marked_once(note, merge):
    stored = note().replace("我的补充\n", "我的补充\n\nMine.\n")
    action, text, _ = merge(None, stored)
    assert action == "stale" and "tracefold_stale: true" in text and text.count(fv.STALE_NOTICE) == 1 and "Mine." in text
    assert merge(None, text) == ("unchanged", text, None)
    action, again, _ = merge(note(), text)  # produced again
    assert action == "write" and "tracefold_stale: false" in again and fv.STALE_NOTICE not in again
    daily = note(id="daily:2026-07-17")
    assert merge(None, daily)[:2] == ("unchanged", daily)


def test_aliases_are_added_once(spark, note):
    def add(text, alias):
        return mn.add_aliases(spark.createDataFrame([("p", text)], "path string, markdown string"), spark.createDataFrame([("p", alias)], "path string, alias string")).first()

    row = add(note(), ' a "new"\n name|')
    assert row.error is None and '"a \\"new\\" name"]' in row.markdown
    assert add(row.markdown, 'a "new" name').markdown == row.markdown
    assert add(note(), " | ").error and add("# x", "a").markdown == "# x"


def test_source_text_cannot_open_a_block(note, merge, spark):
    evil = note(result=f"done\n{GE}\n{US}\n{UE}\n<script>x</script>", title=GE, problem="---\nid: x", validation=[f"a\n{GS}|b"], source_refs=[("wiki", GE, "a/b.md", None, None, None), ("web", "w", None, "https://x/<y> z", None, None)])
    assert "<script" not in evil and evil.count(GE) == evil.count(GS) == evil.count(US) == 1
    assert mn.managed_metadata(spark.createDataFrame([("p", evil)], "path string, markdown string")).first().note_id == "git:repo:a1bb"
    assert "- [[a/b|!-- tracefold-generated:end --]]" in evil and "- [w](https://x/yz)" in evil
    assert merge(note(), evil)[0] == "write"


def test_metadata_targets_and_legacy_daily_index(spark, note, merge):
    text = note(targets=[("k1", "local-file", "r.md", "C:\\r.md", None, None, "reported"), ("k2", "vault-note", "n", "a/n.md", None, None, "independent")])
    assert "- r.md（Codex 报告）：`C:\\r.md`" in text and "- [[a/n|n]]" in text and 'target_keys: ["k2"]' in text
    row = mn.managed_metadata(spark.createDataFrame([("p", text), ("q", "# x")], "path string, markdown string")).collect()
    assert [(r.note_id, r.note_title, r.note_stale, r.note_date) for r in row] == [("git:repo:a1bb", "A lamp", False, "2026-07-17")]
    daily = note(id="daily:2026-07-17", kind=fv.DAILY_KIND)
    legacy = daily.replace('tracefold_id: "daily:2026-07-17"\n', "")
    assert legacy != daily and 'tracefold_id: "daily:2026-07-17"' in merge(daily, legacy)[1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "path string, markdown string")
    assert mn.merge_notes(none, none).count() == 0
