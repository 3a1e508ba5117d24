import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm.exact_dedup import PatriciaTrie, exact_dedup, kept_documents

SCHEMA = "doc_id long, text string, sha string, keep_id string, kept string"


def brute(rows):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, k := min(groups[plain(t)])[3], len(groups[plain(t)]), i == k, hashlib.sha256(plain(t).encode()).hexdigest()) for i, t, *_ in rows), key=repr)


def rows():
    out = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "ab\u00a0"), (8, "x" * 90000), (9, "x" * 89999 + " x"), (9, "ab"), (None, "ab   "), (None, "solo"), (10, "é"), (11, "e\u0301")]
    return [(i, t, "s", "k", "p") for i, t in out] + [(100 + i, "same text", "", "", "") for i in range(300)]


def test_every_kind_of_row(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    for memory in (1, 8 << 20):  # spilling after every batch changes nothing
        assert sorted((tuple(r) for r in exact_dedup(df, memory=memory).collect()), key=repr) == brute(rows())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(df).count() == 0 and kept_documents(df).count() == 0


def test_kept_documents_have_all_columns(spark):
    df = spark.createDataFrame([*rows(), rows()[0]], SCHEMA)
    kept = kept_documents(df)
    assert kept.columns == df.columns
    want = [keep for keep, _ in {(x[1], x[4]) for x in brute(rows())}]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 3), st.integers(0, 9)), max_size=40), st.binary(max_size=3))
def test_trie_holds_what_a_dict_holds(items, bound):
    trie, want = PatriciaTrie(), {}
    for key, points, i in items:
        trie.insert(key, points, i, 1)
        old = want.get(key)
        want[key] = (points, i, 1) if old is None else (*min((old[:2], (points, i)), key=lambda x: (-x[0], x[1])), old[2] + 1)
    early = {k: tuple(v) for k, v in trie.spill(bound)}
    late = {k: tuple(v) for k, v in trie.spill(None)}
    assert {**early, **late} == want and not early.keys() & late.keys()
    assert all(k[: len(bound)] < bound for k in early)


def test_texts_are_given_up_by_the_owners_before_they_are_joined(spark):
    plan = kept_documents(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # owners are read from a stage, not computed beside the join
