import pytest

import corpus_pipeline
from tests.check import compare, connect
from tests.llm.test_ngram_join import brute as components
from tracefold.llm.catalog import ORACLES, QUERIES
from tracefold.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, count = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None and count > 0, problem


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        kept.append({r.doc_id: r.text for r in after.select("doc_id", "text").collect()})
        docs = after
    language, exact, near = kept
    # Exact copies: one text without white space each, of all that came in.
    plain = lambda t: "".join(t.translate({c: None for c in [0x20, *range(9, 14)]}))
    groups = {}
    for i, t in language.items():
        groups.setdefault(plain(t), []).append((-len(t), i))
    assert set(exact) == {min(g)[1] for g in groups.values()}
    want = components([(i, t) for i, t in sorted(exact.items())])
    assert set(near) == {i for i, n, c in want if i == c or not n}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(near)


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
