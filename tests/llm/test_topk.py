import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm.topk import ImpactIndex, best, top_k

SCHEMA = "vec_id long, embedding array<float>, query_id string, rank string"


def brute(rows, k):
    """rows: {id: list of whole numbers}."""
    out = []
    for q, a in rows.items():
        if q % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 12), st.sampled_from([1, 3, 1000, 10**9]))
def test_search_is_exact(seed, n, width, size):
    rng = np.random.default_rng(seed)
    values = rng.integers(-size, size + 1, (n, width))
    values[rng.random(n) < 0.3] = values[0]  # ties
    ids = rng.permutation(n) * 7
    index = ImpactIndex(ids, values)
    for q in range(min(n, 5)):
        found, scores, _ = index.search(values[q], int(ids[q]), 10)
        top = best(found, scores, 10)
        full = sorted((-int(sum(int(a) * int(b) for a, b in zip(values[i], values[q]))), int(ids[i])) for i in range(n) if i != q)[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores[top], found[top])] == full


def test_stops_on_proof(monkeypatch):
    monkeypatch.setattr("tracefold.llm.topk.ROUND", 2)
    monkeypatch.setattr("tracefold.llm.topk.FEW", 100)
    rng = np.random.default_rng(1)
    values = (rng.standard_t(2, (3000, 6)) * 100).astype(np.int64)
    _, _, done = (index := ImpactIndex(np.arange(3000), values, 300)).search(np.array([9, 1, 1, 1, 0, 0]), None, 10)
    assert done < len(index.segments)


def test_rows_of_every_kind(spark):
    rng = np.random.default_rng(3)
    good = {i: [float(x) for x in rng.integers(-40, 40, 6) / 16] for i in range(0, 230)}
    good.update({300: good[5], 301: good[5], 400: []})
    bad = [(500, None), (600, [1.0, None]), (700, [float("nan")]), (800, [float("inf"), 1.0]), (None, [1.0] * 6)]
    rows = [(i, v, "x", "y") for i, v in [*good.items(), *bad, (5, good[5])]]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute({i: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v] + [0] * (6 - len(v)) for i, v in good.items()}, 10)
    got = top_k(df, df.where("vec_id % 100 = 0"), block_rows=60).collect()
    assert sorted(tuple(r) for r in got) == want


def test_fewer_rows_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], "", ""), (1, [2.0], "", "")], SCHEMA)
    assert [tuple(r) for r in top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0
