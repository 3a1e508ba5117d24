import random
import zlib
from collections import Counter
from math import comb

from tracefold.llm.sharding import communication_matrix, hypergeometric, shard_digest, shard_rows

SCHEMA = "doc_id long, text string, shard string, slot string, _x string"


def test_every_kind_of_row(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text é {i}", "s", "t", "x") for i in range(400)]
    rows += [(None, None, "", "", ""), (None, None, "", "", ""), (3, "copy", "", "", ""), (5, "", "", "", ""), (6, "y" * 50000, "", "", "")]
    got = shard_digest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = Counter(r.shard for r in got)
    assert set(shards) == set(range(40)) and max(shards.values()) - min(shards.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, k) for s, n in shards.items() for k in range(n))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_small_blocks_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr("tracefold.llm.sharding.CELL_ROWS", 7)
    df = spark.createDataFrame([(i, "t", "s", "t", str(i)) for i in range(200)], SCHEMA)
    got = shard_rows(df, 3, cell_rows=9).collect()
    assert sorted(int(r._x) for r in got) == list(range(200)) and all(r.doc_id == int(r._x) for r in got)
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, k) for s, n in ((0, 67), (1, 67), (2, 66)) for k in range(n))


def test_fewer_rows_than_shards_and_none(spark):
    df = spark.createDataFrame([(1, "a", "", "", ""), (2, "b", "", "", "")], SCHEMA)
    assert sorted((r.slot, r.shard < 40) for r in shard_digest(df).collect()) == [(0, True), (0, True)]
    assert shard_digest(df.limit(0)).count() == 0


def test_matrix_sums():
    counts, sizes = [5, 0, 17, 1, 40], [13, 13, 13, 12, 12]
    for seed in range(20):
        matrix = communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in matrix] == counts and [sum(c) for c in zip(*matrix)] == sizes


def test_draws_follow_the_law():
    rng, n = random.Random(1), 20000
    seen = Counter(hypergeometric(rng, 7, 5, 4) for _ in range(n))
    for k in range(5):
        p = comb(7, k) * comb(5, 4 - k) / comb(12, 4)
        assert abs(seen[k] / n - p) < 0.015
    assert 0 <= hypergeometric(rng, 10**10, 10**11, 10**9) <= 10**9


def test_places_are_even(spark):
    df = spark.createDataFrame([(i, "t", "", "", "") for i in range(60)], SCHEMA)
    first = Counter()
    for seed in range(12):
        first.update(r.doc_id // 20 for r in shard_rows(df, 2, seed).where("shard = 0").collect())
    assert all(abs(v - 120) < 45 for v in first.values())
