import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracefold.llm import ngram_join
from tracefold.llm.ngram_join import _PLACE, _prefixes, allowed_pairs, kept_documents, may_link, ngram_components, parity_map, prefix_length, required, search_block, set_id, shingle_sets

SCHEMA = "doc_id long, text string, ent string, n string, component_id string"


def brute(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    inverted, parent = defaultdict(list), list(range(len(rows)))
    for k, s in enumerate(sets):
        for x in s:
            inverted[x].append(k)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, s in enumerate(sets):
        for j, o in Counter(j for x in s for j in inverted[x] if j > k).items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                parent[root(j)] = root(k)
    low = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        low[root(k)].append(i)
    smallest = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, len(sets[k]), smallest(low[root(k)])) for k, (i, *_) in enumerate(rows)), key=repr)


def rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(60):
        out.append(" ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 7, 9, 40, 120, 300]))))
    for i in range(30):  # copies of copies, so that components are chains
        w = out[rng.randrange(len(out))].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w) if rng.random() < 0.8 else " ".join(w).upper())
    base = " ".join(rng.choice(words) for _ in range(90)).split()
    for i in range(150):  # one large group
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    out += [None, "", " \n", "one two", "one\ttwo", "One TWO", "é ü", "a b c d", "x " * 4000, "x " * 3000]
    out += ["same five words right here"] * 40
    return [(i, t, "e", "n", "c") for i, t in enumerate(out)] + [(None, "a b c d", "", "", ""), (None, "no one else says this at all", "", "", ""), (3, out[3], "", "", "")]


def test_components_equal_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    got = sorted((tuple(r) for r in ngram_components(df).collect()), key=repr)
    assert got == brute(rows())


def test_kept_and_empty(spark):
    df = spark.createDataFrame(rows()[:120], SCHEMA)
    kept = kept_documents(df)
    want = {c for _, n, c in brute(rows()[:120]) if n} | {i for i, n, _ in brute(rows()[:120]) if not n}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_components(empty).count() == 0 and kept_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_block_search_links_what_links(seed):
    rng = np.random.default_rng(seed)
    universe = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(rng.choice(universe, rng.integers(1, 50))) for _ in range(30)]
    sets += [np.unique(np.concatenate((s[: max(1, int(len(s) * 0.9))], universe[:2]))) for s in sets]
    linked = [[len(np.intersect1d(a, b)) * 7 >= 3 * (len(a) + len(b)) for b in sets] for a in sets]

    def components(edges):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    every = [(i, j) for i in range(len(sets)) for j in range(i) if linked[i][j]]
    found = list(search_block(sets))
    assert all(linked[i][j] for i, j in found) and components(found) == components(every)
    asked = list(search_block(sets, 1))
    assert {frozenset(x) for x in asked} <= {frozenset((0, j)) for j in range(len(sets)) if linked[0][j]}
    assert components(asked) == components([(0, j) for j in range(1, len(sets)) if linked[0][j]])


def test_prefix_and_overlap_bounds():
    for n in range(1, 200):
        for m in range(n, 270):
            o = required(n, m)
            assert 100 * o >= 75 * (n + m - o) and 100 * (o - 1) < 75 * (n + m - o + 1)
            if o <= n:
                assert prefix_length(n) >= n - o + 1 and prefix_length(m) >= m - o + 1


def test_shingles_of_short_texts():
    a, b, c, d = shingle_sets(["one two", "ONE\x0btwo", "one", None])
    assert len(a) == len(b) == len(c) == 1 and a[0] == b[0] != c[0] and len(d) == 0


@pytest.mark.parametrize("seed", range(15))
def test_maps_never_rule_out_a_link(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64)
        sets.append(np.unique(base))
        for share in (0.95, 0.8, 0.5):
            sets.append(np.unique(np.concatenate((base[: max(1, int(len(base) * share))], rng.integers(0, 1 << 62, 3).astype(np.uint64)))))
    allowed = may_link(np.array([len(s) for s in sets]), [parity_map(s) for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and 7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b)):
                assert allowed[i] and allowed[j]
                assert may_link(np.array([len(a), len(b)]), [parity_map(a), parity_map(b)]).all()
    far = [np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(20)]
    assert not may_link(np.array([len(s) for s in far]), [parity_map(s) for s in far]).any()


@pytest.mark.parametrize("seed", range(10))
def test_pairs_in_a_list_hold_every_link(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(10):
        base = rng.integers(0, 1 << 62, rng.integers(2, 300)).astype(np.uint64)
        sets += [np.unique(np.concatenate((base[: max(1, int(len(base) * s))], rng.integers(0, 1 << 62, 2).astype(np.uint64)))) for s in (1, 0.95, 0.85)]
    order = rng.permutation(len(sets))
    sets, comps, queries = [sets[i] for i in order], rng.integers(0, 25, len(sets)), 12
    sizes = np.array([len(s) for s in sets])
    found = {frozenset(p) for p in allowed_pairs(sizes, comps, [parity_map(s) for s in sets], queries)}
    linked = {
        frozenset((i, j)) for i in range(queries) for j in range(len(sets))
        if i != j and comps[i] != comps[j] and 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (sizes[i] + sizes[j])
    }
    assert linked <= found and all(min(p) < queries and len({comps[i] for i in p}) == 2 for p in found)


def test_many_short_texts_in_one_task():
    texts = [f"title number {i} of many" for i in range(70_000)]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    batches = (pa.RecordBatch.from_arrays([pa.array(texts[i : i + 10_000])], ["text"]) for i in range(0, 70_000, 10_000))
    found = set()
    for batch in _prefixes(type("Hot", (), {"value": none}), 3)(batches):
        for _, places, ents, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place = np.frombuffer(places, _PLACE)
            found.update(zip(place["t"].tolist(), np.frombuffer(ents, "<i8")[place["d"]].tolist()))
    want = {(int(s[0]), set_id(s)) for s in shingle_sets(texts)}
    assert found == want


def test_blocks_of_long_lists_are_bounded_and_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    rng = random.Random(5)
    rows = [(7, i, n := rng.choice([50, 60, 75, 100, 140]), rng.randrange(0, n // 4), i if i % 5 else 0, 0) for i in range(300)]
    rows += [(8, i, 100, 20, i, 1) for i in range(300)]  # a passage late in all texts: no two can link
    rows += [(9, 1, 10, 0, 1, 1), (9, 2, 11, 2, 2, 1)]
    blocks = ngram_join._blocks(spark.createDataFrame(rows, "shingle long, ent long, n int, pos int, comp long, main long")).collect()
    cells = defaultdict(list)
    for r in blocks:
        cells[r.shingle, r.sub].append(r)
    assert {k[0] for k in cells} == {7, 9} and max(map(len, cells.values())) <= 64
    met = Counter()
    for (shingle, _), rs in cells.items():
        for x in range(len(rs)):
            for y in range(x):
                if {rs[x].query, rs[y].query} in ({1}, {0, 1}, {0, 2}) and rs[x].comp != rs[y].comp:
                    met[shingle, min(rs[x].ent, rs[y].ent), max(rs[x].ent, rs[y].ent)] += 1
    for s, i, n, p, c, _ in rows[:300]:
        for t, j, m, q, d, _ in rows[:i]:
            if c != d and required(n, m) <= min(n - p, m - q):
                assert met[s, j, i] == 1
    assert max(met.values()) == 1 and met[9, 1, 2] == 1


def test_components_of_lists_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    assert sorted((tuple(r) for r in ngram_components(df).collect()), key=repr) == brute(rows())


@pytest.mark.parametrize("seed", range(5))
def test_short_lists_together_give_the_pairs_of_each(seed):
    rng = np.random.default_rng(seed)
    lists, want, links = [], set(), set()
    for number in range(30):
        base = rng.integers(0, 1 << 62, rng.integers(2, 300)).astype(np.uint64)
        sets = [np.unique(np.concatenate((base[: max(1, int(len(base) * s))], rng.integers(0, 1 << 62, 2).astype(np.uint64)))) for s in rng.choice([1, 0.95, 0.85, 0.4], rng.integers(2, 12))]
        ents, comps, queries, across = [1000 * number + i for i in range(len(sets))], rng.integers(0, 6, len(sets)).tolist(), int(rng.integers(1, len(sets) + 1)), bool(rng.integers(2))
        sizes, maps = np.array([len(s) for s in sets]), [parity_map(s) for s in sets]
        lists.append((ents, sizes.tolist(), comps, maps, queries, across))
        for i, j in allowed_pairs(sizes, np.array(comps), maps, queries, across):
            if min(sizes[i], sizes[j]) >= required(sizes[i], sizes[j]):
                want.add(frozenset((ents[i], ents[j])))
        links |= {
            frozenset((ents[i], ents[j])) for i in range(len(sets)) for j in range(i)
            if comps[i] != comps[j] and ((i < queries) != (j < queries) if across else j < queries) and 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (sizes[i] + sizes[j])
        }
    found = [frozenset(p) for p in ngram_join.allowed_in_lists(lists)]
    assert set(found) == want and links <= want and len(found) == len(want)


def test_maps_take_two_bits_a_shingle_at_most():
    assert [len(parity_map(np.arange(n, dtype=np.uint64))) for n in (1, 64, 65, 1000)] == [8, 8, 16, 128]
