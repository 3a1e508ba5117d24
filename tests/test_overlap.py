"""Overlap links against the rule for pairs, on random sets and on sets that are expensive for one of the ways."""

import random
import time

import pytest

from tracefold.operators import overlap
from tracefold.operators.overlap import overlap_components

EDGES = "src string, dst string"


def brute(sets, known):
    """(scope, id) -> items; ids link across all scopes."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for a, b in known:
        join(a, b)
    by_scope = {}
    for (scope, i), items in sets.items():
        by_scope.setdefault(scope, []).append((i, items))
    for members in by_scope.values():
        for at, (i, a) in enumerate(members):
            for j, b in members[:at]:
                if len(a & b) >= 2:
                    join(i, j)
    return {x: root(x) for x in parent}


def run(spark, sets, known=()):
    rows = [(scope, i, item) for (scope, i), items in sets.items() for item in items]
    random.Random(1).shuffle(rows)
    entries = spark.createDataFrame(rows, "day string, id string, item string").repartition(6)
    found = overlap_components(entries, ["day"], spark.createDataFrame(list(known), EDGES))
    got = {r.node: r.component for r in found.collect()}
    return {x: c for x, c in got.items() if x != c}, len(rows)


def apart(components):
    return {x: c for x, c in components.items() if x != c}


@pytest.mark.parametrize("few, seed", [(48, 1), (2, 2), (0, 3), (5, 4)])
def test_random_sets(spark, monkeypatch, few, seed):
    monkeypatch.setattr(overlap, "FEW", few)
    rng = random.Random(seed)
    sets = {}
    for n in range(150):
        pool = rng.choice((6, 40, 300))
        sets[f"d{n % 3}", f"i{n:03d}"] = {f"f{min(rng.randrange(pool), rng.randrange(300))}" for _ in range(rng.choice((1, 2, 3, 12, 40)))}
    sets["d0", "i001"] = {"f1", "f2", "q"}  # one id in two scopes
    known = [("i007", "i003"), ("i100", "i099"), ("other", "i004")]
    got, _ = run(spark, sets, known)
    assert got == apart(brute(sets, known))


@pytest.mark.parametrize("few", [48, 3])
def test_every_way_finds_links_alone(spark, monkeypatch, few):
    """No neighbouring pair is shared: rare with rare, rare with common, common with common by pairs and by counting."""
    monkeypatch.setattr(overlap, "FEW", few)
    sets = {("d", f"hub{n:02d}"): {f"c{n % 8}", f"u{n}"} for n in range(64)}  # c0..c7 have many holders
    sets["d", "p"] = {"c0", "c2", "c4", "x", "y1"}
    sets["d", "q"] = {"c1", "c2", "c3", "c4", "c5", "c6", "c7", "y2"}
    sets["d", "r"] = {"x", "c6", "c7", "y3"}
    sets["d", "s"] = {"c0", "y4", "c7"} | {f"z{i}" for i in range(20)}
    got, _ = run(spark, sets)
    assert got == apart(brute(sets, []))


def test_nothing_to_link(spark):
    assert run(spark, {("d", "a"): {"x"}, ("d", "b"): {"x"}, ("e", "c"): {"x", "y"}})[0] == {}
    assert run(spark, {("d", "a"): {"x", "y"}, ("e", "b"): {"x", "y"}}, [("b", "a")])[0] == {"b": "a"}


def test_large_sets_cost_what_they_hold(spark):
    """Three sets of 3,000 shared items take about as long as three of 300; pairs of items would be a hundred times as many."""
    def seconds(items, holders=3):
        sets = {("d", f"a{n}"): {f"f{i}" for i in range(items)} | {f"own{n}"} for n in range(holders)}
        begin = time.time()
        got, _ = run(spark, sets)
        assert got == {f"a{n}": "a0" for n in range(1, holders)}
        return time.time() - begin

    seconds(300)
    small = seconds(300)
    assert seconds(3000) < 3 * small + 5
    assert seconds(60, 2000) < 3 * small + 20  # many equal sets: linked by neighbours, never by pairs of sets
