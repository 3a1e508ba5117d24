import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import collocations as c
from tracefold.llm.catalog import ORACLES

SCHEMA = "doc_id long, text string, lang string, part string, f string, phrase string, n string"
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, threshold, most):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: f for key, f in counts.items() if f >= threshold and len(key[1]) > 1}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = {}
    for (lang, p), a in found.items():
        if any(m == lang and len(q) > len(p) and 100 * f >= 100 * a and inside(p, q) for (m, q), f in found.items()):
            continue
        n = total[lang]
        score, _, l, r = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r, n))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, xs in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(xs)[:most]))


def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "中文", "\x00", "\x1c", " x", " "]
    out = []
    for i in range(300):
        text = "".join(rng.choice(words[: rng.choice((5, 46))]) + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n")) for _ in range(rng.randrange(60)))
        out.append((i, text, rng.choice(("en", "fr", None, "und", ""))))
    out += [(1, "the very same hot phrase again", "en")] * 200
    out += [(None, None, "en"), (5, "", None), (6, " ,. ", "xx"), (7, "x " * 5000, "en"), (8, "y" * 9000, "en"), (9, "GNU's Not Unix " * 50, "en")]
    return out


@pytest.fixture(params=["10m", "-1"])
def joins(spark, request):
    """With joins that may broadcast, and with joins that may not: counters must reach their task either way."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("window, entries, mass", [(1 << 20, 1 << 20, 1 << 26), (50, 60, 256)])
def test_phrases_equal_brute_force(spark, joins, window, entries, mass):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows()], SCHEMA).repartition(7)
    got = c.collocations(df, 6, 25, window=window, entries=entries, part_mass=mass)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows(), 6, 25)


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_beyond_64_bits(spark):
    got = spark.range(1).selectExpr("4000000000000L a", "5000000000000L n", "4000000000001L l", "4000000000003L r").selectExpr(
        "(cast(a as decimal(18,0)) * cast(1000 * n as decimal(19,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) s").first().s
    assert got == 1000 * 4000000000000 * 5000000000000 // (4000000000001 * 4000000000003)


def test_sql_twin_agrees_with_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows())
    cur = con.execute(ORACLES["op12_collocations"])
    assert [d[0] for d in cur.description] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(cur.fetchall()) == brute(rows(), 100, 2000)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=30), max_size=12), st.integers(2, 9))
def test_merged_summaries_forget_less_than_the_threshold(parts, threshold):
    mass, true = sum(map(len, parts)), Counter(x for p in parts for x in p)
    summary = c.MisraGries(mass // threshold + 1)
    for p in parts:
        cells, counts = np.unique(np.array(p, np.int64), return_counts=True)
        summary.add(np.cumsum(c.unpack(c.pack(np.diff(cells, prepend=0)))), c.unpack(c.pack(counts)))
        assert len(summary.cells) <= summary.capacity
    assert summary.lost < threshold
    assert {x for x, f in true.items() if f >= threshold} <= set(summary.possible(threshold).tolist())
    held = dict(zip(summary.cells.tolist(), summary.counts.tolist(), strict=True))
    assert all(held.get(x, 0) <= f <= held.get(x, 0) + summary.lost for x, f in true.items())
