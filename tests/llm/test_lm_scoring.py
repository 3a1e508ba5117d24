import math
import random
from collections import Counter

import numpy as np
import pytest

from tracefold.llm import lm_scoring
from tracefold.llm.lm_scoring import cross_entropy_difference, loosened, squeezed

SCHEMA = "doc_id long, text string, score string, is_target string, n_tokens string"


def test_target_texts_score_lower(spark):
    rows = [(i, "alpha beta gamma " * 5, "", "", "") for i in range(20)] + [(100 + i, "spam ham eggs " * 5, "", "", "") for i in range(60)]
    target = spark.createDataFrame([(i, True) for i in range(10)], "doc_id long, is_target boolean")
    got = {r.doc_id: r.score for r in cross_entropy_difference(spark.createDataFrame(rows, SCHEMA), target).collect()}
    assert got[15] < 0 < got[120]


def test_no_target_no_rows_and_null_ids(spark):
    target = spark.createDataFrame([], "doc_id long, is_target boolean")
    df = spark.createDataFrame([(None, "a b", "", "", ""), (1, "a", "", "", ""), (1, "a", "", "", "")], SCHEMA)
    assert [r.score for r in cross_entropy_difference(df, target).collect()] == [0.0, 0.0, 0.0]
    assert cross_entropy_difference(df.limit(0), target).count() == 0


@pytest.mark.parametrize("head", [4, 1 << 18])
def test_every_word_and_pair_counts(spark, monkeypatch, head):
    """More words than any table of classes, and one of over 64 bytes; by postings, and by the broadcast table alone."""
    monkeypatch.setattr(lm_scoring, "BUCKET", 300)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(1500)] + ["漢" * 40]
    rows = [(i, " ".join([rng.choice(words[i % 3 :: 3]) for _ in range(60)] + ["the the end"] * (i % 2)), "", "", "") for i in range(90)]
    rows += [(100, " ".join(words), "", "", ""), (101, None, "", "", ""), (None, "w1 w2", "", "", ""), (102, "", "", "", ""), (103, "w2 " * 3000, "", "", ""), (104, "only", "", "", "")]
    good = set(range(0, 90, 3))
    single, pairs, context, size = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for i, t, *_ in rows:
        ws = (t or "").split()
        for m in (0, 1) if i in good else (1,):
            size[m] += len(ws)
            single[m].update(ws)
            pairs[m].update(zip([None, *ws], ws))
            context[m].update([None, *ws][: len(ws)])
    scales, kinds = (1.0, size[0] / size[1]), len(single[1]) + 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    target = spark.createDataFrame([(i, True) for i in good], "doc_id long, is_target boolean")
    got = {r.doc_id: r for r in cross_entropy_difference(df, target, head=head).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ws = (t or "").split()
        assert got[i].n_tokens == len(ws)
        if not ws:
            assert got[i].score is None
            continue
        want = [
            -sum(math.log((pairs[m][a, b] * s + 20 * (single[m][b] * s + 1) / (size[m] * s + kinds)) / (context[m][a] * s + 20)) for a, b in zip([None, *ws], ws)) / len(ws)
            for m, s in enumerate(scales)
        ]
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(want, abs=1e-8) and got[i].score == pytest.approx(want[0] - want[1], abs=1e-8)


def test_numbers_survive_packing():
    for kind in (np.uint32, np.uint64, np.int64):
        for values in ([], [0], [1, 1, 2, 300, 70_000], list(range(5000))):
            assert loosened(squeezed(np.array(values, kind)), kind).tolist() == values
