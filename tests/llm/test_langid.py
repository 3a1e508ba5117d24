import zlib

import numpy as np

from tracefold.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, held_out string"
WORDS = {"en": "the and thing over with there when that".split(), "fr": "été où leçon chère voilà être aussi même".split()}


def corpus(n=120):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(rng.choice(WORDS[lang], 12)), lang, "s", "h"))
    return rows


def slow_bundle(text, dimensions):
    """Letter by letter, as the method is defined."""
    codes, last = [0], 0
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or last:
            codes.append(code)
        last = code
    if codes[-1]:
        codes.append(0)
    total = np.zeros(dimensions)
    for i in range(len(codes) - 2):
        gram = np.ones(dimensions)
        for place in range(3):
            gram *= np.roll(langid.letter_vector(codes[i + 2 - place], dimensions), place)
        total += gram
    return total


def test_bundles_equal_the_definition():
    texts = ["Abc, déf!", "", "  ", "x", "12", "a b c aaa", "İstanbul ß", "中文 字", "\0nul\0"]
    vectors, _ = langid.bundles(texts, 64)
    assert np.array_equal(vectors, np.stack([slow_bundle(t, 64) for t in texts]))


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(1000, None, "en", "", ""), (1001, "", None, "", ""), (1002, "12 34 !", "fr", "", ""), (None, "the thing", None, "", ""), (1003, "été " * 3000, None, "", ""), (3, corpus()[3][1], "fr", "", "")]
    got = {}
    for r in langid.identify(spark.createDataFrame([*corpus(), *odd], SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, rs in got.items() if i is not None for r in rs)
    assert all(got[i][0].lang_pred == lang for i, _, lang, _, _ in corpus())
    assert [(got[i][0].lang_pred, got[i][0].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0].lang_pred == "fr" and 0 <= got[1003][0].score <= 1
    assert got[None][0].lang_pred == "en" and not got[None][0].held_out and len(got[3]) == 2


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None, "", "")], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0


def test_filter_keeps_columns_and_clean_texts(spark):
    noise = "".join(chr(0x4E00 + i) for i in range(900))
    odd = [(1000, None, "en", "a", "b"), (1001, "12", "en", "a", "b"), (1002, "the", "en", "a", "b"), (1003, noise, "en", "a", "b")]
    rows = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 4 != 2 or True]
    kept = langid.keep_identified(spark.createDataFrame([*rows, *odd[:3]], SCHEMA).unionByName(spark.createDataFrame([(2, noise, None, "a", "b")], SCHEMA)))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "lang", "score", "held_out"]
    assert sorted(ids) == sorted([r[0] for r in rows] + [1002])
