import pytest
from pyspark.sql import functions as F

from tracefold.llm.url_filter import difference, judge_urls, signs

SCHEMA = "page_id long, url string, host string, verdict string, rule string"
CASES = [
    ("http://a.ORG/x", "a.org", "/x", "org/", "allow"), ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("x://sub.Example.org/en/12?q#f", "sub.example.org", "/en/12", "example.org/en/1", "block"), ("x://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://shop.com/fr/a", "shop.com", "/fr/a", "com/fr/", "allow"), ("http://shop.com/de/", "shop.com", "/de/", "com/de/", "block"),
    ("http://shop.com/DE/", "shop.com", "/DE/", None, None), ("http://a.org", "a.org", "", None, None), ("http://a.org?x=/y", "a.org", "", None, None),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://org/", "org", "/", "org/", "allow"),
    ("http://É.net/a b#c://d", "É.net", "/a b", None, None), ("no scheme", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None),
    ("://", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None),
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, c[0], "h", "v", "r") for i, c in enumerate(CASES)] + [(None, "http://a.org/x", "", "", ""), (0, CASES[0][0], "", "", ""), (99, "http://x.net/" + "p" * 20000, "", "", "")]
    got = {}
    for r in judge_urls(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.page_id, []).append(r)
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[i][0]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert len(got[0]) == 2 and got[None][0].verdict == "allow" and got[99][0].verdict in ("allow", "block")


def test_models_judge_by_likeness(spark):
    rows = [(i, f"http://good{i % 9}.org/reading/page{i}", "", "", "") for i in range(150)]
    rows += [(1000 + i, f"http://spam{i % 9}.com/de/win-cash-{i}", "", "", "") for i in range(150)]
    rows += [(2000, "http://good3.net/reading/page77", "", "", ""), (2001, "http://spam4.net/win-cash-12", "", "", "")]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2000], got[2001]) == ("allow", "block")


def test_empty_and_undecided(spark):
    df = spark.createDataFrame([(1, "http://x.net/a", "", "", "")], SCHEMA)
    assert [(r.rule, r.verdict) for r in judge_urls(df).collect()] == [(None, "allow")]
    assert judge_urls(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = judge_urls(spark.createDataFrame([(1, "u", "", "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_difference_is_a_mean_of_ratios(spark):
    df = spark.range(1).select(signs(F.lit("ab")).alias("signs"), F.transform(F.sequence(F.lit(0), F.lit(64**3 - 1)), lambda i: i.cast("double")).alias("m"))
    one, two = 1, (1 * 64) + 2
    assert df.select(difference(F.col("m")).alias("d")).first().d == pytest.approx((one + two) / 2)
