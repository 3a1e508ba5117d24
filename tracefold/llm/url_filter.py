"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides train two Markov models, one of accepted and one of rejected URLs. Each predicts a
character from the two before it, backing off to one and to none: the probability at each order is mixed with that of
the next lower order, with the weight of the contexts' counts. A URL's score is the difference of its log
likelihoods divided by its length. The bar is calibrated on rule-decided URLs held out of training.

The models are one array of log ratios, indexed by three characters of a fixed alphabet of 64 signs, so its size
does not depend on the data; scoring is an array look-up per character.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs 1 to 63; every other character is sign 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789:/.?#&=%-_~+@!$'()*,;|^[]{}"
SIGNS = 64
#: (rule, verdict): host, then path from its slash.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
HELD_OUT = ("0", "1", "2")  # last hex digits of the SHA-1 of the training URLs that calibrate
BINS = 400  # of the calibration, over differences from -4 to 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where there is no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    pick = lambda r: F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("verdict"))
    return reduce(lambda found, r: F.when(found.isNull() & fits(r[0]), pick(r)).otherwise(found), ordered, F.lit(None).cast("struct<rule:string,verdict:string>"))


def signs(url: Column) -> Column:
    """Numbers of a URL's characters, after two zeros."""
    chars = F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "")
    known = F.filter(chars, lambda c: c != "")
    return F.concat(F.array(F.lit(0), F.lit(0)), F.transform(known, lambda c: F.instr(F.lit(ALPHABET), c)))


def train(urls: DataFrame, strength: float = 4.0) -> DataFrame:
    """One row of one array: the log ratio of the two models for each triple of signs.

    ``urls`` has ``signs`` and ``accepted``. Counts are folded before the shuffle, so a common host costs no more.
    ``strength`` is the weight that lower orders have beside a context's count.
    """
    triples = urls.where(F.size("signs") > 2).select(
        "accepted",
        F.explode(F.transform(F.sequence(F.lit(2), F.size("signs") - 1), lambda i: (F.get("signs", i - 2) * SIGNS + F.get("signs", i - 1)) * SIGNS + F.get("signs", i))).alias("code"),
    )
    side = lambda flag: F.sum(F.when(F.col("accepted") == flag, 1).otherwise(0))
    counts = triples.groupBy("code").agg(side(True).cast("double").alias("a3"), side(False).cast("double").alias("r3"))
    grid = urls.sparkSession.range(SIGNS**3).select(F.col("id").cast("int").alias("code")).join(counts, "code", "left").na.fill(0.0)
    for key, of in (("c2", F.col("code").bitwiseAND(SIGNS * SIGNS - 1)), ("c1", F.col("code").bitwiseAND(SIGNS - 1)), ("x2", F.shiftright("code", 6))):
        grid = grid.withColumn(key, of)
    pairs = grid.groupBy("c2").agg(F.sum("a3").alias("a2"), F.sum("r3").alias("r2"), F.first("c1").alias("c1"))
    pairs = pairs.withColumn("x1", F.shiftright("c2", 6))
    singles = grid.groupBy("c1").agg(F.sum("a3").alias("a1"), F.sum("r3").alias("r1"))
    heads = pairs.groupBy("x1").agg(F.sum("a2").alias("ha1"), F.sum("r2").alias("hr1"))
    ends = grid.groupBy("x2").agg(F.sum("a3").alias("ha2"), F.sum("r3").alias("hr2"))
    total = singles.agg(F.sum("a1").alias("ta"), F.sum("r1").alias("tr"))

    def mixed(count: str, context: str, lower: Column) -> Column:
        return (F.col(count) + strength * lower) / (F.col(context) + strength)

    even = F.lit(1.0 / SIGNS)
    # A total of one row joins by a constant key: SIGNS rows at most stand on the other side.
    one = singles.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k")
    one = one.select("c1", mixed("a1", "ta", even).alias("pa1"), mixed("r1", "tr", even).alias("pr1"))
    two = pairs.join(one, "c1").join(heads, "x1")
    two = two.select("c2", mixed("a2", "ha1", F.col("pa1")).alias("pa2"), mixed("r2", "hr1", F.col("pr1")).alias("pr2"))
    three = grid.join(two, "c2").join(ends, "x2")
    ratio = F.log(mixed("a3", "ha2", F.col("pa2"))) - F.log(mixed("r3", "hr2", F.col("pr2")))
    listed = three.select(F.struct("code", ratio.alias("v")).alias("e")).agg(F.sort_array(F.collect_list("e")).alias("es"))
    return listed.select(F.transform("es", lambda e: e["v"]).alias("model"))


def difference(model: Column) -> Column:
    """Length-normalised log-likelihood difference of ``signs``; 0 for an empty URL."""
    steps = F.sequence(F.lit(2), F.size("signs") - 1)
    at = lambda i: (F.get("signs", i - 2) * SIGNS + F.get("signs", i - 1)) * SIGNS + F.get("signs", i)
    total = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(model, at(i)))
    return F.when(F.size("signs") > 2, total / (F.size("signs") - 2)).otherwise(F.lit(0.0))


def calibrate(scored: DataFrame) -> DataFrame:
    """One row: the bar with the best mean of both sides' hit rates over (score, accepted)."""
    place = F.least(F.greatest(F.floor((F.col("score") + 4.0) * (BINS / 8)), F.lit(0)), F.lit(BINS - 1))
    side = lambda flag: F.sum(F.when(F.col("accepted") == flag, 1.0).otherwise(0.0))
    bins = scored.groupBy(place.cast("int").alias("bin")).agg(side(True).alias("a"), side(False).alias("r"))
    grid = scored.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").na.fill(0.0)
    listed = grid.agg(F.sort_array(F.collect_list(F.struct("bin", "a", "r"))).alias("b"))
    sums = F.struct(F.aggregate("b", F.lit(0.0), lambda s, x: s + x["a"]).alias("a"), F.aggregate("b", F.lit(0.0), lambda s, x: s + x["r"]).alias("r"))
    listed = listed.select("b", sums.alias("t"))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("r"), F.lit(-1.0).alias("best"), F.lit(0.0).alias("bar"))

    def step(s: Column, x: Column) -> Column:
        # The bar at the bin's lower edge: accepted rows from here on, rejected rows before.
        value = (F.col("t.a") - s["a"]) / F.greatest(F.col("t.a"), F.lit(1.0)) + s["r"] / F.greatest(F.col("t.r"), F.lit(1.0))
        edge = x["bin"] / F.lit(BINS / 8) - 4.0
        better = (value > s["best"] + 1e-12) | ((F.abs(value - s["best"]) <= 1e-12) & (F.abs(edge) < F.abs(s["bar"])))
        return F.struct(
            (s["a"] + x["a"]).alias("a"), (s["r"] + x["r"]).alias("r"), F.when(better, value).otherwise(s["best"]).alias("best"),
            F.when(better, edge).otherwise(s["bar"]).alias("bar"),
        )

    return listed.select(F.aggregate("b", start, step)["bar"].alias("bar"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score.

    The rules' verdict where one fits, else the models': allow from the calibrated bar up. Null URLs and those
    without ``://`` have an empty host and path; the models judge them too (an empty text scores 0). Repeated
    rows are judged each; an empty table gives an empty result; without rule-decided URLs both models are even, and
    all is allowed. Other columns are not read.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_m", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("signs", signs(F.col("url")))
    decided = rows.where(F.col("_m").isNotNull()).select("signs", (F.col("_m.verdict") == "allow").alias("accepted"), F.substr(F.sha1(F.encode("url", "UTF-8")), F.lit(40)).isin(*HELD_OUT).alias("_held"))
    model = train(decided.where("not _held").drop("_held")).select("model").scalar()
    held_out = decided.where("_held").withColumn("_model", model).select("accepted", difference(F.col("_model")).alias("score"))
    bar = calibrate(held_out).select("bar").scalar()
    judged = rows.withColumn("_model", model).withColumn("score", difference(F.col("_model"))).drop("_model")
    verdict = F.coalesce(F.col("_m.verdict"), F.when(F.col("score") >= bar, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", F.col("_m.rule").alias("rule"), verdict.alias("verdict"), F.round("score", 9).alias("score"))
