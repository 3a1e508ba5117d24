import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import license_scan as ls
from tracefold.llm.catalog import ORACLES

SCHEMA = "doc_id long, text string, n_words string, base string, found string, id string"
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(markup):
    """The template with all optional wording, and a stand-in word for every region that is replaceable."""
    filler = lambda m: re.search(r'word="?([^"|]*)', m[1])[1].replace("[0-9]+", "3").replace("[0-9]", "4 0") if "word=" in m[1] else "someone " * int(re.search(r"least=(\d+)", m[1])[1])
    return re.sub(r"<<(?:begin|end)Optional>>", " ", re.sub(r"<<(var;.*?)>>", filler, markup))


def bare(markup):
    """The mandatory wording alone."""
    while "<<beginOptional>>" in markup:
        markup = re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>", " ", markup, flags=re.DOTALL)
    return plain(markup)


def brute(rows):
    pattern = lambda regions: "".join(
        re.escape(f" {r.decode()} ") if isinstance(r, bytes) else f"(?:{pattern(r[1])})?" if r[0] == "optional" else f"(?: (?:{r[3] or '[^ ]+'}) ){{{r[1]},{r[2]}}}" for r in regions)
    rules = {label: re.compile(pattern(ls.parse(m))) for label, m in ls.TEMPLATES.items()}
    out = []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        line = "".join(f" {w} " for w in words)
        base = [(at, label, len(p.split())) for p, label in ls.PHRASES.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        spans = {label: [len(m[0].split()) for m in rule.finditer(line)] for label, rule in rules.items()}
        w = max([0, *[b[2] for b in base], *sum(spans.values(), [])])
        names = {b[1] for b in base}
        starts = [b[0] for b in base]
        out.append((i, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | {k for k, v in spans.items() if v})), w / (w + 4)))
    return sorted(out, key=repr)


def rows():
    out = [(1, None), (2, ""), (3, "mit license MIT-License\nthe mit  license"), (4, "Released under the MIT License."), (5, "released UNDER the terms of the mit licensee"), (None, "licensed under CC BY-NC-SA 4.0 licensed under cc by 4 0")]
    out += [(10 + i, "vor " + text(m) + " nach") for i, m in enumerate(ls.TEMPLATES.values()) for text in (plain, bare)]
    out += [(40 + i, " ".join(words[:-1])) for i, m in enumerate(ls.TEMPLATES.values()) for words in [bare(m).split()]]
    out += [(60, "This work is licensed under the GNU General Public License, version 3."), (61, "This very odd work is licensed under the GNU general public license version 3"), (62, "general public general public license")]
    out += [(70, "wört " * 40_000 + plain(ls.TEMPLATES["mit-text"]) + " x" * 9000 + " Apache License apache license"), (71, "y" * 100_000 + " mit license"), (72, "licensed " * 3000)]
    out += [(4, "Released under the MIT License.")] * 50 + [(80, "the\x00mit\x7flicense é中 mit license "), (81, "licensed under the apache license version 2 0 the license you may not use this file")]
    return out


@pytest.mark.parametrize("window", [1 << 22, 700])
def test_labels_equal_brute_force(spark, window):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows()], SCHEMA).repartition(6)
    assert sorted((tuple(r) for r in ls.labelled(df, window=window).collect()), key=repr) == brute(rows())


def test_every_template_accepts_its_own_text(spark):
    for label, markup in ls.TEMPLATES.items():
        for text in (plain(markup), bare(markup)):
            words = ls.words_of(text.encode())
            assert ls.Automaton(markup).accepts(words, 0) == len(words), label
            for i in range(len(words)):  # another word in a mandatory place is refused
                other = [*words[:i], b"qqq", *words[i + 1 :]]
                assert ls.Automaton(markup).accepts(other, 0) <= len(words)


def test_empty_table(spark):
    assert ls.labelled(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("markup", ["", "<<beginOptional>>a<<endOptional>>", "a <<beginOptional>>b", "a<<endOptional>>", '<<var;most=2>>', 'a <<var;least=3;most=2>>', "a <<other>>"])
def test_bad_templates_are_refused(markup):
    with pytest.raises(ValueError):
        ls.Automaton(markup)


TREES = st.recursive(
    st.sampled_from([b"a", b"b", ("var", 0, 2, None), ("var", 1, 1, "[ab]")]).map(lambda r: [r]),
    lambda inner: st.one_of(st.lists(inner, min_size=1, max_size=4).map(lambda xs: sum(xs, [])), inner.map(lambda x: [("optional", x)])), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(TREES, st.lists(st.sampled_from("abc"), max_size=9))
def test_automata_accept_what_patterns_accept(regions, words):
    def markup(rs):
        return " ".join(r.decode() if isinstance(r, bytes) else f"<<beginOptional>>{markup(r[1])}<<endOptional>>" if r[0] == "optional" else f'<<var;least={r[1]};most={r[2]}' + (f';word="{r[3]}"' if r[3] else "") + ">>" for r in rs)

    def pattern(rs):
        return "".join(r.decode() if isinstance(r, bytes) else f"(?:{pattern(r[1])})?" if r[0] == "optional" else f"{r[3] or '.'}{{{r[1]},{r[2]}}}" for r in rs)

    whole = [b"a", *regions]
    assert ls.parse(markup(whole)) == whole
    rule, text = re.compile(pattern(whole)), "".join(words)
    longest = max((n for n in range(1, len(text) + 1) if rule.fullmatch(text[:n])), default=0)
    assert ls.Automaton(markup(whole)).accepts([w.encode() for w in words], 0) == longest


def test_sql_twin_agrees_with_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    given_ = [r for r in rows() if r[0] != 80]  # DuckDB's patterns stop at a zero byte
    con.executemany("INSERT INTO documents VALUES (?, ?)", given_)
    cur = con.execute(ORACLES["op13_license_scan"])
    assert [d[0] for d in cur.description] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(cur.fetchall(), key=repr) == brute(given_)
