import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from tracefold.llm import merkle
from tracefold.llm.catalog import ORACLES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g string, pos string"


def h(text):
    return sha256(text.encode()).hexdigest()


def climb(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return out


def brute(rows):
    def leaf(*values):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for i, source, lang, n, text in rows:
        changed = leaf(i, source, lang, n, None if text is None else text.replace("\n", "")) if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else None
        groups.setdefault(source, []).append((i is not None, i or 0, leaf(i, source, lang, n, text), i, changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for place, r in enumerate(sorted(groups[s], key=lambda r: r[:3])):
            path = siblings(trees[s], place) + siblings(top, at)
            acc = r[4] or r[2]
            for left, right in path:
                acc = h(left + acc + right)
            out.append((r[3], r[2], trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in path)), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def rows():
    out = [(i, f"s{i % 3}", "en", i, f"text\n{i}") for i in range(200)]
    out += [(1000 + i, "hot", None, None, "line\n" * i) for i in range(300)]
    out += [(2000 + i, None, "fr", 1, "a\r\nb") for i in range(40)]
    out += [(3000, "alone", "de", 3, None), (3001, "ü", "de", 3, ""), (3002, "z", "de", 3, "x" * 200_000 + "\n"), (None, "s1", "en", 1, "n\n"), (None, None, None, None, None)]
    out += [(7, "s1", "en", 7, "another\n")] + [(7, "s1", "en", 7, "text\n7")] * 30 + [(3003, "", "en", 0, "\n\n")]
    return out


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_blocks_of_any_height_give_the_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows()], SCHEMA).repartition(5)
    climb_, down = merkle._climb, merkle._descend

    def patched(fn):  # workers import the module anew
        def run(batches):
            from tracefold.llm import merkle as there

            there.BLOCK_LEVELS, there.BLOCK = levels, 3**levels
            yield from fn(batches)

        return run

    monkeypatch.setattr(merkle, "_climb", patched(climb_))
    monkeypatch.setattr(merkle, "_descend", patched(down))
    assert sorted((tuple(r) for r in merkle.verify_documents(df).collect()), key=repr) == brute(rows())


def test_small_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.verify_documents(none).count() == 0
    for some in ([(2, "a", None, None, "x\n")], [(1, "a", None, None, "x"), (2, "b", None, None, "x\n")]):
        df = spark.createDataFrame([(*r, "x", "y", "z") for r in some], SCHEMA)
        assert sorted((tuple(r) for r in merkle.verify_documents(df).collect()), key=repr) == brute(some)


def test_versions_share_every_untouched_node():
    root = merkle.grow_block([h(str(i)).encode() for i in range(25)], True)
    height = merkle.height_of(root)

    def nodes(node):
        yield id(node)
        for child in node[1]:
            yield from nodes(child)

    before = set(nodes(root))
    for place in (0, 13, 24):
        version, made = merkle.changed_version(root, height, place, b"other")
        new = set(nodes(version)) - before
        assert len(new) == height + 1 == len(made) and version[0] == made[-1] != root[0]
        assert set(nodes(root)) == before


def test_paths_rebuild_the_root_from_any_leaf(spark):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows()], SCHEMA)
    found = merkle.manifest(df, ["doc_id", "text"], replaced={"text": F.lit("gone")}, where=F.col("doc_id") == 5).collect()
    for r in found:
        acc = (r.made[0] if r.id == 5 else r.d).encode()
        assert [acc.decode(), *[m.decode() for m in merkle.fold_up(acc, [s.encode() for s in r.path])]] == r.made
        assert (r.made[-1] == r.root) == (r.id != 5)


def test_sql_twin_agrees_with_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows())
    cur = con.execute(ORACLES["op11_merkle_manifest"])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
    assert sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr) == brute(rows())
