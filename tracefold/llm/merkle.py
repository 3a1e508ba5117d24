"""Merkle manifest of a dataset, with a persistent tree for changed leaves.

Every row becomes a leaf; each group's leaves, in order, fold by runs of ``ARITY`` to a subroot, and the subroots, in order
of their group, to the root. Nodes are worked in aligned blocks of ``ARITY ** BLOCK_LEVELS`` consecutive positions, so a
group that holds a third of all rows is many tasks, and 5 * 10^10 leaves are three rounds.

* Up: each round turns blocks into their roots, which are the next round's nodes.
* Down: each round hands a block the siblings above it, so leaves learn their whole path to the root.
* Versions: the leaves' blocks are persistent trees. A changed leaf makes a version by copying its ancestors inside the
  block and sharing every other node; the version goes on through the levels above along the siblings its block was
  handed, in the same task. Versions never meet, however many a group has.

Texts are hashed where they are read. What moves is a digest and a position on the way up, and the leaf with its id on the
way down.

Defined cases: a null field is ``-``; null groups come first; null ids come before all others and count as unchanged;
rows with equal ids are ordered by leaf, and equal rows are leaves of their own; an empty table has no rows; columns that
are not named do not matter, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import staged

ARITY = 3
BLOCK_LEVELS = 8
BLOCK = ARITY**BLOCK_LEVELS
_FLUSH = 20_000
_NODE = "g string, pos long, n long, d binary"
Node = tuple[bytes, tuple]  # digest as hex text, children


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# ------------------------------------------------------------------------------------------------ trees in a task


def grow_block(leaves: list[bytes], whole: bool, levels: int = BLOCK_LEVELS) -> Node:
    """The root of an aligned block: a block that is part of a longer row of nodes always climbs ``levels``."""
    level: list[Node] = [(d, ()) for d in leaves]
    height = 0
    while (len(level) > 1) if whole else (height < levels):
        level = [(digest(b"".join([d for d, _ in run])), run) for run in _runs_of(level)]
        height += 1
    return level[0]


def _runs_of(level: list[Node]) -> list[tuple[Node, ...]]:
    return [tuple(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]


def changed_version(root: Node, height: int, place: int, leaf: bytes) -> tuple[Node, list[bytes]]:
    """A version of the tree with another leaf at ``place``, and the digests it had to make, from the leaf upwards.

    Only ancestors are copied; all other nodes are those of the tree it came from.
    """
    way = []
    node = root
    for level in reversed(range(height)):
        child = place // ARITY**level % ARITY
        way.append((node, child))
        node = node[1][child]
    new: Node = (leaf, ())
    made = [leaf]
    for node, child in reversed(way):
        kids = (*node[1][:child], new, *node[1][child + 1 :])
        new = (digest(b"".join([d for d, _ in kids])), kids)
        made.append(new[0])
    return new, made


def height_of(root: Node) -> int:
    height = 0
    while root[1]:
        root, height = root[1][0], height + 1
    return height


def sibling_paths(root: Node, above: list[bytes]) -> Iterator[list[bytes]]:
    """For every leaf in order: its siblings left and right at each level, upwards, then those above the tree."""
    stack = [(root, above)]
    while stack:
        node, path = stack.pop()
        kids = node[1]
        if not kids:
            yield path
            continue
        for i in reversed(range(len(kids))):
            around = [b"".join([d for d, _ in kids[:i]]), b"".join([d for d, _ in kids[i + 1 :]])]
            stack.append((kids[i], around + path))


def fold_up(acc: bytes, path: list[bytes]) -> list[bytes]:
    """Digests of the ancestors of ``acc`` along its siblings."""
    made = []
    for i in range(0, len(path), 2):
        acc = digest(path[i] + acc + path[i + 1])
        made.append(acc)
    return made


# ------------------------------------------------------------------------------------------------ blocks of rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of one (group, block), whatever batches they come in."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        g, block = batch.column("g"), batch.column("block").to_numpy(zero_copy_only=False)
        cut = block[1:] != block[:-1]
        if n > 1:
            cut = cut | pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        for a, b in pairwise([0, *(np.flatnonzero(cut) + 1).tolist(), n]):
            here = (g[a].as_py(), block[a])
            if held and here != key:
                yield pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _hexes(column: pa.ChunkedArray) -> list[bytes | None]:
    return [None if d is None else d.hex().encode() for d in column.to_pylist()]


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    schema = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("d", pa.binary())])

    def take() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for block in _blocks(batches):
        n, levels = block["n"][0].as_py(), block["levels"][0].as_py()
        size = ARITY**levels
        root = grow_block(_hexes(block["d"]), n <= size, levels)[0]
        rows.append((block["g"][0].as_py(), block["block"][0].as_py(), -(-n // size), bytes.fromhex(root.decode())))
        if len(rows) >= _FLUSH:
            yield take()
    if rows:
        yield take()


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's first row carries what lies above it; the others are its nodes, which get their paths, and the roots of
    their versions."""
    held: dict[str, list] = {k: [] for k in ("g", "pos", "id", "d", "path", "subroot", "root", "made", "proof")}

    def take() -> pa.RecordBatch:
        arrays = [
            pa.array(held["g"], pa.string()), pa.array(held["pos"], pa.int64()), pa.chunked_array(held["id"]).combine_chunks(), pa.array(held["d"], pa.string()),
            pa.array(held["path"], pa.list_(pa.string())), pa.array(held["subroot"], pa.string()), pa.array(held["root"], pa.string()),
            pa.array(held["made"], pa.list_(pa.string())), pa.array(held["proof"], pa.string()),
        ]
        for values in held.values():
            values.clear()
        return pa.RecordBatch.from_arrays(arrays, names=list(held))

    for block in _blocks(batches):
        head, nodes = block.slice(0, 1).to_pylist()[0], block.slice(1)
        above = [s.encode() for s in head["path"]]
        leaves, changed = _hexes(nodes["d"]), _hexes(nodes["changed"])
        size = ARITY ** head["levels"]
        root = grow_block(leaves, nodes["n"][0].as_py() <= size, head["levels"])
        height = height_of(root)
        first = head["block"] * size
        held["id"] += nodes["id"].chunks
        for place, path in enumerate(sibling_paths(root, above)):
            if changed[place] is None:
                made = [leaves[place], *fold_up(leaves[place], path)]
            else:
                version, made = changed_version(root, height, place, changed[place])
                made = made + fold_up(version[0], above)
            held["path"].append([s.decode() for s in path])
            held["made"].append([s.decode() for s in made])
            held["proof"].append(sha256(b"".join(path)).hexdigest())
            held["d"].append(leaves[place].decode())
            held["pos"].append(first + place)
        held["g"] += [head["g"]] * len(leaves)
        held["subroot"] += [head["subroot"]] * len(leaves)
        held["root"] += [head["root"]] * len(leaves)
        if len(held["g"]) >= _FLUSH:
            yield take()
    if held["g"]:
        yield take()


# ------------------------------------------------------------------------------------------------ rounds


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their position in their group, ``pos``, and the group's size, ``n``.

    One range sort over all groups; positions follow from one summary row for each (task, group).
    """
    ordered = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "merkle-ordered")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ordered.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    heads = heads.select("g", "part", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(Window.partitionBy("g")).alias("n"))
    return ordered.join(heads, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows by block; each tells the height of blocks, as a task's worker may have been started under another one."""
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos").withColumn("levels", F.lit(BLOCK_LEVELS))


def _block_of(pos: str = "pos") -> Column:
    return F.expr(f"{pos} div {BLOCK}")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every round, the last one holding a single node for each group."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    out = [nodes]
    while len(out) == 1 or most > 1:
        rows = _in_blocks(out[-1].select("g", _block_of().alias("block"), "pos", "n", "d"))
        out.append(staged(rows.mapInArrow(_climb, _NODE), "merkle-nodes"))
        most = -(-most // BLOCK)
    return out


def _down(nodes: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """Nodes (with ``id`` and ``changed``) meet what lies above their block: (g, pos, path, subroot, root)."""
    columns = ["g", "block", "pos", "n", "d", "id", "changed", "path", "subroot", "root"]
    none = {"path": "array<string>", "subroot": "string", "root": "string"}
    below = nodes.withColumn("block", _block_of()).select(*columns[:7], *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    heads = above.select(
        "g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("d"),
        F.lit(None).cast(key).alias("id"), F.lit(None).cast("binary").alias("changed"), "path", "subroot", "root",
    )
    schema = f"g string, pos long, id {key}, d string, path array<string>, subroot string, root string, made array<string>, proof string"
    return _in_blocks(below.unionByName(heads)).mapInArrow(_descend, schema)


def _descent(rounds: list[DataFrame], above: DataFrame, key: str) -> DataFrame:
    """From what lies above each group's single node down to the nodes of the first round."""
    for nodes in rounds[-2:0:-1]:
        bare = nodes.withColumn("id", F.lit(None).cast("string")).withColumn("changed", F.lit(None).cast("binary"))
        above = staged(_down(bare, above, "string").select("g", "pos", "path", "subroot", "root"), "merkle-paths")
    return _down(rounds[0], above, key)


def manifest(
    docs: DataFrame,
    columns: list[str],
    *,
    group: str = "source",
    order: str = "doc_id",
    replaced: dict[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """The manifest of ``docs``, a row per leaf.

    ``columns`` make the leaf. In rows where ``where`` holds, a version of the tree is made in which the columns of
    ``replaced`` have those other values. Result: ``id`` (the value of ``order``), ``d`` (leaf), ``subroot``, ``root``,
    ``path`` (siblings left and right at every level, upwards), ``proof`` (sha256 of the path's text), and ``made``:
    leaf and ancestors of the row's own version, or, where nothing was changed, those recomputed from leaf and path.
    The last one of ``made`` is the version's root.
    """
    replaced = replaced or {}
    key = docs.schema[order].dataType.simpleString()
    other = leaf_digest([replaced.get(c, F.col(c)) for c in columns])
    leaves = staged(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(order).alias("id"),
        F.unhex(leaf_digest([F.col(c) for c in columns])).alias("d"),
        (F.when(where, F.unhex(other)) if where is not None else F.lit(None).cast("binary")).alias("changed"), F.rand(11).alias("spread"),
    ), "merkle-leaves")
    placed = _placed(leaves, [F.col("g"), F.col("id").asc_nulls_first(), F.col("d"), F.col("spread")]).drop("spread")
    rounds = _rounds(placed)

    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("id"), "d", F.lit(None).cast("binary").alias("changed"))
    tops = _rounds(_placed(subroots, [F.col("id")]))
    root = tops[-1].select("g", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("d")).alias("root"))
    groups = staged(_descent(tops, root, "string").select(F.col("id").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("d").alias("subroot"), "root"), "merkle-groups")
    return _descent(rounds, groups, key).select("id", "d", "subroot", "root", "path", "proof", "made")


def verify_documents(docs: DataFrame) -> DataFrame:
    """Leaves, proofs and the roots of tampered versions of ``documents``: where 2 divides the crc32 of the id, tampering
    deletes the text's line feeds."""
    found = manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"],
        replaced={"text": F.translate("text", "\n", "")}, where=F.crc32(F.col("doc_id").cast("string")) % 2 == 0,
    )
    folded = F.element_at("made", -1)
    return found.select(
        F.col("id").alias("doc_id"), F.col("d").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
