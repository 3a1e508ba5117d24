"""Exact duplicates by Patricia-trie owners.

Every row's text, without white space, becomes UTF-8 bytes. Map tasks fold equal texts first, so a text held by
a third of all rows sends a row a task and not a row a document. The folded texts go to partitions by length and
content hash; each partition inserts the full byte strings into one compressed radix trie whose terminal nodes hold
the owner. Rows arrive in order of (length, hash), which begin every key, so a subtree is complete once the order
has moved past it: when the trie outgrows its memory, complete subtrees are spilled as finished rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import slices, staged

WHITE = bytes([0x20, *range(0x09, 0x0E)])
OWNER_SCHEMA = "sha string, keep_id long, group_size long"
_MEMBERS = pa.schema([("doc_id", pa.int64()), ("sha", pa.string())])
_FOLDED = pa.schema([
    ("length", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("points", pa.int64()), ("id", pa.int64()), ("n", pa.int64()),
])
_OWNERS = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, id) pairs the longer text, then the smaller id; a null id comes last."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return min(a, b, key=rank)


class PatriciaTrie:
    """Compressed radix trie of byte strings; a terminal node holds [code points, id, count]."""

    __slots__ = ("root", "size")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # label, children by first byte, owner
        self.size = 0

    def insert(self, key: bytes, points: int, doc_id: int | None, count: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                break
            child = node[1].get(key[at])
            if child is None:
                fresh = [key[at:], {}, None]
                node[1][key[at]] = fresh
                self.size += len(key) - at + 200
                node, at = fresh, len(key)
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same, most = 0, min(len(label), len(key) - at)
            low, high = 0, most  # the first difference, by halving
            while low < high:
                mid = (low + high + 1) // 2
                if label[:mid] == key[at : at + mid]:
                    low = mid
                else:
                    high = mid - 1
            same = low
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = upper
            self.size += 200
            node, at = upper, at + same
        old = node[2]
        if old is None:
            node[2] = [points, doc_id, count]
        else:
            best = _better((old[0], old[1]), (points, doc_id))
            node[2] = [*best, old[2] + count]

    @staticmethod
    def terminals(node: list, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, prefix)]
        while stack:
            here, path = stack.pop()
            path += here[0]
            if here[2] is not None:
                yield path, here[2]
            stack.extend((child, path) for child in here[1].values())

    def spill(self, bound: bytes | None) -> Iterator[tuple[bytes, list]]:
        """Give up every subtree whose keys all precede ``bound`` (all, if None)."""
        node, path = self.root, b""
        if node[2] is not None and bound != b"":
            yield b"", node[2]
            node[2] = None
        while True:
            follow = None
            for first in sorted(node[1]):
                child = node[1][first]
                label = path + child[0]
                head = label[: len(bound)] if bound is not None else label
                if bound is not None and head == bound[: len(head)]:
                    follow = child if len(label) < len(bound) else None
                    continue
                if bound is None or head < bound[: len(head)]:
                    yield from self.terminals(node[1].pop(first), path)
            if follow is None:
                break
            node, path = follow, path + follow[0]
        self.size = sum(len(k) for k, _ in self.terminals(self.root, b""))


def _bodies(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes, bytes]]:
    """(doc_id, original bytes, bytes without white space)."""
    texts = batch.column(1).cast(pa.binary())
    for doc_id, text in zip(batch.column(0).to_pylist(), texts.to_pylist(), strict=True):
        text = text or b""
        yield doc_id, text, text.translate(None, WHITE)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [(i, hashlib.sha256(body).hexdigest()) for i, _, body in _bodies(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEMBERS, strict=True)], schema=_MEMBERS)


def _fold(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(len(body), struct.unpack(">q", hashlib.blake2b(body, digest_size=8).digest())[0], body, *own) for body, own in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOLDED, strict=True)], schema=_FOLDED)

        for batch in slices(batches, "text"):
            points = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for (doc_id, _, body), length in zip(_bodies(batch), points, strict=True):
                own = held.get(body)
                if own is None:
                    held[body] = [length, doc_id, 1]
                    size += len(body) + 200
                else:
                    best = _better((own[0], own[1]), (length, doc_id))
                    own[0], own[1], own[2] = *best, own[2] + 1
            if size > memory:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return run


def _own(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()

        def rows(found: Iterator[tuple[bytes, list]]) -> pa.RecordBatch:
            done = [(hashlib.sha256(key[16:]).hexdigest(), own[1], own[2]) for key, own in found]
            columns = list(zip(*done, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OWNERS, strict=True)], schema=_OWNERS)

        for batch in slices(batches, "body"):
            last = b""
            for length, code, body, points, doc_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = struct.pack(">QQ", length, code + (1 << 63))
                trie.insert(last + body, points, doc_id, n)
            if trie.size > memory:
                yield rows(trie.spill(last))
        yield rows(trie.spill(None))

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 8 << 20) -> DataFrame:
    """One row per distinct normalised text: (sha, keep_id, group_size)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folded = slim.mapInArrow(_fold(memory), "length long, hash long, body binary, points long, id long, n long")
    placed = folded.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return placed.mapInArrow(_own(memory), OWNER_SCHEMA)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 8 << 20) -> DataFrame:
    """Every row with its owner: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty. The row with
    most code points in its original text stays, then the smallest id; a null id stays only where no other is as
    long. Rows repeated with one id are each a row of the group, and all rows of the staying id count as kept.
    Empty tables give empty results; other columns are not read. ``memory`` bounds what a task holds at once.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = slim.mapInArrow(_members, "doc_id long, sha string")
    joined = members.join(owners(docs, id_col, text_col, memory), "sha")
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat the staying id and text, one."""
    named = F.sha2(F.encode(F.translate(F.coalesce(F.col(text_col), F.lit("")), WHITE.decode(), ""), "UTF-8"), 256)
    # Written first: texts sent to the owners are given up before texts move again to be joined.
    best = staged(owners(docs, id_col, text_col), "owners").select(F.col("sha").alias("_sha"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_n"))
    rows = docs.withColumn("_hash", named).join(best, (F.col("_hash") == F.col("_sha")) & F.col(id_col).eqNullSafe(F.col("_keep")))
    alone = rows.where("_n = 1").select(*docs.columns)
    again = rows.where("_n > 1").dropDuplicates(["_hash"]).select(*docs.columns)
    return alone.unionByName(again)
