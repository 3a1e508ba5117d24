"""Byte-level BPE of whole texts by overlapping chunks, and its inverse.

A long text is cut into chunks of equal length that overlap. Tasks find the pre-tokens of their chunks in parallel, each
from its own first character, so the first few may be wrong. Pre-tokens depend only on what follows, so two
neighbours that agree on one boundary agree on all after it: the first boundary that both have in their overlap is
where one hands over to the next. Where they share none, the next chunk has no hand-over and its text joins the piece
before it. The pieces are then encoded in parallel and put together in order. A text within one chunk is one piece.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracefold.llm import bpe
from tracefold.llm.common import slices

CHUNK = 32_768  # characters
OVERLAP = 2_048
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def boundaries(text: str, pattern) -> list[int]:
    """Where pre-tokens begin that the end of ``text`` cannot have shaped; the pattern covers every character."""
    out, last = [], len(text) - 2
    for match in pattern.finditer(text):
        if match.start() > last:
            break
        out.append(match.start())
    return out


def _split(chunk: int, overlap: int):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("text", pa.string()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = (TaskContext.get().partitionId() << 33) - 1
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                uid += 1
                count = max(1, -(-len(text) // chunk))
                rows += [(uid, doc_id, k, text[k * chunk : (k + 1) * chunk + overlap], k + 1 == count) for k in range(count)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _pre_tokenise(path: str, pattern: str, chunk: int, overlap: int):
    schema = pa.schema([
        ("uid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("text", pa.string()), ("last", pa.bool_()),
        ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = bpe.decoder(path, pattern).pattern
        for batch in slices(batches, "text"):
            heads, tails = [], []
            for k, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = boundaries(text, rule)
                heads.append([k * chunk + p for p in found if p < overlap])
                tails.append([k * chunk + p for p in found if p >= chunk])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, schema[5].type), pa.array(tails, schema[6].type)], schema=schema)

    return run


def _encode_pieces(path: str, pattern: str, chunk: int):
    """Rows in order of (uid, begin, k) to pieces; a piece that several chunks share is put together as it passes."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, texts = None, 0, []
        ready: list[tuple] = []

        def close() -> None:
            if place is not None:
                uid, doc_id, begin, end = place
                # Each chunk's own characters, and the last one's overlap.
                text = "".join([*(t[:chunk] for t in texts[:-1]), texts[-1]])
                shift = first * chunk
                ready.append((uid, doc_id, begin, text[begin - shift : None if end is None else end - shift]))

        def encoded() -> pa.RecordBatch:
            ids = bpe.encoder(path, pattern).encode([r[3] for r in ready])
            columns = [list(c) for c in zip(*ready, strict=True)][:3] + [ids]
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in slices(batches, "text", 4 << 20):
            for uid, doc_id, k, text, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place is None or (uid, begin) != (place[0], place[2]):
                    close()
                    place, first, texts = (uid, doc_id, begin, end), k, []
                texts.append(text)
            if ready:
                yield encoded()
        close()
        if ready:
            yield encoded()

    return run


def _join(finish):
    """Pieces in order of (uid, begin) to whole documents, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, parts = None, []
        for batch in slices(batches, "ids"):
            done = []
            for uid, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if owner is not None and uid != owner[0]:
                    done.append((owner[1], b"".join(parts)))
                    parts = []
                owner = (uid, doc_id)
                parts.append(ids)
            if done:
                yield finish(*zip(*done, strict=True))
        if owner is not None:
            yield finish([owner[1]], [b"".join(parts)])

    return run


def _as_ids():
    def finish(doc_ids, ids) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())], schema=_ENCODED)

    return finish


def _as_digest(path: str, pattern: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def finish(doc_ids, ids) -> pa.RecordBatch:
        vocabulary = bpe.decoder(path, pattern)
        columns = (
            doc_ids, [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids],
            [hashlib.sha256(vocabulary.decode(i)).hexdigest() for i in ids],
        )
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return finish


def _encode_whole(path: str, pattern: str, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            yield finish(batch.column(0).to_pylist(), bpe.encoder(path, pattern).encode([t or "" for t in batch.column(1).to_pylist()]))

    return run


def _encoded(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int, finish, schema: str) -> DataFrame:
    """``finish`` of every document's ids, in the task that has them whole."""
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be shorter than chunk")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Bytes bound characters from above, and cost nothing to count.
    within = F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk
    short = slim.where(within).mapInArrow(_encode_whole(path, pattern, finish), schema)
    chunks = slim.where(~within).mapInArrow(_split(chunk, overlap), "uid long, doc_id long, k long, text string, last boolean")
    marked = chunks.repartition("uid", "k").mapInArrow(
        _pre_tokenise(path, pattern, chunk, overlap), "uid long, doc_id long, k long, text string, last boolean, head array<long>, tail array<long>"
    )
    order = Window.partitionBy("uid").orderBy("k")
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    placed = marked.withColumn("meet", F.when(F.col("k") == 0, F.lit(0)).otherwise(meet)).drop("head", "tail")
    upto, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    placed = placed.withColumn("begin", F.last("meet", ignorenulls=True).over(upto))
    placed = placed.withColumn("end", F.first("meet", ignorenulls=True).over(ahead)).select("uid", "doc_id", "k", "text", "begin", "end")
    pieces = placed.repartition("uid", "begin").sortWithinPartitions("uid", "begin", "k").mapInArrow(
        _encode_pieces(path, pattern, chunk), "uid long, doc_id long, begin long, ids binary"
    )
    whole = pieces.repartition("uid").sortWithinPartitions("uid", "begin").select("uid", "doc_id", "ids")
    return short.unionByName(whole.mapInArrow(_join(finish), schema))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ``ids``, little-endian unsigned 32-bit integers as bytes, of every row of (doc_id, text).

    ``path`` names a rank file or tokenizers JSON file that every machine has. A null or empty text has no ids; rows
    with null or repeated doc_id are encoded each; no row gives no row. Other columns are not read.
    """
    return _encoded(docs, path, pattern, chunk, overlap, _as_ids(), "doc_id long, ids binary")


def _decode(path: str, pattern: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.decoder(path, pattern)
        for batch in slices(batches, "ids"):
            data = [vocabulary.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], schema=schema)

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) with ``data``, the raw bytes that the ids stand for; no ids are no bytes."""
    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(_decode(path, pattern), "doc_id long, ids binary, data binary")


def round_trip_digest(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded as ``encode`` does, then decoded."""
    return _encoded(
        docs, path, pattern, chunk, overlap, _as_digest(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
