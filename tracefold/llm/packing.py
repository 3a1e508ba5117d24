"""Packing of token sequences by bounded-space online best fit.

Each task keeps a fixed number of open windows over its rows, whatever their number. Whole windows are cut off a long
document; what is left goes into the fullest open window that still has room for it. When none has, a further window is
opened if the bound allows; else the fullest is emitted, filled up with the head of what is being placed. The
tasks' last open windows are merged in groups of tasks, round by round, until one group is left; its last, unfilled
window is cut into lengths that are powers of two, so that nothing needs padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm import bpe
from tracefold.llm.common import slices, staged

WINDOW = 1024
OPEN_WINDOWS = 64
GROUP = 64  # tasks, or groups of them, whose leftovers meet in one task
END = bytes(4)  # id 0 ends a document
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary()),
])
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Open windows of one task. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, part: int, first_sequence: int, window: int, most: int) -> None:
        self.part, self.next_sequence, self.window, self.most = part, first_sequence, window, most
        self.open: list[tuple[int, int]] = []  # (room, sequence), ascending
        self.pieces: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _emit(self, sequence: int, held: bool = False) -> None:
        offset = 0
        for doc_id, start, tokens, ids in self.pieces.pop(sequence):
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), tokens, sequence, offset, self.part, ids if held else None))
            offset += n

    def _new(self) -> int:
        self.next_sequence += 1
        self.pieces[self.next_sequence] = []
        return self.next_sequence

    def _put(self, at: int, doc_id, start: int, tokens: int, ids: bytes) -> None:
        room, sequence = self.open.pop(at)
        self.pieces[sequence].append((doc_id, start, tokens, ids))
        room -= len(ids) // 4
        if room:
            insort(self.open, (room, sequence))
        else:
            self._emit(sequence)

    def place(self, doc_id, start: int, tokens: int, ids: bytes) -> None:
        size = self.window * 4
        while len(ids) >= size:
            sequence = self._new()
            self.pieces[sequence].append((doc_id, start, tokens, ids[:size]))
            self._emit(sequence)
            ids, start = ids[size:], start + self.window
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.open, (n, -1))
            if at < len(self.open):
                return self._put(at, doc_id, start, tokens, ids)
            if len(self.open) < self.most:
                insort(self.open, (self.window, self._new()))
                continue
            room = self.open[0][0]  # of the fullest
            self._put(0, doc_id, start, tokens, ids[: room * 4])
            ids, start = ids[room * 4 :], start + room

    def leave(self) -> None:
        """Report the open windows with their ids, for merging."""
        for _, sequence in self.open:
            self._emit(sequence, held=True)
        self.open = []

    def finish(self) -> None:
        """Fill window after window with what is open; the rest goes into powers of two."""
        rest = [p for _, s in self.open for p in self.pieces.pop(s)]
        self.open = []
        total = sum(len(p[3]) for p in rest) // 4
        lengths = [self.window] * (total // self.window)
        total %= self.window
        lengths += [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        for room in lengths:
            sequence = self._new()
            while room:
                doc_id, start, tokens, ids = rest.pop()
                taken, n = ids[: room * 4], min(room, len(ids) // 4)
                self.pieces[sequence].append((doc_id, start, tokens, taken))
                if ids[room * 4 :]:
                    rest.append((doc_id, start + n, tokens, ids[room * 4 :]))
                room -= n
            self._emit(sequence)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in _PIECES]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)


def _first_sequence(level: int, part: int) -> int:
    """Sequence numbers of a task start here; tasks of all rounds have ranges of their own."""
    return (level << 58) + (part << 34)


def _pack(path: str, pattern: str, window: int, most: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(part, _first_sequence(0, part), window, most)
        for batch in slices(batches, "text", 4 << 20):
            encoded = bpe.encoder(path, pattern, added).encode([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                packer.place(doc_id, 0, len(ids) // 4 + 1, ids + END)
            yield packer.take()
        packer.leave()
        yield packer.take()

    return run


def _merge(level: int, last: bool, window: int, most: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        packer = Packer(part, _first_sequence(level, part), window, most)
        rows = table.select(["sequence_id", "offset", "doc_id", "start", "doc_tokens", "ids"]).to_pylist()
        for row in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            packer.place(row["doc_id"], row["start"], row["doc_tokens"], row["ids"])
        if last:
            packer.finish()
        else:
            packer.leave()
        return pa.Table.from_batches([packer.take()], schema=_PIECES)

    return run


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, most: int = OPEN_WINDOWS, added: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens: columns ``RESULT``.

    Each document's ids are followed by id 0. Every id lies in one piece; a sequence is full, or its length is
    a power of two (one set of those in all). Null and empty texts are that one id; null and repeated doc_ids are
    packed like others; no rows give no pieces. Other columns are not read. With ``added`` the
    file's added tokens are matched in texts, as the tokenizers library does unless told otherwise.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = staged(slim.mapInArrow(_pack(path, pattern, window, most, added), PIECE_SCHEMA), "packed")
    done, loose = packed.where("ids is null").select(*RESULT), packed.where("ids is not null")
    parts = (loose.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level, parts = level + 1, -(-parts // GROUP)
        grouped = loose.withColumn("part", F.floor(F.col("part") / GROUP)).groupBy("part")
        merged = grouped.applyInArrow(_merge(level, parts == 1, window, most), PIECE_SCHEMA)
        if parts == 1:
            return done.unionByName(merged.select(*RESULT))
        merged = staged(merged, "packed")
        done = done.unionByName(merged.where("ids is null").select(*RESULT))
        loose = merged.where("ids is not null")
