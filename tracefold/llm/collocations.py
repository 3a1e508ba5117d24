"""Phrase collocations: n-grams that every Misra-Gries summary had to keep, counted exactly in a second pass.

First pass. A task hashes the n-grams of its texts to cells, and cells to hash partitions, and folds them to (cell, count)
before anything moves; cells go out as sorted gaps, which pack to little more than a byte. Each partition merges what
tasks send it into one Misra-Gries summary whose capacity exceeds the partition's mass divided by the threshold. What a
summary forgets is less than the threshold, so every n-gram that is frequent keeps its cell. A cell is a hash: others may
share it, which only means that a few n-grams too many are looked at again.

Second pass. Kept cells are bits of one filter, which grows with them to ``FILTER_BITS`` (32 MB) at most. A task counts the
n-grams whose cells, and the cells of all n-grams inside them, are kept - by their words, not by hashes - and Spark adds
up the counts by language and phrase. More kept cells than the filter can tell apart let more n-grams through to that
sum; the result is the same.

Scores need the counts of both parts of a phrase at every cut. Parts are at least as frequent as the phrase, so they are
rows of the same table of counts, and the cuts are two joins.

Defined cases: null language is ``und``; null or empty texts have no words; a text of any length is read in windows that
overlap by four words; rows that repeat count again, whatever their ids; empty tables give no rows; other columns do not
matter, whatever they are called.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import slices, staged

#: Piece ends and blanks of the word rule.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"

LONGEST = 5
WINDOW = 1 << 20  # bytes of text that are words at once
ENTRIES = 1_500_000  # (cell, count) pairs a task holds
CELL_BITS = 28  # a partition's cells; its mass is about PART_MASS
PART_MASS = 1 << 25
MERGERS = 4096  # tasks that merge, at most; each takes its partitions one after another
FILTER_BITS = 28  # at most; about SPREAD for each kept cell
SPREAD = 64
SLACK = 2  # capacity over mass / threshold
_ROWS = 50_000

_END = b"\xff"  # never a byte of UTF-8
_TABLE = bytes(
    0xFF if b in PIECE_ENDS else 0x20 if b in BLANKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SUMMARY = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("mass", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


# ------------------------------------------------------------------------------------------------ words of a text


def prepared(texts: list[bytes]) -> bytes:
    """Texts in lower case (A-Z), each piece's end as a word of its own."""
    return _END.join([*texts, b""]).translate(_TABLE).replace(_END, b" \xff ")


def windows(data: bytes, longest: int, window: int) -> Iterator[tuple[list[bytes], int]]:
    """Words and piece ends of prepared text by windows, and how many of them repeat the window before."""
    carried: list[bytes] = []
    at = 0
    while at < len(data):
        end = at + window
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut + 1 if cut >= 0 else (data.find(b" ", end) + 1 or len(data))
        tokens = carried + data[at:end].split()
        yield tokens, len(carried)
        carried = tokens[max(0, len(tokens) - longest + 1) :]
        at = end


class Grams:
    """The n-grams of one window: 64-bit hashes and which places start one, by length."""

    def __init__(self, tokens: list[bytes], repeated: int, lang: str, longest: int) -> None:
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.tokens, self.repeated, self.longest, self.size = tokens, repeated, longest, len(vocabulary)
        self.ids = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))
        self.codes = hashes[self.ids] if len(tokens) else np.empty(0, np.uint64)
        self.words = self.ids != vocabulary.get(_END, -1)

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, hash by place, whether an n-gram starts there)."""
        h, starts = self.codes, self.words
        for k in range(1, min(self.longest, len(self.tokens)) + 1):
            if k > 1:
                h = h[:-1] * _MULTIPLY + self.codes[k - 1 :]
                h = (h ^ (h >> np.uint64(29))) * _MIX
                starts = starts[:-1] & self.words[k - 1 :]
            yield k, h, starts

    def new(self, k: int) -> slice:
        """Places whose n-gram of length ``k`` does not lie within repeated words."""
        return slice(max(0, self.repeated - k + 1), None)


def _by_language(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[tuple[str, bytes]]:
    """Texts of one language, about ``hold`` bytes at a time, or one text that is longer."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 64
            total += len(text) + 64
            if sizes[lang] >= hold or total >= 2 * hold:
                most = max(sizes, key=sizes.__getitem__)
                total -= sizes.pop(most)
                yield most, prepared(held.pop(most))
    for lang, texts in held.items():
        yield lang, prepared(texts)


# ------------------------------------------------------------------------------------------------ summaries


def folded(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct cells with the sums of their counts."""
    if not len(cells):
        return cells, counts
    order = np.argsort(cells, kind="stable")  # runs that are sorted merge in linear time
    cells, counts = cells[order], counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.add.reduceat(counts, first)


class MisraGries:
    """At most ``capacity`` counters; each true count lies between the counter and the counter plus ``lost``.

    Compaction takes the same amount from more than ``capacity`` counters at once, so ``lost`` never exceeds
    the mass divided by ``capacity + 1``.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.cells, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.cells, self.counts = folded(np.concatenate([self.cells, cells]), np.concatenate([self.counts, counts]))
        if len(self.cells) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            cut = int(np.partition(self.counts, at)[at])
            self.lost += cut
            kept = self.counts > cut
            self.cells, self.counts = self.cells[kept], self.counts[kept] - cut

    def possible(self, threshold: int) -> np.ndarray:
        return self.cells[self.counts + self.lost >= threshold]


def pack(values: np.ndarray) -> bytes:
    """Four planes of bytes, compressed: small numbers leave planes of zeros."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return struct.pack("<I", len(values)) + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", data)[0]
    planes = np.frombuffer(pa.decompress(data[4:], n * 4, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _summarise(batches: Iterator[pa.RecordBatch], longest: int, window: int, entries: int, bits: int) -> Iterator[pa.RecordBatch]:
    words: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    shift = np.uint64(64 - bits - CELL_BITS)

    def folding() -> tuple[np.ndarray, np.ndarray]:
        return folded(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))

    def take() -> Iterator[pa.RecordBatch]:
        cells, counts = folding()
        held.clear()
        parts = cells >> CELL_BITS
        first = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.empty(0, np.int64)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(parts)], strict=False):
            gaps = np.diff(cells[a:b] & ((1 << CELL_BITS) - 1), prepend=0)
            here = counts[a:b]
            yield pa.RecordBatch.from_pylist([{"part": int(parts[a]), "lang": None, "mass": int(here.sum()), "cells": pack(gaps), "counts": pack(here)}], schema=_SUMMARY)

    for lang, data in _by_language(batches, window):
        for tokens, repeated in windows(data, longest, window):
            grams = Grams(tokens, repeated, lang, longest)
            words[lang] = words.get(lang, 0) + int(grams.words[repeated:].sum())
            found = [(h[grams.new(k)][starts[grams.new(k)]] >> shift).astype(np.int64) for k, h, starts in grams.levels()]
            if found:
                cells = np.concatenate(found)
                held.append(folded(cells, np.ones(len(cells), np.int32)))
        if sum(len(c) for c, _ in held) > entries:
            held[:] = [folding()]
            if len(held[0][0]) > entries * 2 // 3:
                yield from take()
    if held:
        yield from take()
    for lang, n in words.items():
        yield pa.RecordBatch.from_pylist([{"part": -1, "lang": lang, "mass": n, "cells": None, "counts": None}], schema=_SUMMARY)


def _merge(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Partitions in order; each gives the cells it had to keep."""
    part, summary = None, None

    def take() -> pa.RecordBatch:
        cells = summary.possible(threshold)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([len(cells)], pa.int64()), pa.array([pack(np.diff(cells, prepend=0))], pa.binary())], names=["part", "kept", "cells"])

    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column("part")[i].as_py() != part:
                if summary is not None:
                    yield take()
                part = batch.column("part")[i].as_py()
                summary = MisraGries(SLACK * (batch.column("whole")[i].as_py() // threshold + 1))
            summary.add(np.cumsum(unpack(batch.column("cells")[i].as_py())), unpack(batch.column("counts")[i].as_py()).astype(np.int64))
    if summary is not None:
        yield take()


def _bits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A partition's own bits of the filter, ``2 ** width`` of them."""
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            owned = np.zeros(1 << (width - 3), np.uint8)
            at = np.cumsum(unpack(cells)) >> (CELL_BITS - width)
            np.bitwise_or.at(owned, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([owned.tobytes()], pa.binary())], names=["part", "bits"])


# ------------------------------------------------------------------------------------------------ second pass


def _count(batches: Iterator[pa.RecordBatch], longest: int, window: int, width: int, kept: Callable[[], bytes]) -> Iterator[pa.RecordBatch]:
    table = np.frombuffer(kept(), np.uint8)
    shift = np.uint64(64 - width)
    phrases: list[bytes] = []
    langs: list[str] = []
    counts: list[np.ndarray] = []

    def take() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.concatenate(counts), pa.int64())], schema=_COUNTED)
        phrases.clear(), langs.clear(), counts.clear()
        return out

    for lang, data in _by_language(batches, window):
        for tokens, repeated in windows(data, longest, window):
            grams = Grams(tokens, repeated, lang, longest)
            open_, dense = None, grams.ids
            for k, h, starts in grams.levels():
                at = (h >> shift).astype(np.int64)
                open_ = starts & (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & (True if k == 1 else open_[:-1] & open_[1:])
                places = np.flatnonzero(open_)
                if not len(places):
                    break
                # Equal numbers mean equal words: the number of the first k - 1 words, then the last word's.
                keys = dense[places] if k == 1 else dense[places] * grams.size + grams.ids[places + k - 1]
                _, first, number = np.unique(keys, return_index=True, return_inverse=True)
                dense = np.zeros(len(open_), np.int64)
                dense[places] = number
                count = np.bincount(number[places >= grams.new(k).start], minlength=len(first))
                seen = np.flatnonzero(count)
                for some in np.array_split(seen, -(-len(seen) // _ROWS)) if len(seen) else []:
                    phrases += [b" ".join(tokens[i : i + k]) for i in places[first[some]].tolist()]
                    langs += [lang] * len(some)
                    counts.append(count[some])
                    if len(phrases) >= _ROWS:
                        yield take()
    if phrases:
        yield take()


def frequent_ngrams(
    docs: DataFrame, threshold: int, *, longest: int = LONGEST, text: str = "text", lang: str = "lang", window: int = WINDOW, entries: int = ENTRIES, part_mass: int = PART_MASS
) -> tuple[DataFrame, DataFrame]:
    """All n-grams of 1 to ``longest`` words with at least ``threshold`` places, (lang, phrase, f), and (lang, n) words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(max(0, (max(size, 1) - 1).bit_length() - (part_mass.bit_length() - 1)), 24)
    summaries = staged(
        texts.mapInArrow(partial(_summarise, longest=longest, window=window, entries=entries, bits=bits), "part long, lang string, mass long, cells binary, counts binary"),
        "collocation-summaries",
    )
    words = summaries.where("part < 0").groupBy("lang").agg(F.sum("mass").alias("n"))
    counters = summaries.where("part >= 0")
    whole = counters.groupBy("part").agg(F.sum("mass").alias("whole"))
    # Direct partition ids: a hash repartition by the join's own key would be taken out of the plan, and the join's
    # rows may be split or left where they are.
    mergers = min(1 << bits, MERGERS)
    merged = staged(
        counters.join(whole, "part").select("part", "whole", "cells", "counts")
        .repartitionById(mergers, (F.col("part") % mergers).cast("int")).sortWithinPartitions("part")
        .mapInArrow(partial(_merge, threshold=threshold), "part long, kept long, cells binary"),
        "collocation-kept",
    )
    kept = merged.agg(F.sum("kept")).first()[0] or 0
    width = min(max((SPREAD * kept).bit_length() - bits, 3), max(FILTER_BITS - bits, 3))
    table = spark.sparkContext.broadcast(_filter(merged.mapInArrow(partial(_bits, width=width), "part long, bits binary"), bits, width))
    counted = texts.mapInArrow(partial(_count, longest=longest, window=window, width=bits + width, kept=lambda: table.value), "lang string, phrase string, f long")
    frequent = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)
    return staged(frequent, "collocation-counts"), words


def _filter(owned: DataFrame, bits: int, width: int) -> bytes:
    """The bits of all partitions in order: at most ``2 ** FILTER_BITS``, in at most 256 rows."""
    each = (1 << width) // 8
    rows = owned.groupBy(F.shiftright("part", max(bits - 8, 0)).alias("run")).agg(F.collect_list(F.struct("part", "bits")).alias("parts")).toLocalIterator()
    out = bytearray(each << bits)
    for row in rows:
        for part, data in row.parts:
            out[part * each : (part + 1) * each] = data
    return bytes(out)


def collocations(docs: DataFrame, threshold: int = 100, most: int = 2000, **options) -> DataFrame:
    """Each language's ``most`` highest-scoring phrases: (lang, rank, phrase, a, l, r, n, score).

    A phrase goes where a longer frequent one that holds it has as many places. It is enough to look at phrases one word
    longer: whatever lies between two phrases with equal counts has that count as well.
    """
    counts, words = frequent_ngrams(docs, threshold, **options)
    counts = counts.withColumn("w", F.split("phrase", " "))
    phrases = counts.where(F.size("w") >= 2)
    longer = phrases.where(F.size("w") >= 3).select(
        "lang", F.explode(F.array(*[F.array_join(F.slice("w", s, F.size("w") - 1), " ") for s in (1, 2)])).alias("phrase"), F.col("f").alias("over")
    ).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.col("over") < F.col("f")))

    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.expr("slice(w, 1, k)"), " ")).withColumn("rest", F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ")).drop("w")
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(words, "lang").withColumn(
        # 38 digits hold the products of any counts that fit in 18 digits.
        "score", F.expr("(cast(a as decimal(18,0)) * cast(1000 * n as decimal(19,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"),
    )
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
