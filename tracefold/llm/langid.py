"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is its letters' vectors, each rotated by its place and
bound together by multiplication; a text is the sum of its n-grams, and so is a language over its training texts.
A text's language is the one with the largest cosine. Sums are whole numbers, so no order of tasks changes them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import slices

DIMENSIONS = 512
GRAM = 3
SAMPLE = 4000  # training texts a language, expected
BLOCK = 8192  # n-grams whose vectors are held at once
UNDETERMINED = "und"
#: A text with so many n-grams is rejected below this cosine: letters in no order of any learned language stay near 0.
#: With fewer n-grams a low cosine says little, so such a text stays.
LEAST_SCORE = 0.1
EVIDENCE = 64


@functools.cache
def _letter_table() -> np.ndarray:
    """Code point to itself if it is a letter, else 0."""
    return np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), np.uint32, 0x110000)


@functools.cache
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """+1 and -1 from the code point alone; 0 stands for a word's edge."""
    seed = int.from_bytes(hashlib.sha256(f"letter {code}".encode()).digest()[:8], "little")
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts' lower-cased letters, and whose they are.

    A 0 stands for each run of anything else, and for both ends of a text.
    """
    lowered = ["\0" + t.lower() + "\0" for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    codes = _letter_table()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != 0
    keep[1:] |= (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    keep[:1] = True
    return codes[keep], owner[keep]


def gram_vectors(grams: np.ndarray, alphabet: np.ndarray, dimensions: int) -> np.ndarray:
    """float32 vectors of n-grams, one per row; a gram is a number whose digits are places in ``alphabet``."""
    out = np.ones((len(grams), dimensions), np.int8)
    table = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    for place in range(GRAM):
        out *= np.roll(table, place, axis=1)[grams // len(alphabet) ** place % len(alphabet)]
    return out.astype(np.float32)


def bundles(texts: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector of each text, its number of n-grams)."""
    codes, owner = letters(texts)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place_of = np.zeros(0x110000, np.int64)
    place_of[alphabet] = np.arange(len(alphabet))
    digits = place_of[codes]
    gram = np.zeros(max(0, len(codes) - GRAM + 1), np.int64)
    for place in range(GRAM):
        gram = gram * len(alphabet) + digits[place : place + len(gram)]
    inside = owner[: len(gram)] == owner[GRAM - 1 :]
    gram, owner = gram[inside], owner[: len(inside)][inside]
    total = np.zeros((len(texts), dimensions), np.float64)
    counts = np.bincount(owner, minlength=len(texts))
    if not len(gram):
        return total, counts
    if len(alphabet) ** GRAM <= 1 << 22:
        flags = np.zeros(len(alphabet) ** GRAM, np.int32)
        flags[gram] = 1
        known = np.flatnonzero(flags)
        at = (np.cumsum(flags, dtype=np.int32) - 1)[gram]
    else:
        known, at = np.unique(gram, return_inverse=True)
    for low in range(0, len(known), BLOCK):
        high = min(len(known), low + BLOCK)
        vectors = gram_vectors(known[low:high], alphabet, dimensions)
        here = (at >= low) & (at < high) if len(known) > BLOCK else slice(None)
        own, column, rows = owner[here], at[here] - low, max(1, (1 << 22) // (high - low))
        for begin in range(0, len(texts), rows):
            n = min(rows, len(texts) - begin)
            few = (own >= begin) & (own < begin + n) if len(texts) > rows else slice(None)
            table = np.bincount((own[few] - begin) * (high - low) + column[few], minlength=n * (high - low))
            total[begin : begin + n] += table.reshape(n, high - low).astype(np.float32) @ vectors
    return total, counts


def _learn(dimensions: int):
    schema = pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            langs = batch.column(0).to_pylist()
            vectors, _ = bundles([t or "" for t in batch.column(1).to_pylist()], dimensions)
            for lang in set(langs):
                part = vectors[np.array([x == lang for x in langs])].sum(0)
                sums[lang] = sums[lang] + part if lang in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.astype(np.int64) for s in sums.values()], schema[1].type)], schema=schema)

    return run


def held_out(doc_id: Column) -> Column:
    """Is the document kept from training? Ids that are null are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_profiles(docs: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Language to its bundle, from (lang, text) rows with a language, about ``sample`` of each.

    The sample is bounded and by hash of the text, so it does not depend on where rows lie. What reaches the driver is a
    vector per language.
    """
    known = docs.where(F.col("lang").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return {}
    chosen = F.lit(False)
    for row in counts:
        share = int(min(1.0, sample / row["n"]) * (1 << 31))
        chosen = chosen | ((F.col("lang") == row["lang"]) & (F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < share))
    parts = known.where(chosen).mapInArrow(_learn(dimensions), "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    profiles: dict[str, np.ndarray] = {}
    for row in sums.collect():
        profiles.setdefault(row["lang"], np.zeros(dimensions))[row["at"]] = row["x"]
    return profiles


def predict(texts: list[str | None], names: list[str], profiles: np.ndarray, dimensions: int) -> tuple[list[str], list[float], np.ndarray]:
    """(language, cosine, number of n-grams) of each text, from unit profiles in the order of names."""
    vectors, counts = bundles([t or "" for t in texts], dimensions)
    langs, scores = [], []
    lengths = np.sqrt((vectors * vectors).sum(1))
    cosines = vectors @ profiles.T / np.maximum(lengths, 1e-9)[:, None] if len(names) else np.zeros((len(vectors), 0))
    for count, row in zip(counts, cosines, strict=True):
        best = int(row.argmax()) if len(row) else -1
        langs.append(names[best] if count and best >= 0 else UNDETERMINED)
        scores.append(float(min(1.0, max(0.0, row[best]))) if count and best >= 0 else 0.0)
    return langs, scores, counts


def _predict(names: list[str], profiles: np.ndarray, dimensions: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, scores, _ = predict(batch.column(2).to_pylist(), names, profiles, dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return run


def _keep(names: list[str], profiles: np.ndarray, dimensions: int, text: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            langs, scores, counts = predict(texts, names, profiles, dimensions)
            stays = [lang != UNDETERMINED and (score >= least or n < EVIDENCE) for lang, score, n in zip(langs, scores, counts, strict=True)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return run


def unit_profiles(docs: DataFrame, dimensions: int, sample: int) -> tuple[list[str], np.ndarray]:
    """Names in order, and their profiles at length 1, learned from the rows of (doc_id, text, lang) not held out."""
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))), dimensions, sample)
    names = sorted(n for n, p in profiles.items() if p.any())
    return names, np.stack([profiles[n] / np.linalg.norm(profiles[n]) for n in names]) if names else np.zeros((0, dimensions))


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, dimensions: int = DIMENSIONS, sample: int = SAMPLE) -> DataFrame:
    """Rows whose text is of some learned language, with all columns: not ``und``, and a cosine of ``least`` or more
    wherever there are ``EVIDENCE`` n-grams to tell.

    Rows do not move. Where nothing can be learned every text is ``und`` and goes.
    """
    names, table = unit_profiles(docs.select("doc_id", "text", "lang"), dimensions, sample)
    return docs.mapInArrow(_keep(names, table, dimensions, "text", least), docs.schema)


def identify(docs: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (cosine, 0 to 1) of every row of (doc_id, text, lang).

    Profiles are learned from rows that are not held out and have a language. A null text, or one without letters, is
    ``und`` with score 0, and so is every text when nothing could be learned. Of equal cosines the first language by
    name wins. Repeated rows are each predicted; lang, source and doc_id play no part in a prediction.
    """
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).withColumn("held_out", held_out(F.col("doc_id")))
    names, table = unit_profiles(slim, dimensions, sample)
    return slim.select("doc_id", "held_out", "text").mapInArrow(
        _predict(names, table, dimensions), "doc_id long, held_out boolean, lang_pred string, score double"
    )
