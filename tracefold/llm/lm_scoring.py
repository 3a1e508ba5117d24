"""Cross-entropy difference of a target and a background language model.

Both models are bigrams over every word of the corpus, counted over whole corpora. The models are matched: same words,
same smoothing, and background counts scaled to the target's size, so smoothing weighs the same in both.
A document's score is its mean loss per token under the target less that under the background; lower is more alike the
target.

Words and pairs are 64-bit hashes, and neither has a largest number. Pairs leave a task folded and packed by bucket; a pair
lies in the bucket of its second word, so the bucket knows that word's count, except that pairs of the frequent second
words are dealt by pair and those words' counts are broadcast. A word is the context of the next one wherever it stands, but
at a text's end; so a pair's loss also carries what its second word adds as a context, and only the last word of each text is
counted and posted once more. Documents post the pairs they hold to the buckets, which answer with sums of losses; frequent
pairs are looked up in a broadcast table instead. What is broadcast is bounded by proof: no more than ``HEAD`` words can make
up a share of 1 / ``HEAD`` of the corpus each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import drop, slices, staged

STRENGTH = 20.0  # what a word's own frequency weighs beside a context's count
HEAD = 1 << 18  # words, or pairs, of which each makes up at least this share of all are broadcast
SLICE = 1_000_000  # tokens whose pairs a task folds together
SLICE_DOCS = 100_000
BUCKET = 500_000  # tokens to a bucket of pairs
CODES_HELD = 400_000  # words whose hashes a worker remembers
START, END = np.uint64(1), np.uint64(2)  # before a text's first word; before a word that is counted as a text's last
_ROWS = "slice long, bucket long, a binary, b binary, c binary, d binary"
_PACKED = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), *((x, pa.binary()) for x in "abcd")])
_codes: dict[bytes, int] = {}


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: small ones leave planes of zeros."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return struct.pack("<I", len(values)) + pa.compress(planes, "zstd", asbytes=True)


def loosened(data: bytes, kind) -> np.ndarray:
    n, size = struct.unpack_from("<I", data)[0], np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of the word before it, tokens of each text) of texts one after another."""
    split = [tokens(t) for t in texts]
    if len(_codes) > CODES_HELD:
        _codes.clear()
    for word in set().union(*split):
        if word not in _codes:
            _codes[word] = xxhash.xxh3_64_intdigest(word)
    lengths = np.array([len(s) for s in split], np.int64)
    words = np.fromiter((c for s in split for c in map(_codes.__getitem__, s)), np.uint64, int(lengths.sum()))
    before = np.concatenate((words[:1], words[:-1]))
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
    return words, before, lengths


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mixed(before * np.uint64(0x9E3779B97F4A7C15) + words)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there) of each key."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _bucket_of(keys: np.ndarray, words: np.ndarray, head: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(np.where(_find(head, words)[1], keys, words)) % np.uint64(buckets)).astype(np.int64)


def _first_of(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _PACKED]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], schema=schema)

    for batch in slices(batches, "text"):
        held.append(coded(batch.column(0).to_pylist())[0])
        if sum(map(len, held)) > 4 * SLICE:
            yield flush()
    if held:
        yield flush()


def _last_places(lengths: np.ndarray) -> np.ndarray:
    return (np.cumsum(lengths) - 1)[lengths > 0]


def _pair_counts(head, buckets: int):
    """(text, is_target) to packed counts: each pair, and each word as a text's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            words, before, wanted = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            keys = pair_keys(before, words)
            order = np.argsort(keys, kind="stable")
            begins = _first_of(keys[order])
            if not len(begins):
                return _packed_rows([])
            every = np.diff(np.append(begins, len(keys)))
            target = np.add.reduceat(wanted[order].astype(np.int64), begins)
            first = order[begins]
            before, words = before[first], words[first]
            bucket = _bucket_of(keys[first], words, head.value, buckets)
            order = np.lexsort((words, bucket))  # equal words side by side
            cuts = _first_of(bucket[order])
            parts = [np.split(x[order], cuts[1:]) for x in (before, words, target, every)]
            return _packed_rows([(0, int(n), *(squeezed(x) for x in row)) for n, *row in zip(bucket[order][cuts], *parts, strict=True)])

        for batch in slices(batches, "text"):
            words, before, lengths = coded(batch.column(0).to_pylist())
            wanted, last = np.array(batch.column(1).to_pylist(), bool), _last_places(lengths)
            held.append((
                np.concatenate((words, words[last])), np.concatenate((before, np.full(len(last), END))), np.concatenate((np.repeat(wanted, lengths), wanted[lengths > 0])),
            ))
            if sum(len(h[0]) for h in held) > SLICE:
                yield flush()
        if held:
            yield flush()

    return run


def _pair_arrays(row: tuple) -> tuple[np.ndarray, ...]:
    return *(loosened(x, np.uint64) for x in row[:2]), *(loosened(x, np.int64) for x in row[2:])


def _add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets, in order, to one row each, by ascending word."""
    number, held = None, []

    def close() -> pa.RecordBatch:
        before, words, target, every = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((pair_keys(before, words), words))
        begins = _first_of(pair_keys(before, words)[order])
        first = order[begins]
        columns = before[first], words[first], np.add.reduceat(target[order], begins), np.add.reduceat(every[order], begins)
        return _packed_rows([(-1, number, *(squeezed(c) for c in columns))])

    for batch in batches:
        for _, bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != number:
                if held:
                    yield close()
                number, held = bucket, []
            held.append(_pair_arrays(row))
    if held:
        yield close()


def _head_totals(head):
    """Counts of the frequent words in a task's buckets, as any word and as a text's last; under no word those of all."""
    names = ("target", "every", "target_ends", "every_ends")
    schema = pa.schema([("word", pa.int64()), *((n, pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, sums = np.zeros((4, len(head.value)), np.int64), np.zeros(4, np.int64)
        for batch in batches:
            for _, _, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, words, *counts = _pair_arrays(row)
                real = before != END
                at, known = _find(head.value, words)
                for i, (n, kind) in enumerate((n, kind) for kind in (real, ~real) for n in counts):
                    np.add.at(totals[i], at[known & kind], n[known & kind])
                    sums[i] += n[kind].sum()
        found = np.flatnonzero(totals.any(axis=0))
        words = pa.array([None, *head.value[found].view(np.int64).tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([words, *(pa.array(np.append(n, t[found])) for n, t in zip(sums, totals, strict=True))], schema=schema)

    return run


def _values(model: tuple, row: tuple) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(keys, what each adds to a text's loss under both models, how often it is met) of a bucket's counts.

    A pair adds the negative logarithm of its smoothed count, and that of what the loss of the next word is divided by;
    a last word takes the latter back.
    """
    head, head_counts, head_ends, sizes, scales, kinds, strength, _ = model
    before, words, *counts = _pair_arrays(row)
    keys, real = pair_keys(before, words), before != END
    at, known = _find(head, words)
    _, local = np.unique(words, return_inverse=True)
    added = []
    for n, of_head, last_of_head, size, scale in zip(counts, head_counts, head_ends, sizes, scales, strict=True):
        single, ends = np.bincount(local, weights=n * real)[local], np.bincount(local, weights=n * ~real)[local]
        if len(head):
            single, ends = np.where(known, of_head[at], single), np.where(known, last_of_head[at], ends)
        share = (single * scale + 1.0) / (size * scale + kinds)
        context = np.log((single - ends) * scale + strength)
        added.append(np.where(real, context - np.log(n * scale + strength * share), -context))
    return keys, added, counts[1]


def _frequent(model):
    """Buckets of counts to what their frequent keys add: (keys, under the target, under the background)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, added, every = _values(model.value, row)
                keep = every >= model.value[-1]
                if keep.any():
                    rows.append((-1, bucket, keys[keep].tobytes(), *(x[keep].tobytes() for x in added), None))
            yield _packed_rows(rows)

    return run


def _post(head, hot, first: tuple[float, float], buckets: int):
    """(doc_id, text) to a row of each slice's documents (under bucket -1), with losses of their frequent pairs, and its postings.

    Documents: ids, which of them are null, tokens, sums under both models, in which ``first`` stands for the context of a
    text's first word. Postings: keys, documents of each key, the documents' places in the slice, how often the key is in
    them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            words, before, lengths = (np.concatenate(c) for c in zip(*held, strict=True))
            name, number = (part << 32) + number, number + 1
            doc, last = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths), _last_places(lengths)
            before, words, doc = np.concatenate((before, np.full(len(last), END))), np.concatenate((words, words[last])), np.concatenate((doc, doc[last]))
            keys = pair_keys(before, words)
            order = np.argsort(keys, kind="stable")  # documents of a key stay in order
            keys, doc, words = keys[order], doc[order], words[order]
            begins = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))) if len(keys) else np.zeros(0, np.int64)
            often = np.diff(np.append(begins, len(keys))).astype(np.uint32)
            keys, doc, words = keys[begins], doc[begins], words[begins]
            table, *losses_ = hot.value
            at, known = _find(table, keys)
            sums = np.array([np.bincount(doc[known], weights=x[at[known]] * often[known], minlength=len(lengths)) + (lengths > 0) * f for x, f in zip(losses_, first, strict=True)])
            no_id = np.array([i is None for i in ids])
            rows = [(name, -1, np.array([i or 0 for i in ids], np.int64).tobytes(), no_id.tobytes(), lengths.tobytes(), sums.tobytes())]
            keys, doc, words, often = (x[~known] for x in (keys, doc, words, often))
            bucket = _bucket_of(keys, words, head.value, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = _first_of(bucket[order])
            for begin, end in zip(cuts, np.append(cuts, len(order))[1:], strict=True):
                mine = order[begin:end]
                firsts = _first_of(keys[mine])
                each = np.diff(np.append(firsts, len(mine))).astype(np.uint32)
                rows.append((name, int(bucket[mine[0]]), *(squeezed(x) for x in (keys[mine][firsts], each, doc[mine], often[mine]))))
            ids.clear()
            held.clear()
            return _packed_rows(rows)

        for batch in slices(batches, "text"):
            ids += batch.column(0).to_pylist()
            held.append(coded(batch.column(1).to_pylist()))
            if sum(len(h[0]) for h in held) > SLICE or len(ids) > SLICE_DOCS:
                yield flush()
        if held:
            yield flush()

    return run


def _answer(model):
    """Buckets, in order, their counts before their postings, to sums of each posting's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = table = None
        for batch in batches:
            rows = []
            for name, bucket, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if name < 0:
                    keys, added, _ = _values(model.value, row)
                    order = np.argsort(keys)
                    number, table = bucket, (keys[order], *(x[order] for x in added))
                    continue
                keys, each, doc, often = loosened(row[0], np.uint64), *(loosened(x, np.uint32) for x in row[1:])
                at, known = _find(table[0], keys) if bucket == number else (None, np.zeros(1, bool))
                if not known.all():
                    raise ValueError("a pair of a document was not counted")
                docs, local = np.unique(doc, return_inverse=True)
                sums = [np.bincount(local, weights=np.repeat(x[at], each) * often) for x in table[1:]]
                rows.append((name, bucket, squeezed(docs), *(x.tobytes() for x in sums), None))
            yield _packed_rows(rows)

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices, in order, their documents before the buckets' answers, to scored documents."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64()),
    ])
    open_ = None

    def close() -> pa.RecordBatch:
        ids, no_id, lengths, sums = open_
        full = lengths > 0
        means = [np.divide(x, lengths, out=np.full(len(lengths), np.nan), where=full) for x in sums]
        arrays = [pa.array(x.round(9), pa.float64(), mask=~full) for x in (*means, means[0] - means[1])]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=no_id), pa.array(lengths, pa.int64()), *arrays], schema=schema)

    for batch in batches:
        for _, bucket, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if bucket < 0:
                if open_:
                    yield close()
                lengths = np.frombuffer(c, np.int64)
                open_ = np.frombuffer(a, np.int64), np.frombuffer(b, bool), lengths, np.frombuffer(d).reshape(2, -1).copy()
            else:
                open_[3][:, loosened(a, np.uint32)] += np.array([np.frombuffer(b), np.frombuffer(c)])
    if open_:
        yield close()


def cross_entropy_difference(docs: DataFrame, target: DataFrame, strength: float = STRENGTH, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (target less background) of every row of (doc_id, text).

    ``target`` has the doc_id of each target document, once, and ``is_target``; all documents are the background. Losses
    are nats per token, rounded to nine places, and null for texts without a token, null texts included. Repeated
    rows and rows with a null id are scored each, and a null id is never a target. An empty table gives no rows; with
    no target both models are even. Other columns are not read, whatever their names. Every word and pair counts; ``head``
    steers how the work is spread, not what comes out.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flagged = slim.join(target.select("doc_id", "is_target").hint("merge"), "doc_id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    counted = staged(slim.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total, kinds = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(1, -(-total // head))
    words = counted.where(F.col("n") >= least).select("word").collect()
    drop(counted)
    frequent = np.sort(np.array([r["word"] for r in words], np.int64).view(np.uint64))
    known, buckets = spark.sparkContext.broadcast(frequent), total // BUCKET + 1

    runs = flagged.mapInArrow(_pair_counts(known, buckets), _ROWS)
    pairs = staged(runs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_add_pairs, _ROWS), "lm-pairs")
    sums = {n: F.sum(n).alias(n) for n in ("target", "every", "target_ends", "every_ends")}
    totals = pairs.mapInArrow(_head_totals(known), "word long, target long, every long, target_ends long, every_ends long").groupBy("word").agg(*sums.values())
    counts, sizes = np.zeros((4, len(frequent))), [0] * 4
    for row in totals.collect():
        if row["word"] is None:
            sizes = [row[n] or 0 for n in sums]
        else:
            counts[:, np.searchsorted(frequent, np.int64(row["word"]).view(np.uint64))] = [row[n] for n in sums]
    scales = (1.0, sizes[0] / sizes[1] if sizes[0] else 0.0)
    # The text's start, and words that neither corpus has, count too.
    model = spark.sparkContext.broadcast((frequent, counts[:2], counts[2:], sizes[:2], scales, kinds + 2, strength, least))
    first = tuple(float(np.log(n * scale + strength)) for n, scale in zip(sizes[2:], scales, strict=True))

    rows = pairs.mapInArrow(_frequent(model), _ROWS).select("a", "b", "c").collect()
    keys, *added = (np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind) for c, kind in (("a", np.uint64), ("b", float), ("c", float)))
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], *(x[order] for x in added)))

    posted = staged(slim.mapInArrow(_post(known, hot, first, buckets), _ROWS), "lm-postings")
    asked = pairs.unionByName(posted.where("bucket >= 0")).repartition(buckets, "bucket")
    answers = asked.sortWithinPartitions("bucket", "slice").mapInArrow(_answer(model), _ROWS)
    answered = staged(posted.where("bucket < 0").unionByName(answers), "lm-answers")
    drop(pairs, posted)
    placed = answered.repartition("slice").sortWithinPartitions("slice", "bucket")
    scored = staged(placed.mapInArrow(_finish, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"), "lm-scores")
    drop(answered)
    return scored
