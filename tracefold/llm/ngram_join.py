"""N-gram Jaccard join by T-occurrence search.

A text's set holds the hashes of its distinct five-word shingles. Two sets link when 100 * intersection >= 75 * union,
which is the same as 7 * intersection >= 3 * (size + size): the intersection a pair needs is known from its sizes. In a
block of sets, a query's inverted lists are divided: the short ones are merged and counted, the few longest are only
probed, by binary search, for the sets that the count has left possible (DivideSkip). Sets that reach the
required overlap are linked.

Which sets meet is decided by prefixes. All shingles have one global order, those that many texts share last. Linked sets
share a shingle within their first quarter (and one more) in that order, so the lists of those prefixes hold every
link. Equal sets count once throughout. Sets are first searched in small blocks by the least hash of their shared
prefix shingles, which joins groups of copies without looking at all their pairs; then every pair that is still
apart, shares a prefix shingle and can reach its overlap is searched too. So components are exact, while the links
within a component are not all listed.

Sets themselves move only when they may link. Each has a map of its shingles' parities, a fortieth of its size: two
sets differ in at least as many shingles as their maps do in bits, which rules out most pairs that share a passage.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import drop, slices, staged
from tracefold.operators.components import connected_components

SHINGLE = 5
WORDS_HELD = 400_000  # words whose hashes a worker remembers
POSTINGS = 1_000_000  # prefix shingles that one reducer takes at a time
BLOCK_SETS = 512  # sets that are searched against each other at once
SHORT_LIST = 64  # lists of so many sets are looked at many at once
LISTS_HELD = 8 << 20  # bytes of maps and pairs of such lists
HOT_SHINGLES = 262_144  # shingles whose place in the order is known to be late
FILTER_BITS = 1 << 24
_PLACE = np.dtype([("t", "<u8"), ("d", "<u2"), ("p", "<u4")])
_K = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def required(n: np.ndarray | int, m: np.ndarray | int):
    """Least intersection that links sets of these sizes."""
    return -(-3 * (n + m) // 7)


def prefix_length(n: int) -> int:
    """Shingles of which a linked partner must share one: all but those a link may miss, and one more."""
    return n - -(-3 * n // 4) + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: words are what lies between white space, with A-Z lower-cased."""
    split = [(t or "").encode().lower().split() for t in texts]
    if len(_words) > WORDS_HELD:
        _words.clear()
    for word in set().union(*split):
        if word not in _words:
            _words[word] = xxhash.xxh3_64_intdigest(word)
    lengths = [len(s) for s in split]
    codes = np.fromiter((c for s in split for c in map(_words.__getitem__, s)), np.uint64, sum(lengths))
    rolled = np.zeros(max(0, len(codes) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        rolled = rolled * _K + codes[i : i + len(rolled)]
    rolled = _mixed(rolled)
    out, at = [], 0
    for n in lengths:
        if n >= SHINGLE:
            out.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for code in codes[at : at + n]:
                whole = whole * _K + code
            out.append(_mixed(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_id(shingles: np.ndarray) -> int:
    """One number for a set; sets of different sizes are kept apart by their sizes as well."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


def parity_map(shingles: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles end in i; at least as many bits as shingles, as a power of two."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    places = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(parities: np.ndarray, words: int) -> np.ndarray:
    """Maps (rows of 64-bit words) with fewer bits: parities of places that become one add up."""
    while parities.shape[1] > words:
        half = parities.shape[1] // 2
        parities = parities[:, :half] ^ parities[:, half:]
    return parities


def may_link(sizes: np.ndarray, maps: list[bytes]) -> np.ndarray:
    """Which sets of a block have a partner there that sizes and maps allow."""
    found = np.zeros(len(maps), bool)
    words = np.array([len(m) // 8 for m in maps])
    for level in np.unique(words):
        mine = np.flatnonzero(words == level)
        near = np.flatnonzero((words == level) | (words == 2 * level))
        table = np.concatenate([
            folded(np.frombuffer(b"".join(maps[i] for i in near if words[i] == w), np.uint64).reshape(-1, w), level) for w in (level, 2 * level) if (words[near] == w).any()
        ])
        near = np.concatenate([near[words[near] == level], near[words[near] == 2 * level]])
        for k, i in enumerate(mine):
            apart = np.bitwise_count(table ^ table[k]).sum(1)
            fits = sizes[i] + sizes[near] - apart.astype(np.int64) >= 2 * required(sizes[i], sizes[near])
            fits[k] = False
            if fits.any():
                found[i] = True
                found[near[fits]] = True
    return found


def near_pairs(sizes: np.ndarray, maps: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a[k], b[k]) of places sizes and maps allow to link."""
    words = np.array([len(m) // 8 for m in maps], np.int64)
    total, low, high = sizes[a] + sizes[b], np.minimum(words[a], words[b]), np.maximum(words[a], words[b])
    need = required(sizes[a], sizes[b])
    ok = (np.minimum(sizes[a], sizes[b]) >= need) & (high <= 2 * low)
    for level in np.unique(low[ok]):
        at = np.flatnonzero(ok & (low == level))
        used, local = np.unique(np.concatenate((a[at], b[at])), return_inverse=True)
        table = np.empty((len(used), level), np.uint64)
        for w in (level, 2 * level):
            if (mine := words[used] == w).any():
                table[mine] = folded(np.frombuffer(b"".join(maps[i] for i in used[mine]), np.uint64).reshape(-1, w), level)
        left, right = local[: len(at)], local[len(at) :]
        step = max(1, (1 << 18) // int(level))
        for begin in range(0, len(at), step):
            part = slice(begin, begin + step)
            apart = np.bitwise_count(table[left[part]] ^ table[right[part]]).sum(1, dtype=np.int64)
            ok[at[part]] = total[at[part]] - apart >= 2 * need[at[part]]
    return ok


# -- search in a block -------------------------------------------------------------------------------------------------


def _roots(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def search_block(sets: list[np.ndarray], queries: int | None = None) -> Iterator[tuple[int, int]]:
    """Links (i, j) of a block: a tree for each component, from searching every set, or the first ``queries`` only."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes[order])
    shingles, codes, counts = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    postings = owner[np.argsort(codes, kind="stable")]  # of each shingle, ascending
    ends = np.cumsum(counts)
    begins = ends - counts
    sized = sizes[order]
    starts = np.cumsum(sized) - sized
    parent = list(range(len(sets)))
    for q in range(len(sets)):
        if queries is not None and order[q] >= queries:
            continue
        n = int(sized[q])
        mine = codes[starts[q] : starts[q] + n]
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        # Every partner, or only those not smaller where all are queries.
        least = required(n, n) if queries is None else required(n, -(-3 * n // 4))
        if len(mine) < least:
            continue
        mine = mine[np.argsort(counts[mine], kind="stable")]
        # Longest lists aside: as many as keep the rest selective.
        aside = min(len(mine) - 1, int(least / (0.5 * np.log2(counts[mine[-1]] + 1) + 1)))
        short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
        merged = np.concatenate([postings[begins[c] : ends[c]] for c in short])
        found = np.bincount(merged, minlength=len(sets))
        possible = np.flatnonzero(found >= max(1, least - aside))
        if queries is None:
            possible = possible[possible > q]
        possible = possible[possible != q]
        if not len(possible):
            continue
        overlap = found[possible]
        for c in long:
            line = postings[begins[c] : ends[c]]
            at = np.searchsorted(line, possible)
            overlap = overlap + (line[np.minimum(at, len(line) - 1)] == possible)
        for j in possible[overlap >= required(n, sized[possible])]:
            a, b = _roots(parent, q), _roots(parent, int(j))
            if a != b:
                parent[b] = a
                yield int(order[q]), int(order[j])


# -- passes over the texts ---------------------------------------------------------------------------------------------


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's set as (doc_id, n, ent, map), and at the end the shingles that this task met again and again."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int32()), ("ent", pa.int64()), ("map", pa.binary()), ("shingle", pa.int64()), ("hits", pa.int64()),
    ])
    often: Counter[int] = Counter()
    recent: dict[int, np.ndarray] = {}
    held = 0

    def fold() -> None:
        nonlocal often, held
        found, counts = np.unique(np.concatenate(list(recent.values())), return_counts=True)
        more = counts > 1
        often.update(dict(zip(found[more].tolist(), counts[more].tolist(), strict=True)))
        if len(often) > 2 * HOT_SHINGLES:
            often = Counter(dict(often.most_common(HOT_SHINGLES)))
        recent.clear()
        held = 0

    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column(1).to_pylist())
        ids = [set_id(s) if len(s) else None for s in sets]
        none = pa.nulls(len(sets), pa.int64())
        maps = [parity_map(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(ids, pa.int64()), pa.array(maps, pa.binary()), none, none], schema=schema
        )
        recent.update((i, s) for i, s in zip(ids, sets, strict=True) if len(s))
        held += sum(map(len, sets))
        if held > 3_000_000:
            fold()
    if recent:
        fold()
    top = often.most_common(HOT_SHINGLES)
    if top:
        none = pa.nulls(len(top))
        shingle = np.array([t for t, _ in top], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(shingle), pa.array([c for _, c in top], pa.int64())], schema=schema)


def _prefixes(hot, buckets: int):
    """Prefix shingles, packed by bucket; those known to be common are dealt by set, as their lists may be long."""
    schema = pa.schema([("bucket", pa.int64()), ("places", pa.binary()), ("ents", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, late = hot.value
        ents: list[int] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        seen: dict[int, int] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            places, bucket = np.concatenate(parts), np.concatenate(kinds)
            order = np.argsort(bucket, kind="stable")
            places, bucket = places[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            ent_of, size_of = np.array(ents, "<i8"), np.array(sizes, "<i4")
            rows = []
            for number, run_ in zip(bucket[np.concatenate(([0], cuts))], np.split(places, cuts), strict=True):
                used, local = np.unique(run_["d"], return_inverse=True)
                run_ = run_.copy()
                run_["d"] = local
                rows.append((int(number), run_.tobytes(), ent_of[used].tobytes(), size_of[used].tobytes()))
            for kept in (ents, sizes, parts, kinds):
                kept.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in slices(batches, "text"):
            for shingles in shingle_sets(batch.column(0).to_pylist()):
                n = len(shingles)
                if not n or (ent := set_id(shingles)) in seen:
                    continue
                seen[ent] = 1
                at = np.searchsorted(common, shingles)
                rank = np.where(common[np.minimum(at, len(common) - 1)] == shingles, late[np.minimum(at, len(common) - 1)], 0) if len(common) else np.zeros(n, np.int64)
                order = np.argsort(rank, kind="stable")[: prefix_length(n)] if rank.any() else np.arange(prefix_length(n))
                place = np.zeros(len(order), _PLACE)
                place["t"], place["d"], place["p"] = shingles[order], len(ents), np.arange(len(order))
                known = rank[order] > 0
                kinds.append(np.where(known, buckets + (ent % buckets), (_mixed(place["t"]) % np.uint64(buckets)).astype(np.int64)))
                parts.append(place)
                ents.append(ent)
                sizes.append(n)
                held += n
                if held > 2_000_000 or len(ents) > 60_000:  # places of sets have 16 bits
                    yield flush()
                    held = 0
        if parts:
            yield flush()

    return run


def _lists(buckets: int):
    """Buckets, in order, to (shingle, ent, n, pos) of the prefix shingles that more than one set has."""
    schema = pa.schema([("shingle", pa.int64()), ("ent", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []

        def close() -> pa.RecordBatch:
            shingle, ent, n, pos = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((ent, shingle))
            shingle, ent, n, pos = shingle[order], ent[order], n[order], pos[order]
            fresh = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (ent[1:] != ent[:-1])))
            shingle, ent, n, pos = shingle[fresh], ent[fresh], n[fresh], pos[fresh]
            if number < buckets:
                same = shingle[1:] == shingle[:-1]
                shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
                shingle, ent, n, pos = shingle[shared], ent[shared], n[shared], pos[shared]
            return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(ent), pa.array(n), pa.array(pos.astype(np.int32))], schema=schema)

        for batch in batches:
            for bucket, places, ents, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != number:
                    if held:
                        yield close()
                    number, held = bucket, []
                place = np.frombuffer(places, _PLACE)
                held.append((place["t"], np.frombuffer(ents, "<i8")[place["d"]], np.frombuffer(sizes, "<i4")[place["d"]], place["p"]))
        if held:
            yield close()

    return run


def _sets(wanted):
    """(ent, shingles) of the documents whose id passes the filter."""
    schema = pa.schema([("ent", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            asked = pa.array([i is None or bool(bits[(i % FILTER_BITS) >> 6] >> np.uint64(i & 63) & np.uint64(1)) for i in ids])
            sets = {set_id(s): s.tobytes() for s in shingle_sets(batch.column(1).filter(asked).to_pylist()) if len(s)}
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], schema=schema)

    return run


def _viable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, in order, to their members that may link with another."""
    schema = pa.schema([("block", pa.int64()), ("sub", pa.int64()), ("ent", pa.int64())])
    place, ents, sizes, maps = None, [], [], []

    def close() -> pa.RecordBatch:
        kept = [e for e, ok in zip(ents, may_link(np.array(sizes, np.int64), maps), strict=True) if ok] if len(ents) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([place[0]] * len(kept), pa.int64()), pa.array([place[1]] * len(kept), pa.int64()), pa.array(kept, pa.int64())], schema=schema)

    for batch in batches:
        for block, sub, ent, n, parities in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (block, sub) != place:
                if ents:
                    yield close()
                place, ents, sizes, maps = (block, sub), [], [], []
            ents.append(ent)
            sizes.append(n)
            maps.append(parities)
    if ents:
        yield close()


def allowed_pairs(sizes: np.ndarray, comps: np.ndarray, maps: list[bytes], queries: int, across: bool = False) -> Iterator[tuple[int, int]]:
    """Places (i, j), one among the first ``queries`` (``across``: just one), of different components, that sizes and maps allow to link."""
    words = np.array([len(m) // 8 for m in maps])
    for level in np.unique(words):
        near = np.flatnonzero((words == level) | (words == 2 * level))
        near = np.concatenate([near[words[near] == level], near[words[near] == 2 * level]])
        table = np.concatenate([
            folded(np.frombuffer(b"".join(maps[i] for i in near[words[near] == w]), np.uint64).reshape(-1, w), level) for w in (level, 2 * level) if (words[near] == w).any()
        ])
        # A pair is met from both sides where both are of this level, and from one side across levels: either may ask.
        mine = np.flatnonzero(words[near] == level)
        step = max(1, (1 << 21) // table.size)
        for begin in range(0, len(mine), step):
            rows = mine[begin : begin + step]
            apart = np.bitwise_count(table[rows][:, None, :] ^ table[None, :, :]).sum(2, dtype=np.int64)
            total = sizes[near[rows]][:, None] + sizes[near][None, :]
            fits = (total - apart >= 2 * -(-3 * total // 7)) & (comps[near[rows]][:, None] != comps[near][None, :])
            ask, asked = (near[rows] < queries)[:, None], (near < queries)[None, :]
            fits &= ask != asked if across else ask | asked
            for i, j in zip(*np.nonzero(fits), strict=True):
                yield int(near[rows[i]]), int(near[j])


def allowed_in_lists(lists: list[tuple]) -> Iterator[tuple[int, int]]:
    """Pairs of ``allowed_pairs``, as ents, of many short lists (ents, sizes, comps, maps, queries, across) at once."""
    lengths = np.array([len(x[0]) for x in lists])
    ents, sizes, comps = (np.concatenate([np.array(x[k], np.int64) for x in lists]) for k in range(3))
    a, b = (np.concatenate(c) for c in zip(*((i + begin, j + begin) for begin, (i, j) in zip(np.cumsum(lengths) - lengths, map(_corners, lengths.tolist()), strict=True)), strict=True))
    asks = np.concatenate([np.arange(len(x[0])) < x[4] for x in lists])
    across = np.repeat([x[5] for x in lists], lengths)
    meet = (comps[a] != comps[b]) & np.where(across[a], asks[a] != asks[b], asks[a] | asks[b])
    a, b = a[meet], b[meet]
    fits = near_pairs(sizes, [m for x in lists for m in x[3]], a, b)
    yield from zip(ents[a[fits]].tolist(), ents[b[fits]].tolist(), strict=True)


@lru_cache(SHORT_LIST + 1)
def _corners(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _viable_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lists, in order and asking members first, to pairs (a, b), a < b, that may link; each once a task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    place, asked, across, told = None, 0, False, set()
    ents, sizes, comps, maps, places = [], [], [], [], set()
    short, held = [], 0  # lists that wait to be looked at together, and their bytes of maps and pairs

    def tell(pairs: Iterator[tuple[int, int]]) -> pa.RecordBatch:
        found = {(min(p), max(p)) for p in pairs} - told
        if len(told) > 500_000:
            told.clear()
        told.update(found)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], schema=schema)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if len(ents) > SHORT_LIST:
            yield tell((ents[i], ents[j]) for i, j in allowed_pairs(np.array(sizes, np.int64), np.array(comps, np.int64), maps, asked, across))
        elif len(ents) > 1:
            short.append((ents, sizes, comps, maps, asked, across))
            held += sum(map(len, maps)) + 16 * len(ents) ** 2
            if held > LISTS_HELD:
                yield together()

    def together() -> pa.RecordBatch:
        nonlocal held
        batch = tell(allowed_in_lists(short))
        short.clear()
        held = 0
        return batch

    for batch in batches:
        for shingle, sub, query, ent, n, comp, parities in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (shingle, sub) != place:
                if asked:
                    yield from close()
                place, asked, across = (shingle, sub), 0, query == 2
                ents, sizes, comps, maps, places = [], [], [], [], set()
            if ent in places:
                continue  # it asks already
            places.add(ent)
            ents.append(ent)
            sizes.append(n)
            comps.append(comp)
            maps.append(parities)
            asked += query > 0
    if asked:
        yield from close()
    if short:
        yield together()


def _allowed_trials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their maps allow to link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        sizes_a, sizes_b, maps_a, maps_b = (c.to_pylist() for c in batch.columns[2:])
        places = np.arange(len(maps_a))
        keep = pa.array(near_pairs(np.array(sizes_a + sizes_b, np.int64), maps_a + maps_b, places, len(places) + places))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sets, in order, to links. Rows that are ``asked`` come first; a block without any is searched by all."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    place, ents, sets, asked = None, [], [], 0

    def close() -> pa.RecordBatch:
        links = [(ents[i], ents[j]) for i, j in search_block(sets, asked or None)] if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    for batch in slices(batches, "shingles"):
        for block, sub, query, ent, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (block, sub) != place:
                if sets:
                    yield close()
                place, ents, sets, asked = (block, sub), [], [], 0
            ents.append(ent)
            sets.append(np.frombuffer(shingles, np.uint64))
            asked += query
    if sets:
        yield close()


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Search (block, sub, query, ent) with the sets' shingles."""
    full = members.join(sets, "ent").select("block", "sub", "query", "ent", "shingles")
    placed = full.repartition("block", "sub").sortWithinPartitions("block", "sub", F.desc("query"))
    return placed.mapInArrow(_search, "src long, dst long")


# -- the join ----------------------------------------------------------------------------------------------------------


def _labelled(lists: DataFrame, components: DataFrame) -> DataFrame:
    """Lists in which more than one component remains, with each member's component."""
    known = components.select(F.col("node").alias("ent"), F.col("component").alias("comp"))
    rows = lists.join(known, "ent", "left").withColumn("comp", F.coalesce("comp", "ent"))
    mixed = rows.groupBy("shingle").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a != _b").select("shingle")
    return rows.join(mixed, "shingle")


def _main(rows: DataFrame) -> DataFrame:
    """The component with most members in each list, and its member that is a representative."""
    sized = rows.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("ent", "n", "pos")).alias("rep"))
    return sized.groupBy("shingle").agg(F.max(F.struct("k", "comp", "rep")).alias("m")).select("shingle", F.col("m.comp").alias("main"), F.col("m.rep").alias("rep"))


def _fits() -> object:
    """Sizes that a link allows."""
    return (4 * F.least("n_a", "n_b")) >= (3 * F.greatest("n_a", "n_b"))


def _search_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among pairs (a, b): each a asks blocks of its partners."""
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    partners = pairs.join(counted, "a").select(
        F.col("a").alias("block"), F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / BLOCK_SETS)).alias("sub"), F.col("b").alias("ent")
    )
    asking = partners.select("block", "sub").distinct().select("block", "sub", F.lit(1).alias("query"), F.col("block").alias("ent"))
    return _links(asking.unionByName(partners.withColumn("query", F.lit(0)).select("block", "sub", "query", "ent")), sets)


def _fetched(docs: DataFrame, home: DataFrame, ents: DataFrame) -> DataFrame:
    """(ent, shingles) of ``ents``, from one document each; a bitmap of fixed size spares the others' shingling."""
    spark = docs.sparkSession
    bit = F.pmod("home", F.lit(FILTER_BITS))
    homes = home.join(ents, "ent").where(F.col("home").isNotNull())
    marks = homes.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(home, {FILTER_BITS}) & 63 as int))")).alias("bits"))
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    for row in marks.collect():
        bits[row["word"]] = np.uint64(row["bits"] & (1 << 64) - 1)
    found = docs.mapInArrow(_sets(spark.sparkContext.broadcast(bits)), "ent long, shingles binary")
    return staged(found.join(ents, "ent", "left_semi").dropDuplicates(["ent"]), "shingle-sets")


def _blocks(full: DataFrame) -> DataFrame:
    """Blocks (shingle, sub, query) of bounded size in which every pair of a list meets once, from members with ``main``.

    Of linked sets the smaller has their first common shingle at an early place, within its first seventh: else too
    few shingles are left behind it. So lists without an early member need no search. Long lists are cut by size,
    early or late, main component or not, and then into blocks; blocks meet in pairs, an early one with one of its own or the
    next larger sizes, one of both outside the main component. Query 1: all pairs; 2 with 0: pairs across.
    """
    columns = [c for c in full.columns if c not in ("pos", "main")]
    full = full.withColumns({
        "late": (F.col("pos") * 7 > F.col("n")).cast("int"), "stands": (F.col("comp") == F.col("main")).cast("int"),
        "band": F.floor(F.log("n") / F.log(F.lit(1.4))),  # linked sizes differ by a third at most
    })
    counted = full.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("late").alias("_late")).where("_late = 0").drop("_late")
    full = full.join(counted, "shingle")
    whole = full.where(F.col("m") <= 4 * BLOCK_SETS).withColumns({"sub": F.lit(""), "query": 1 - F.col("stands")})

    kind = ["band", "late", "stands"]
    long = full.where(F.col("m") > 4 * BLOCK_SETS)
    kinds = long.groupBy("shingle", *kind).agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK_SETS)).alias("blocks"))
    cut = long.join(kinds, ["shingle", *kind]).withColumn("block", F.pmod(F.xxhash64("ent"), "blocks"))
    groups = kinds.select("shingle", *kind, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    kind.append("block")
    a = groups.select("shingle", *(F.col(c).alias(f"a_{c}") for c in kind)).where("a_late = 0")
    b = groups.select("shingle", *(F.col(c).alias(f"b_{c}") for c in kind))
    cells = a.join(b, "shingle").where(
        "b_band in (a_band, a_band + 1) and (a_stands = 0 or b_stands = 0) "
        "and (b_band > a_band or b_late = 1 or b_stands > a_stands or (b_stands = a_stands and b_block >= a_block))"
    )
    names = [f"{side}_{c}" for side in "ab" for c in kind]
    cells = cells.withColumn("same", F.expr(" and ".join(f"a_{c} = b_{c}" for c in kind))).withColumn("sub", F.concat_ws(":", *names))
    first = cells.select("shingle", *(F.col(f"a_{c}").alias(c) for c in kind), "sub", F.when(F.col("same"), 1).otherwise(2).alias("query"))
    second = cells.where("not same").select("shingle", *(F.col(f"b_{c}").alias(c) for c in kind), "sub", F.lit(0).alias("query"))
    met = cut.join(first.unionByName(second), ["shingle", *kind])
    order = ["shingle", "sub", "query", *(c for c in columns if c != "shingle")]
    return whole.select(*order).unionByName(met.select(*order))


def _pairs_apart(lists: DataFrame, components: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle and that their maps allow to link.

    Pairs are formed in the task, block by block, and only those that may link leave it.
    """
    apart = staged(_labelled(lists, components), "apart")
    full = staged(apart.join(_main(apart).drop("rep"), "shingle").select("shingle", "ent", "n", "pos", "comp", "main"), "apart-full")
    # Maps are a multiple of all else: they join once, when each row's blocks are known.
    placed = staged(_blocks(full), "apart-blocks")
    blocks = placed.join(maps, "ent").select("shingle", "sub", "query", "ent", "n", "comp", "map")
    found = blocks.repartition("shingle", "sub").sortWithinPartitions("shingle", "sub", F.desc("query")).mapInArrow(_viable_pairs, "a long, b long")
    pairs = staged(found.distinct(), "pairs")
    drop(apart, full, placed)
    return pairs


def _trials(lists: DataFrame, components: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and one member of the main component of a list it is in, but apart from, that may link."""
    apart = staged(_labelled(lists, components), "apart")
    tried = apart.join(_main(apart), "shingle").where(F.col("comp") != F.col("main")).select(
        F.col("ent").alias("a"), F.col("rep.ent").alias("b"), F.col("n").alias("n_a"), F.col("rep.n").alias("n_b")
    ).where(_fits()).distinct()
    left = maps.select(F.col("ent").alias("a"), F.col("map").alias("map_a"))
    right = maps.select(F.col("ent").alias("b"), F.col("map").alias("map_b"))
    both = tried.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "map_a", "map_b")
    pairs = staged(both.mapInArrow(_allowed_trials, "a long, b long"), "pairs")
    drop(apart)
    return pairs


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, ent) of every row, (node, component) of every set that is linked)."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = staged(slim.mapInArrow(_describe, "doc_id long, n int, ent long, map binary, shingle long, hits long"), "shingled")
    rows = staged(described.where("hits is null").select("doc_id", "n", "ent"), "set-rows")
    often = described.where("hits is not null").groupBy("shingle").agg(F.sum("hits").alias("hits"))
    top = often.orderBy(F.desc("hits"), "shingle").limit(HOT_SHINGLES).collect()
    common = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    late = np.array([1 + int(r["hits"]).bit_length() for r in top], np.int64)
    order = np.argsort(common)
    hot = spark.sparkContext.broadcast((common[order], late[order]))

    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, total // 4 // POSTINGS + 1)
    packed = slim.select("text").mapInArrow(_prefixes(hot, buckets), "bucket long, places binary, ents binary, sizes binary")
    by_bucket = packed.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket")
    lists = staged(by_bucket.mapInArrow(_lists(buckets), "shingle long, ent long, n int, pos int"), "prefix-lists")

    # What is known of each listed set: its size, its map, and a document that has it.
    keys = lists.groupBy("ent").agg(*(F.min(F.xxhash64(F.lit(r), "shingle")).alias(f"k{r}") for r in (0, 1)))
    known = described.where("n > 0").groupBy("ent").agg(F.min("doc_id").alias("home"), F.min("n").alias("n"), F.min("map").alias("map"))
    listed = staged(keys.join(known, "ent"), "listed-sets")
    drop(described)
    maps, home = listed.select("ent", "map"), listed.select("ent", "home")

    # Blocks of sets that agree on the least of their shared prefix shingles, by two hashes.
    keyed = listed.select("ent", "n", "map", F.explode(F.array("k0", F.xxhash64(F.lit("second"), "k1"))).alias("block"))
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = keyed.join(sizes, "block").select(
        "block", F.pmod(F.xxhash64("ent", "block"), F.ceil(F.col("m") / BLOCK_SETS)).alias("sub"), "ent", "n", "map"
    )
    placed = members.repartition("block", "sub").sortWithinPartitions("block", "sub")
    viable = staged(placed.mapInArrow(_viable, "block long, sub long, ent long"), "viable")
    fetched = [_fetched(slim, home, viable.select("ent").distinct())]
    sets = fetched[0]
    links = staged(_links(viable.select("block", "sub", F.lit(0).alias("query"), "ent"), sets), "links")
    drop(viable)
    components = connected_components(links)
    drop(links)

    # What is apart in some list: first each set against one of the list's main component, then every pair.
    for choose in (_trials, _pairs_apart):
        pairs = choose(lists, components, maps)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("ent")).distinct().join(sets.select("ent"), "ent", "left_anti")
        fetched.append(_fetched(slim, home, wanted))
        sets = sets.unionByName(fetched[-1])
        links = staged(_search_pairs(pairs, sets), "links")
        drop(pairs)
        if not links.isEmpty():
            known = components.where("node != component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
            components = connected_components(known.unionByName(links))
        drop(links)
    drop(lists, listed, *fetched)
    return rows, components


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of (doc_id, text).

    With fewer than five words a text's set is its whole sequence; a null text or one without words has an empty set and
    is linked with nothing. Rows of equal sets are linked. Null ids are members of components but never name
    one, unless all their component's ids are null. An empty table gives no rows; other columns are not read.
    """
    rows, components = similar_sets(docs)
    known = components.select(F.col("node").alias("ent"), F.col("component").alias("comp"))
    sets = rows.where("n > 0").groupBy("ent").agg(F.min("doc_id").alias("low")).join(known, "ent", "left").withColumn("comp", F.coalesce("comp", "ent"))
    lowest = sets.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = sets.join(lowest, "comp").select("ent", "component_id")
    linked = rows.where("n > 0").join(named, "ent").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def kept_documents(docs: DataFrame) -> DataFrame:
    """Rows with all their columns, of each component only those with its smallest doc_id.

    A row stays when its id names its component, is null, or has no words. Ids tell rows apart here, so rows that
    share an id stay or go by what any of them is linked to.
    """
    gone = ngram_components(docs).where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
