"""Byte-level BPE over many words at once.

A text is cut where a space stands before a character that is not white space: such a space always opens a
pre-token, so chunks between cuts encode alone, and equal chunks encode once. Pre-tokens that were not met before are
merged together in arrays, one merge per word and round; a very long one is merged with a heap.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import sys
from collections.abc import Iterable

import numpy as np
import regex

NONE = np.int64(1 << 40)
LONG_WORD = 200  # bytes; longer pre-tokens go to the heap
CACHED = 250_000  # chunks that a worker remembers, and as many that it is about to forget
LONG_CHUNK = 60  # characters; longer chunks are not remembered
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")


class Vocabulary:
    """Tokens by id, and for each pair of ids that merges its rank and the merged id."""

    def __init__(self, tokens: dict[int, bytes], pairs: Iterable[tuple[int, int, int, int]], pattern: str) -> None:
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        single = {t[0]: i for i, t in tokens.items() if len(t) == 1}
        self.byte_ids = np.array([single.get(b, 0) for b in range(256)], np.int64)
        self.pattern = regex.compile(pattern)
        self.by_bytes = {t: i for i, t in tokens.items()}
        rows = np.array(list(pairs), np.int64).reshape(-1, 4)
        # Open addressing: a look-up is one or two array reads.
        self.bits = max(4, int(len(rows) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)  # rank << 20 | merged id
        self.probes = 0
        keys, values = (rows[:, 0] << 20) | rows[:, 1], (rows[:, 2] << 20) | rows[:, 3]
        at, step = self._slot(keys), 0
        while len(keys):
            first = np.unique(at, return_index=True)[1]
            free = first[self.keys[at[first]] == -1]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            step += 1
        self.probes = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, or NONE << 20."""
        keys = (left << 20) | right
        at = self._slot(keys)
        found = np.where(self.keys[at] == keys, self.values[at], NONE << 20)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            here = self.keys[at[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
        return found

    def merge_long(self, word: bytes) -> bytes:
        """One word of any length: a heap of pairs over a linked list."""
        ids = [int(self.byte_ids[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        known: dict[tuple[int, int], tuple[int, int] | None] = {}

        def pair(i: int) -> tuple[int, int] | None:
            if after[i] >= len(ids):
                return None
            key = ids[i], ids[after[i]]
            if key not in known:
                found = int(self.look_up(np.array(key[:1], np.int64), np.array(key[1:], np.int64))[0])
                known[key] = (found >> 20, found & ((1 << 20) - 1)) if found < NONE << 20 else None
            return known[key]

        heap = [(p[0], i, p[1]) for i in range(len(ids)) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            rank, i, merged = heapq.heappop(heap)
            if ids[i] < 0 or pair(i) != (rank, merged):
                continue
            gone = after[i]
            ids[i], after[i], ids[gone] = merged, after[gone], -1
            if after[i] < len(ids):
                before[after[i]] = i
            for j in (i, before[i]):
                if j >= 0 and (p := pair(j)):
                    heapq.heappush(heap, (p[0], j, p[1]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        long = {i for i, w in enumerate(words) if len(w) > LONG_WORD}
        lengths = np.array([0 if i in long else len(w) for i, w in enumerate(words)], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(w for i, w in enumerate(words) if i not in long), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_word = [], []
        while len(ids):
            rank = np.full(len(ids), NONE << 20, np.int64)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.look_up(ids[:-1][same], ids[1:][same])
            begins = np.concatenate(([0], np.flatnonzero(~same) + 1))
            best = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(ids))))
            busy = best < (NONE << 20)
            done_ids.append(ids[~busy])
            done_word.append(word[~busy])
            ids, word, rank, best = ids[busy], word[busy], rank[busy], best[busy]
            hits = np.flatnonzero(rank == best)
            hits = hits[np.concatenate(([True], word[hits][1:] != word[hits][:-1]))] if len(hits) else hits
            ids[hits] = best[hits] & ((1 << 20) - 1)
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            ids, word = ids[keep], word[keep]
        every, owner = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        data = every[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(words)) * 4).tolist()
        out, begin = [], 0
        for i, end in enumerate(ends):
            out.append(self.merge_long(words[i]) if i in long else data[begin:end])
            begin = end
        return out

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.tokens], np.int64)

    def decode(self, ids: bytes) -> bytes:
        """Raw bytes of the ids, whether or not they are whole characters."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def ranked(path: str, pattern: str) -> Vocabulary:
    """A rank file: any two neighbours whose bytes together are a token merge, lowest rank first."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    pairs = (
        (ranks[t[:i]], ranks[t[i:]], r, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
    )
    return Vocabulary({r: t for t, r in ranks.items()}, pairs, pattern)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in JSON vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def listed(path: str, pattern: str) -> Vocabulary:
    """A tokenizers JSON file: the listed merges in their order."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = byte_letters()
    as_bytes = lambda s: bytes(letters[c] for c in s)
    vocab = {s: i for s, i in model["vocab"].items() if all(c in letters for c in s)}
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    pairs = ((vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges))
    return Vocabulary({i: as_bytes(s) for s, i in vocab.items()}, pairs, pattern)


def added_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizers JSON file has matched inside texts, ahead of pre-tokens, and their ids."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens") or []
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"added tokens of {path} that depend on what is beside them")
    return {t["content"]: t["id"] for t in added}


class Encoder:
    """Encodes texts with one vocabulary, remembering chunks; ``added`` strings are cut out first and have ids of their own."""

    def __init__(self, vocabulary: Vocabulary, whole_tokens: bool, added: dict[str, int] | None = None) -> None:
        self.vocabulary, self.whole_tokens = vocabulary, whole_tokens
        self.added = {t: i.to_bytes(4, "little") for t, i in (added or {}).items()}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of single pre-tokens."""
        if not self.whole_tokens:
            return self.vocabulary.merge(words)
        known = list(map(self.vocabulary.by_bytes.get, words))
        merged = iter(self.vocabulary.merge([w for w, k in zip(words, known, strict=True) if k is None]))
        return [next(merged) if k is None else k.to_bytes(4, "little") for k in known]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Each chunk by itself: its pre-tokens, then their merges."""
        split = list(map(self.vocabulary.pattern.findall, chunks))
        pieces = list(set().union(*split))
        known = dict(zip(pieces, self.merge_words([p.encode("utf-8", "replace") for p in pieces]), strict=True))
        return [b"".join(map(known.__getitem__, ps)) for ps in split]

    def learn(self, chunks: list[str]) -> None:
        """Remember what ``chunks`` become behind a space.

        Letters alone are one pre-token. Letters and one other sign are two, so they share what the letters become.
        """
        cache = self.cache
        words, rest, ended, others = [], [], [], []
        for c in chunks:
            (words if c.isalpha() else rest).append(c)
        for c in rest:
            (ended if c[:-1].isalpha() else others).append(c)
        order = list({*words, *(w for c in ended if (w := c[:-1]) not in cache)})
        cache.update(zip(order, self.merge_words([(" " + w).encode("utf-8", "replace") for w in order]), strict=True))
        signs = list({c[-1] for c in ended})
        tails = dict(zip(signs, self.encode_chunks(signs), strict=True))
        for c in ended:
            cache[c] = cache[c[:-1]] + tails[c[-1]]
        cache.update(zip(others, self.encode_chunks([" " + c for c in others]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if self.added_pattern is None:
            return self.encode_ordinary(texts)
        # Every other part is an added token.
        parts = [self.added_pattern.split(t) for t in texts]
        plain = iter(self.encode_ordinary([p for ps in parts for p in ps[::2]]))
        return [b"".join(self.added[p] if k % 2 else next(plain) for k, p in enumerate(ps)) for ps in parts]

    def encode_ordinary(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with no regard to added tokens."""
        parts = [(_CUT.split(t) if _ODD.search(t) else t.split(" ")) for t in texts]
        if len(self.cache) > CACHED:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        fresh = [c for c in set().union(*(p[1:] for p in parts)) if c not in cache]
        again = [c for c in fresh if c in old]
        cache.update(zip(again, map(old.__getitem__, again), strict=True))
        fresh = [c for c in fresh if c not in cache]
        self.learn(fresh)
        heads = list({p[0] for p in parts})
        first = dict(zip(heads, self.encode_chunks(heads), strict=True))
        take = self.cache.__getitem__
        out = [first[p[0]] + b"".join(map(take, p[1:])) for p in parts]
        for chunk in fresh:
            if len(chunk) > LONG_CHUNK:
                del self.cache[chunk]
        return out


@functools.cache
def encoder(path: str, pattern: str, added: bool = False) -> Encoder:
    """One per worker and file; ``path`` is a rank file or a tokenizers JSON file on every machine.

    With ``added`` the JSON file's added tokens are matched in texts, as its library does; else they are ordinary text.
    """
    json_file = path.endswith(".json")
    return Encoder(listed(path, pattern) if json_file else ranked(path, pattern), not json_file, added_tokens(path) if added else None)


@functools.cache
def decoder(path: str, pattern: str) -> Vocabulary:
    return encoder(path, pattern).vocabulary


if sys.byteorder != "little":
    raise ImportError("token ids are written as little-endian")
