import base64
import hashlib
import random
import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracefold.llm import bpe, bpe_codec

PATH, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"
with open(PATH, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", "中文", "1", "22", "'s", "'", "!", "…", "\x1c", "\x85", "\u3000", "\r\n", "😀", "$", "z" * 300, "\0", "ab" * 150, "<|endoftext|>", "'ll", "I'm", "Ǆ", "\u0301"]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=6))
def test_encoders_equal_the_libraries(texts):
    assert bpe.encoder(PATH, public_tokenizers.PATTERN).encode(texts) == [packed(LIBRARY.encode_ordinary(t)) for t in texts]
    library = Tokenizer.from_file(JSON) if not hasattr(test_encoders_equal_the_libraries, "t") else test_encoders_equal_the_libraries.t
    library.encode_special_tokens = True
    test_encoders_equal_the_libraries.t = library
    assert bpe.encoder(JSON, public_tokenizers.PATTERN).encode(texts) == [packed(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character():
    signs = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000][::7]
    texts = [f"a{c} {c}b {c}" for c in signs]
    assert bpe.encoder(PATH, public_tokenizers.PATTERN).encode(texts) == [packed(i) for i in LIBRARY.encode_ordinary_batch(texts)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    encoder = bpe.Encoder(bpe.decoder(PATH, public_tokenizers.PATTERN), True)
    texts = ["one two three, four.", "two five, one", "six one two five", "x" * 100 + " y"]
    for _ in range(3):
        assert encoder.encode(texts) == [packed(LIBRARY.encode_ordinary(t)) for t in texts]


def test_chunks_meet_in_every_kind_of_text(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 60]))) for _ in range(40)]
    texts += [None, "", "a" * 900, " " * 700, "\n " * 300, "word " * 400, "1" * 65, "中" * 200, " " * 64 + "a"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "null id", "", ""), (7, texts[7], "", "")]
    want = sorted(((i, len(ids := LIBRARY.encode_ordinary(t or "")), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=repr)
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk, overlap in ((64, 20), (50, 3), (bpe_codec.CHUNK, bpe_codec.OVERLAP)):
        got = bpe_codec.round_trip_digest(df, PATH, public_tokenizers.PATTERN, chunk, overlap)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "Hello, wörld! " * 30, "", ""), (2, None, "", "")], SCHEMA)
    encoded = bpe_codec.encode(df, PATH, public_tokenizers.PATTERN, 40, 9)
    got = {r.doc_id: (bytes(r.ids), bytes(r.data)) for r in bpe_codec.decode(encoded, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {1: (packed(LIBRARY.encode_ordinary("Hello, wörld! " * 30)), ("Hello, wörld! " * 30).encode()), 2: (b"", b"")}
    assert bpe_codec.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
