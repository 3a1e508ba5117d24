import random
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from tracefold.llm import catalog
from tracefold.llm.packing import PIECE_SCHEMA, Packer, pack

SCHEMA = "doc_id long, text string, start string, offset string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, docs, window):
    """docs: [(id, ids)]; every id once, gapless sequences, full or a power of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == {i for i, _ in docs}
    for i, ids in docs:
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p["length"]
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at & (at - 1) == 0 and at < window


def tokenised(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [[*e.ids, 0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_every_kind_of_row(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta,", "γ", "x\n\ny", "12 34"]) for _ in range(rng.choice([0, 1, 5, 50, 700]))) for _ in range(60)]
    texts += [None, "", "z" * 3000, "<|endoftext|>", "  "]
    rows = [(i, t, "s", "o") for i, t in enumerate(texts)]
    for window, most, parts in ((1024, 64, 3), (8, 2, 7)):
        got = [r.asDict() for r in pack(spark.createDataFrame(rows, SCHEMA).repartition(parts), PATH, public_tokenizers.PATTERN, window, most).collect()]
        check(got, list(zip(range(len(texts)), tokenised(texts))), window)


def test_many_tasks_merge_in_rounds(spark):
    rows = [(i, "word " * (i % 7), "s", "o") for i in range(300)]
    got = [r.asDict() for r in pack(spark.createDataFrame(rows, SCHEMA).repartition(150), PATH, public_tokenizers.PATTERN, 16, 3).collect()]
    check(got, list(zip(range(300), tokenised([r[1] for r in rows]))), 16)


def test_null_and_repeated_ids_and_empty(spark):
    got = pack(spark.createDataFrame([(None, "a b", "", ""), (1, "c", "", ""), (1, "c", "", "")], SCHEMA), PATH, public_tokenizers.PATTERN).collect()
    assert sum(r.length for r in got) == 7 and sum(r.length for r in got if r.doc_id is None) == 3
    assert pack(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).count() == 0


def test_open_windows_are_bounded():
    packer = Packer(0, 0, 16, 4)
    for i in range(200):
        packer.place(i, 0, 1 + i % 11, struct.pack("<I", i) * (1 + i % 11))
        assert len(packer.open) <= 4 and sum(map(len, packer.pieces.values())) <= 64
    assert PIECE_SCHEMA.count(",") == 8


def test_added_tokens_are_matched_as_the_library_does(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|ENDOFTEXT|>", "  <|endoftext|>  \n b", "<|endoftext", "", None, "plain text"]
    ids = [[*e.ids, 0] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame([(i, t, "s", "o") for i, t in enumerate(texts)], SCHEMA)
    got = [r.asDict() for r in pack(df, PATH, public_tokenizers.PATTERN, 16, 4, added=True).collect()]
    check(got, list(enumerate(ids)), 16)


def test_the_query_matches_added_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "a <|endoftext|> b", "s", "o")], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in catalog.QUERIES["op6_packing"](spark, str(tmp_path)).collect()]
    ids = Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids
    check(got, [(1, [*ids, 0])], 1024)
