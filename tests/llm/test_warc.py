import gzip
import hashlib
import os

import pytest

from tracefold.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, payload_bytes string"


def expected(rows):
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        best = max(same, default=None)
        revisit = len(data) >= 1000 and page_id is not None and page_id < best
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


def pages():
    long, twin = "é" * 5000, "t" * 1000
    rows = [(1, "http://a/1", long), (2, None, long), (3, "http://b/\n x", long), (4, "u", twin), (5, "u", twin), (6, "u", "short"), (7, "u", "short")]
    rows += [(8, "u", None), (9, "u", ""), (None, "u", long), (None, "u", "q" * 2000), (5, "u", twin), (-3, "u", long), (10, "u", "z" * 999)]
    return [(*r, "x", "y") for r in rows]


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_round_trip_of_every_kind(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    assert got(warc.round_trip(df, str(tmp_path / "w"))) == expected(pages())
    for name in os.listdir(tmp_path / "w"):
        if name.startswith("part-"):  # any reader of gzip takes the files
            text = gzip.decompress((tmp_path / "w" / name).read_bytes())
            assert text == b"" or text.startswith(b"WARC/1.1\r\n")


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("split", [50, 333, 4096])
def test_false_magics_and_small_ranges(spark, tmp_path, split):
    """Stored blocks carry magics of their own; ranges are shorter than records."""
    rows = [(i, "u", f"{i}" + "\x1f\x00\x08" * i) for i in range(30)]
    data = b"".join(
        warc.gzip_member(warc.warc_record(i, u, (warc.MAGIC + b"\x00" * 4 + h.encode()) * 3, "", 0, None, "d"), level=0) for i, u, h in rows
    )
    (tmp_path / "a").write_bytes(data + warc.EMPTY_MEMBER)
    (tmp_path / "b").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert found == {f"<urn:page:{i}>": (warc.MAGIC + b"\x00" * 4 + h.encode()) * 3 for i, _, h in rows}


def test_member_that_does_not_end_in_zero(monkeypatch):
    member = warc.gzip_member(b"x")[:-1] + b"\x01"
    assert (member + warc.EMPTY_MEMBER)[-1] == 0 and gzip.decompress(warc.gzip_member(b"x") + warc.EMPTY_MEMBER) == b"x"


def test_broken_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a").write_bytes(warc.gzip_member(b"WARC/1.1\r\nA: b\r\n\r\n" + b"x" * 100)[:-30])
    with pytest.raises(Exception, match="broken gzip member|bytes of no member"):
        warc.read_warc(spark, str(tmp_path)).collect()


def member_with_magic_in_its_head(data):
    """A gzip member that decodes to nothing up to a false magic, as one in its Huffman table does."""
    extra = b"ab\x05\x00" + b"xy" + warc.MAGIC
    plain = warc.gzip_member(data)
    return plain[:3] + b"\x04" + plain[4:10] + len(extra).to_bytes(2, "little") + extra + plain[10:]


@pytest.mark.parametrize("split", [50, 120, 333, 4096])
def test_a_magic_in_a_members_head_loses_no_record(spark, tmp_path, split):
    odd = {0, 4, 5, 9, 19}
    records = [warc.warc_record(i, "u", hashlib.sha256(bytes([i])).hexdigest().encode() * (1 + i % 4), "", 0, None, "d") for i in range(20)]
    data = b"".join((member_with_magic_in_its_head if i in odd else warc.gzip_member)(r) for i, r in enumerate(records))
    assert gzip.decompress(data) == b"".join(records)
    (tmp_path / "a").write_bytes(data)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, (split, 0)):
        spark.conf.set(k, v)
    try:
        found = sorted(r.record_id for r in warc.read_warc(spark, str(tmp_path)).collect())
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert found == sorted(f"<urn:page:{i}>" for i in range(20))


def test_what_is_left_over_is_an_error():
    record = warc.warc_record(1, "u", b"x", "", 0, None, "d")
    with pytest.raises(ValueError, match="behind a record"):
        warc.parse_record(record + record)
    with pytest.raises(ValueError, match="no record"):
        warc.parse_record(b"else")
    with pytest.raises(ValueError, match="no member"):
        warc._inflate(warc.gzip_member(record) + b"else")
