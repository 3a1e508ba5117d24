"""WARC archives: a writer of gzip members, and a splittable reader.

Writing goes through Spark's own file writer, so it reaches any store and commits like any other job. The text writer
puts a separator after every row; a gzip member ends with the high byte of its length, which is zero below
16 MiB (a longer one is followed by an empty member, which ends in zero too). So rows are members without their last
byte, and the separator is that byte: the file is plain concatenated gzip.

Reading: the scan cuts files into byte ranges and each task looks for the gzip magic in its range; the piece that
follows a magic belongs to the range in which the magic ends. A piece is a candidate member: its header is decoded, and
a false magic inside another member's bytes fails that test and is put back. So is a member that a false magic in its own
head leaves too short to tell; what is put together so is taken apart again, member by member, when it is unpacked. Where a member runs over a false
magic into the next range, both tasks report the loose bytes, and these few fragments are joined by file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import new_folder, slices

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000203") + b"\x03\x00" + bytes(8)
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)
_RECORDS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ("file", pa.string()), ("begin", pa.int64()), ("seq", pa.int64()), ("loose", pa.binary()),
])
_READ_SCHEMA = RECORD_SCHEMA + ", file string, begin long, seq long, loose binary"


# -- writing ---------------------------------------------------------------------------------------------------------


def plan_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Add payload_digest, payload_bytes, record_type and refers_to to (page_id, url, html).

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the response. Only
    digests and ids are grouped, folded before the shuffle; pages are then joined on (digest, page_id), which no
    common payload makes hot. A row without page_id cannot be named, so it is a response; rows that repeat the
    largest id are responses too.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.withColumns({"payload_digest": F.sha1(body), "payload_bytes": F.octet_length(body).cast("long")})
    slim = rows.select("page_id", "payload_digest", "payload_bytes").where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    best = slim.groupBy("payload_digest").agg(F.max("page_id").alias("best"), F.min("page_id").alias("_low")).where("best != _low").drop("_low")
    later = slim.join(best, "payload_digest").where("page_id < best").select("page_id", "payload_digest", F.col("best").alias("refers_to")).distinct()
    joined = rows.join(later, ["page_id", "payload_digest"], "left")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _header_safe(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without name or time, so that a task that runs again writes the same bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return MAGIC + b"\x00" + bytes(4) + b"\x00\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def warc_record(page_id, url, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """Bytes of a record; a revisit keeps the HTTP head, whose length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = "none" if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_safe(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(date: str, level: int):
    schema = pa.schema([("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            members = []
            for page_id, url, html, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = gzip_member(warc_record(page_id, url, (html or "").encode(), digest, size, refers, date), level)
                if member[-1]:
                    member += EMPTY_MEMBER
                members.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], schema=schema)

    return run


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> None:
    """Write a WARC record per row of (page_id, url, html) into files under ``path``, a new folder."""
    ready = plan_revisits(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")))
    ready = ready.select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to")
    members = ready.mapInArrow(_writer(date, level), "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\x00").option("compression", "none").text(path)


# -- reading ---------------------------------------------------------------------------------------------------------


def _inflate(data: bytes) -> tuple[list[bytes], bool]:
    """(content of each, complete) of the gzip members in ``data``; only zeros may follow the last."""
    out = []
    while data[:3] == MAGIC:
        unpack = zlib.decompressobj(31)
        out.append(unpack.decompress(data))
        if not unpack.eof:
            return out, False
        data = unpack.unused_data
    if data.strip(b"\x00"):
        raise ValueError(f"{len(data)} bytes of no member")
    return out, True


def starts_record(piece: bytes) -> bool:
    """Does a member that begins with the magic and goes on with ``piece`` open a WARC record, or hold nothing?"""
    if len(piece) < 7 or piece[0] & 0xE0:
        return False
    try:
        unpack = zlib.decompressobj(31)
        head = unpack.decompress(MAGIC + piece, 64)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") or (not head and unpack.eof)


def parse_record(content: bytes) -> tuple | None:
    """(record id, type, uri, refers to, digest, payload length, payload), or None for an empty member."""
    if not content:
        return None
    if not content.startswith(b"WARC/1."):
        raise ValueError(f"a member of {len(content)} bytes that is no record")
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = int(fields.get("content-length", len(rest)))
    block, left = rest[:length], rest[length:]
    if left.strip(b"\r\n"):
        raise ValueError(f"{len(left)} bytes behind a record in its member")
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    size = len(payload)
    if fields.get("warc-type") == "revisit":
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                size = int(value)
        payload, digest = None, fields.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    return fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a task's ranges to records; loose bytes at a range's ends become fragments.

    A fragment with ``seq`` 0 is what a range begins with and does not own; ``seq`` 1 is an owned member whose end
    lies behind the range.
    """
    place, open_piece = None, None
    rows: list[tuple] = []
    held = 0

    def close(end_of_range: bool) -> None:
        nonlocal open_piece, held
        if open_piece is None:
            return
        kind, data = open_piece
        open_piece = None
        if kind == 0:
            rows.append((*[None] * 7, *place, 0, data))
            return
        contents, whole = _inflate(data)
        if not whole and end_of_range:
            rows.append((*[None] * 7, *place, 1, data))
        elif not whole:
            raise ValueError(f"broken gzip member in {place[0]}")
        else:
            rows.extend((*record, *place, 2, None) for record in map(parse_record, contents) if record)
            held += sum(map(len, contents))

    for batch in batches:
        for value, file, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (file, begin) != place:
                close(True)
                place, first = (file, begin), True
            if starts_record(value):
                close(False)
                open_piece = (1, MAGIC + value)
            elif first and begin == 0:
                open_piece = None if value == b"" else (0, value)  # what precedes a file's first magic
            elif open_piece is None:
                open_piece = (0, MAGIC + value)
            else:
                open_piece = (open_piece[0], open_piece[1] + MAGIC + value)
            first = False
            if held > 4 << 20:
                yield _batch(rows)
                rows, held = [], 0
    close(True)
    if rows:
        yield _batch(rows)


def _join_fragments(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Fragments of one file in order: an open member takes the unowned bytes of the ranges that follow."""
    parts = sorted(table.select(["begin", "seq", "loose"]).to_pylist(), key=lambda r: (r["begin"], r["seq"]))
    rows, data = [], None

    def close() -> None:
        contents, whole = _inflate(data)
        if not whole:
            raise ValueError(f"broken gzip member in {key[0].as_py()}")
        rows.extend((*record, key[0].as_py(), 0, 2, None) for record in map(parse_record, contents) if record)

    for part in parts:
        if part["seq"] == 1:
            if data is not None:
                close()
            data = part["loose"]
        elif data is not None:
            data += part["loose"]
        elif part["loose"].startswith(MAGIC):  # a member that its range could not tell
            data = part["loose"]
        elif part["loose"].strip(b"\x00"):
            raise ValueError(f"bytes of no member in {key[0].as_py()}")
    if data is not None:
        close()
    return pa.Table.from_batches([_batch(rows)] if rows else [], schema=_RECORDS)


def scan_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, begin): what follows each magic, raw, with the byte range in which the magic ends."""
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return lines.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the gzip-per-record archives under ``path``; files must not carry a .gz suffix, or Spark unpacks them.

    Empty files give no rows. Bytes that belong to no member raise an error rather than vanish.
    """
    found = scan_pieces(spark, path).mapInArrow(_decode, _READ_SCHEMA)
    whole = found.where("seq = 2")
    fragments = scan_pieces(spark, path).mapInArrow(_decode, _READ_SCHEMA).where("seq < 2")
    joined = fragments.groupBy("file").applyInArrow(_join_fragments, _READ_SCHEMA)
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    return whole.select(*names).unionByName(joined.select(*names))


def page_number(column: Column) -> Column:
    return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null url leaves the header out; null and repeated page ids are written like
    others (see ``plan_revisits``). Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write_warc(pages, path)
    records = read_warc(spark, path)
    return records.select(
        page_number(F.col("record_id")).alias("page_id"), F.col("target_uri").alias("url"), "payload_bytes", "payload_digest", "record_type",
        page_number(F.col("refers_to")).alias("refers_to"),
    )
