"""Content-addressed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column) -> Column:
    """Parts joined by NUL; a missing part still takes its place, so ids never collide by omission."""
    return F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def digest(*parts: Column) -> Column:
    return F.sha2(joined(*parts), 256)


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(digest(*parts), 1, length))


def fingerprint(*cols: Column) -> Column:
    """Digest of a canonical row. Arrays must arrive sorted."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
