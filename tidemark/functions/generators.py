"""Columns of generated values. Every value is a hash of seed, round, row and field, so a rerun makes the same data."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def salted(*parts: Column | str | int) -> Column:
    """Text that identifies one value."""
    return F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def unit(text: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uuid_of(text: Column) -> Column:
    """md5 of the text in the form of a UUID."""
    digest = F.md5(text)
    return F.concat_ws("-", *(F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def whole(text: Column) -> Column:
    """A long over the full range: the last 16 hex digits of the text's md5 as a signed number."""
    return F.conv(F.substring(F.md5(text), 17, 16), 16, -10).cast("long")


def text_of(text: Column, low: int) -> Column:
    """Random letters, digits and symbols; their number is from low to 2 * low - 1."""
    pieces = -(-2 * low // 43)
    body = F.concat(*(F.base64(F.unhex(F.sha2(F.concat(text, F.lit(f"|{i}")), 256))) for i in range(pieces)))
    return F.substr(body, F.lit(1), F.lit(low) + F.pmod(whole(text), F.lit(low)).cast("int"))


def date_partitions(n: int, anchor: date) -> list[str]:
    """The n days before the anchor, newest first."""
    return [(anchor - timedelta(days=i + 1)).isoformat() for i in range(n)]


def record_key(ident: Column, round_no: int, ts: int | None = None) -> Column:
    """<uuid>-<round>, or <epoch millis>-<uuid>-<round> if ts is given."""
    stem = uuid_of(ident) if ts is None else F.concat(F.lit(f"{ts}-"), uuid_of(ident))
    return F.format_string("%s-%03d", stem, F.lit(round_no))
