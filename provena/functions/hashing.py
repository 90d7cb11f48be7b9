"""Hash columns: content ids, ranks and draws that every run repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column | str | int, sep: str = "|") -> Column:
    return F.concat_ws(sep, *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def sha_hex(*parts: Column | str | int, sep: str = "|") -> Column:
    return F.sha2(joined(*parts, sep=sep), 256)


def hash_number(*parts: Column | str | int) -> Column:
    """The first eight bytes of the SHA-256 of the joined parts, as an unsigned number: decimal(20,0)."""
    return F.conv(F.substring(sha_hex(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def unit_interval(*parts: Column | str | int) -> Column:
    return hash_number(*parts).cast("double") / F.lit(2.0**64)


def content_id(prefix: str, *parts: Column | str | int) -> Column:
    """A content address: the prefix and 24 hex digits."""
    return F.concat(F.lit(prefix), F.substring(sha_hex(*parts), 1, 24))
