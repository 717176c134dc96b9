"""Shared text rules: ASCII lower-casing and ASCII white space, on UTF-8 bytes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A-Z only; every other byte stays as it is
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lowered(data: bytes | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null is empty."""
    return (data or b"").translate(LOWER_AZ)


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` cuts at exactly those six bytes."""
    return lowered(data).split()


def as_bytes(column: Column | str) -> Column:
    """A string column as UTF-8 bytes: Python then sees the bytes and nothing is decoded twice."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def crc_mod(column: Column | str, parts: int = 5) -> Column:
    """``crc32(id as text) mod parts``; a null id counts as empty text, which is 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)
