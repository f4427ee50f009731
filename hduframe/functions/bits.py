"""Bit arithmetic of the codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v: str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v


def zigzag(value: str | Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3; all 64 bits."""
    v = _col(value).cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(value: str | Column) -> Column:
    v = _col(value).cast("long")
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1)))


def sign_extend(value: str | Column, bits: int) -> Column:
    """The low bits as a signed number."""
    return F.shiftright(F.shiftleft(_col(value).cast("long"), 64 - bits), 64 - bits)


def unsigned_word(value: str | Column) -> Column:
    """A 32-bit integer's bits as a number of at least 0, as checksums add them up."""
    return _col(value).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def booleans(value: str | Column, n: int) -> Column:
    """The first n bits of a binary column (a bit array, TFORM X), the highest of each byte first."""
    digits = F.hex(_col(value))
    nibble = lambda i: F.conv(F.substring(digits, F.floor(i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftright", nibble(i), 3 - i % 4).bitwiseAND(F.lit(1)) == 1)
