"""The 32-bit ones-complement checksum of FITS, as numpy kernels, as column expressions and as 16-character text.

Partial sums combine: a sum over a range that starts off a multiple of four is rotated right by eight bits for each byte, then
added.  So large data are summed range by range and the parts added up, in any order.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ChecksumMismatch
from ..session import ship
from ..sources.cards import Header

MOD = 0xFFFFFFFF
#: Characters that the text must not hold: between the digits and the capitals, and between these and the small letters.
_PUNCTUATION = set(b":;<=>?@[\\]^_`")


def fold(total: int) -> int:
    """Ones-complement of any sum of words: all ones stand for a multiple of 2**32 - 1 that isn't 0."""
    return (total - 1) % MOD + 1 if total else 0


def checksum(data: bytes, offset: int = 0) -> int:
    """Of bytes that start at this offset of what is summed; the tail counts as filled with zeros."""
    whole = len(data) & ~3
    total = int(np.frombuffer(data, ">u4", whole // 4).sum(dtype=np.uint64)) if whole else 0
    if whole < len(data):
        total += int.from_bytes(data[whole:].ljust(4, b"\0"), "big")
    return turned(fold(total), offset)


def turned(total: int, offset: int) -> int:
    """A sum of bytes, for where they start off a multiple of four."""
    turn = 8 * (offset % 4)
    return (total >> turn | total << (32 - turn)) & MOD if turn else total


class Checksum:
    """Adds up chunks of any length."""

    def __init__(self):
        self.total, self.length = 0, 0

    def update(self, data: bytes) -> "Checksum":
        self.total = combine(self.total, checksum(data, self.length))
        self.length += len(data)
        return self

    def finish(self) -> int:
        return self.total


def combine(a: int, b: int) -> int:
    return fold(a + b)


def encode(value: int, complement: bool = False) -> str:
    """16 letters and digits; with complement, those that make the whole HDU sum to all ones."""
    if complement:
        value = MOD - value
    columns = []
    for shift in (24, 16, 8, 0):
        byte = value >> shift & 0xFF
        four = [byte // 4 + 0x30 + (byte % 4 if k == 0 else 0) for k in range(4)]
        while any(c in _PUNCTUATION for c in four):
            for k in (0, 2):
                if four[k] in _PUNCTUATION or four[k + 1] in _PUNCTUATION:
                    four[k] += 1
                    four[k + 1] -= 1
        columns.append(four)
    text = bytes(columns[col][row] for row in range(4) for col in range(4))
    return (text[-1:] + text[:-1]).decode()


def decode(text: str, complement: bool = False) -> int:
    if len(text) < 16:
        raise ChecksumMismatch(f"a checksum text of {len(text)} characters")
    raw = text[1:16].encode() + text[:1].encode()
    total = sum(int.from_bytes(bytes(c - 0x30 for c in raw[k : k + 4]), "big") for k in range(0, 16, 4))
    value = fold(total) if total else 0
    return MOD - value if complement else value


def stamp(header: Header, datasum: int) -> Header:
    """Sets DATASUM and CHECKSUM so that header and data sum to all ones."""
    header.set("DATASUM", str(datasum), "data unit checksum")
    header.set("CHECKSUM", "0" * 16, "HDU checksum")
    header.set("CHECKSUM", encode(combine(checksum(header.to_bytes()), datasum), True))
    return header


def verify_hdu(header: bytes, datasum: int) -> bool:
    return combine(checksum(header), datasum) in (0, MOD)


def datasum_status(header: Header, actual: int) -> str:
    """absent, unchecked (no text, no number, or 0), ok or mismatch."""
    card = header.find("DATASUM")
    if card is None:
        return "absent"
    if not isinstance(card.value, str) or not card.value.strip().isdigit() or int(card.value) == 0:
        return "unchecked"
    return "ok" if int(card.value) == actual else "mismatch"


def require_datasum(header: Header, actual: int) -> None:
    if datasum_status(header, actual) == "mismatch":
        raise ChecksumMismatch(f"DATASUM {header.find('DATASUM').value}, data sum to {actual}")


# ---- column expressions -------------------------------------------------------------------------------------------


def fold_expr(total: Column) -> Column:
    return F.when(total == 0, F.lit(0).cast("long")).otherwise(F.pmod(total - 1, F.lit(MOD)) + 1)


def words_checksum(words: str | Column) -> Column:
    """Aggregate: the checksum of 32-bit words held as unsigned values of a bigint column."""
    return fold_expr(F.sum(words))


def combine_expr(partial: str | Column) -> Column:
    """Aggregate: partial checksums to one."""
    return fold_expr(F.sum(partial))


def decode_expr(text: str | Column) -> Column:
    """What a 16-character checksum text stands for, without complement."""
    t = F.col(text) if isinstance(text, str) else text
    turned = F.concat(F.substring(t, 2, 15), F.substring(t, 1, 1))
    byte = lambda k: (F.ascii(F.substring(turned, k + 1, 1)) - 0x30).cast("long")
    total = sum((byte(k) * (1 << (24 - 8 * (k % 4))) for k in range(1, 16)), byte(0) * (1 << 24))
    return fold_expr(total)


def encode_checksums(df: DataFrame, value: str, out: str, complement: bool = False) -> DataFrame:
    """Adds the text of a bigint column's values."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else encode(int(v), complement))

    return df.withColumn(out, text(F.col(value)))
