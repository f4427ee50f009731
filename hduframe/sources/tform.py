"""TFORM and BITPIX codes, and the Spark, numpy and Arrow types that go with them."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from ..errors import InvalidTable, UnsupportedBitpix

#: Fixed values of the standard: bytes of an element by type code, and BITPIX with numpy and Spark types.
WIDTH = {"L": 1, "X": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}
NUMPY = {"L": "u1", "X": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "A": "u1", "E": ">f4", "D": ">f8", "C": ">f4", "M": ">f8", "P": ">i4", "Q": ">i8"}
BITPIX = {8: ("u1", T.ShortType()), 16: (">i2", T.ShortType()), 32: (">i4", T.IntegerType()), 64: (">i8", T.LongType()), -32: (">f4", T.FloatType()), -64: (">f8", T.DoubleType())}
SCALAR = {"L": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "E": T.FloatType(), "D": T.DoubleType()}
_BINARY = re.compile(r"\s*(\d*)([A-Z])(.*)\Z")
_ASCII = re.compile(r"\s*(?:([AI])(\d+)|([FED])(\d+)\.(\d+))\s*\Z")


def bitpix(code: int) -> tuple[str, T.DataType]:
    if code not in BITPIX:
        raise UnsupportedBitpix(str(code))
    return BITPIX[code]


@dataclass(frozen=True)
class Binary:
    """A column's form: repeat and code, or P/Q with the code of the heap's elements and their largest number."""

    repeat: int
    code: str
    of: str = ""
    most: int | None = None

    @property
    def size(self) -> int:
        if self.of:
            return WIDTH[self.code]
        return -(-self.repeat // 8) if self.code == "X" else self.repeat * WIDTH[self.code]

    def __str__(self) -> str:
        if self.of:
            return f"1{self.code}{self.of}" + (f"({self.most})" if self.most is not None else "")
        return f"{self.repeat}{self.code}"

    @property
    def spark(self) -> T.DataType:
        code = self.of or self.code
        if code == "A":
            return T.StringType()
        if code == "X":
            return T.BinaryType()
        if self.of and code == "B" or not self.of and code == "B" and self.repeat != 1:
            return T.BinaryType()
        if code in "CM":
            part = T.FloatType() if code == "C" else T.DoubleType()
            one: T.DataType = T.StructType([T.StructField("re", part), T.StructField("im", part)])
        else:
            one = SCALAR[code]
        return one if not self.of and self.repeat == 1 else T.ArrayType(one)


def parse_binary(text: str) -> Binary:
    m = _BINARY.match(text.strip().upper() if text else "")
    if not m or m[2] not in WIDTH:
        raise InvalidTable(f"TFORM {text!r}")
    repeat = int(m[1]) if m[1] else 1
    if m[2] in "PQ":
        of = m[3][:1]
        if of not in WIDTH or of in "PQ":
            raise InvalidTable(f"TFORM {text!r}")
        most = re.match(r".\((\d+)\)", m[3])
        return Binary(1, m[2], of, int(most[1]) if most else None)
    return Binary(repeat, m[2])


@dataclass(frozen=True)
class Ascii:
    code: str
    width: int
    decimals: int = 0

    def __str__(self) -> str:
        return f"{self.code}{self.width}" + (f".{self.decimals}" if self.code in "FED" else "")

    @property
    def spark(self) -> T.DataType:
        return {"A": T.StringType(), "I": T.LongType()}.get(self.code, T.DoubleType())


def parse_ascii(text: str) -> Ascii:
    m = _ASCII.match((text or "").upper())
    if not m:
        raise InvalidTable(f"TFORM {text!r}")
    return Ascii(m[1], int(m[2])) if m[1] else Ascii(m[3], int(m[4]), int(m[5]))


def for_spark(t: T.DataType, form: str | None = None) -> Binary:
    """The form in which a Spark column is written: the one named, else by its type."""
    if form:
        return parse_binary(form)
    codes = {T.BooleanType: "L", T.ByteType: "I", T.ShortType: "I", T.IntegerType: "J", T.LongType: "K", T.FloatType: "E", T.DoubleType: "D"}
    if type(t) in codes:
        return Binary(1, codes[type(t)])
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return Binary(1, "K")  # microseconds since 1970
    if isinstance(t, T.StringType):
        return Binary(1, "P", "A")
    if isinstance(t, T.BinaryType):
        return Binary(1, "P", "B")
    if isinstance(t, T.ArrayType) and type(t.elementType) in codes:
        return Binary(1, "P", codes[type(t.elementType)])
    if isinstance(t, T.StructType) and [f.name for f in t.fields] == ["re", "im"]:
        return Binary(1, "C" if isinstance(t.fields[0].dataType, T.FloatType) else "M")
    raise InvalidTable(f"a column of type {t.simpleString()} can't be written")


def unique_names(names: list[str]) -> list[str]:
    """TTYPE may be absent or come twice: col_1, name_2."""
    out: list[str] = []
    seen: set[str] = set()
    for k, n in enumerate(names, 1):
        base = n.strip() or f"col_{k}"
        name, j = base, 2
        while name.lower() in seen:
            name, j = f"{base}_{j}", j + 1
        seen.add(name.lower())
        out.append(name)
    return out


def arrow_type(t: T.DataType) -> pa.DataType:
    plain = {T.BooleanType: pa.bool_(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in t.fields])
    return plain[type(t)]


def native(code: str) -> np.dtype:
    return np.dtype(NUMPY[code]).newbyteorder("=")
