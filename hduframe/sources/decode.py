"""Bytes of table rows and pixels to Arrow columns, by numpy views."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from ..errors import InvalidTable, MissingKeyword
from .cards import Header
from .layout import Hdu, Source
from .tform import BITPIX, NUMPY, WIDTH, Ascii, Binary, arrow_type, bitpix, parse_ascii, parse_binary, unique_names


@dataclass
class Column:
    name: str
    form: Binary | Ascii
    at: int
    unit: str | None
    scale: float
    zero: float
    null: int | None = None

    @property
    def scaled(self) -> bool:
        return (self.scale, self.zero) != (1.0, 0.0)

    def spark(self, scale: bool) -> T.StructField:
        t = self.form.spark
        if scale and self.scaled and isinstance(self.form, Binary) and (self.form.of or self.form.code) in "BIJKED":
            t = T.ArrayType(T.DoubleType()) if isinstance(t, T.ArrayType | T.BinaryType) else T.DoubleType()
        meta = {"tform": str(self.form), "tscal": self.scale, "tzero": self.zero} | ({"tunit": self.unit} if self.unit else {})
        return T.StructField(self.name, t, True, meta)


def columns(h: Header) -> list[Column]:
    """The columns of a table HDU; TFORM is mandatory, TTYPE isn't."""
    ascii_table = (h.get_string("XTENSION") or "").strip() == "TABLE"
    n = h.require_int("TFIELDS")
    names = unique_names([h.get_string(f"TTYPE{k}") or "" for k in range(1, n + 1)])
    out, at = [], 0
    for k, name in enumerate(names, 1):
        text = h.get_string(f"TFORM{k}")
        if text is None:
            raise MissingKeyword(f"TFORM{k}")
        form = parse_ascii(text) if ascii_table else parse_binary(text)
        if ascii_table:
            at = h.require_int(f"TBCOL{k}") - 1
        out.append(Column(name, form, at, h.get_string(f"TUNIT{k}"), h.get_float(f"TSCAL{k}", 1.0), h.get_float(f"TZERO{k}", 0.0), h.get_int(f"TNULL{k}")))
        if not ascii_table:
            at += form.size
    width = h.require_int("NAXIS1")
    if not ascii_table and at > width or ascii_table and any(c.at < 0 or c.at + c.form.width > width for c in out):
        raise InvalidTable(f"columns reach beyond rows of {width} bytes")
    return out


def table_schema(h: Header, scale: bool = False, row_index: bool = False) -> T.StructType:
    fields = [c.spark(scale) for c in columns(h)]
    return T.StructType(fields + ([T.StructField("_row_index", T.LongType(), False)] if row_index else []))


def heap_at(h: Header) -> int:
    """Where the heap begins in the data: THEAP, else right behind the rows."""
    return h.get_int("THEAP") or h.require_int("NAXIS1") * h.require_int("NAXIS2")


def _text(data: bytes | np.ndarray, ends: np.ndarray, n: int) -> pa.Array:
    """Texts that lie one behind the other, without a copy."""
    offsets = np.zeros(n + 1, np.int32)
    offsets[1:] = ends
    text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    try:
        text.validate(full=True)
    except pa.ArrowInvalid as e:
        raise InvalidTable("a text cell isn't UTF-8") from e
    return text


def _strings(raw: np.ndarray) -> pa.Array:
    """Rows of bytes, right-trimmed."""
    n, w = raw.shape
    return pc.utf8_rtrim_whitespace(_text(np.ascontiguousarray(raw), w * np.arange(1, n + 1), n))


def _lists(values: pa.Array, n: int, each: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), values)


def _values(flat: np.ndarray, code: str) -> pa.Array:
    """Elements of one code; flat is of the code's big-endian numpy type."""
    if code == "L":
        return pa.array(flat == ord("T"))
    if code == "B":
        return pa.array(flat.astype(np.int16))
    own = flat.astype(flat.dtype.newbyteorder("="))
    if code in "CM":
        return pa.StructArray.from_arrays([pa.array(own[0::2]), pa.array(own[1::2])], names=["re", "im"])
    return pa.array(own)


def _raw(rows: np.ndarray, at: int, form: Binary) -> np.ndarray:
    part = np.ascontiguousarray(rows[:, at : at + form.size])
    return part.reshape(-1).view(NUMPY[form.code]) if form.code not in "XA" else part


def _scaled(flat: np.ndarray, c: Column) -> pa.Array:
    value = c.zero + c.scale * flat.astype(np.float64)
    if c.null is not None and flat.dtype.kind in "iu":
        return pa.array(value, mask=flat == c.null)
    return pa.array(value)


def decode_rows(rows: np.ndarray, cols: list[Column], heap: Heap | None, scale: bool, null_logical: bool = False) -> list[pa.Array]:
    """rows: a matrix of bytes, a row of the table in each.  null_logical: logical bytes of 0 are null instead of false."""
    n, out = len(rows), []
    for c in cols:
        f = c.form
        if f.of:
            out.append(_variable(_raw(rows, c.at, f).reshape(n, 2).astype(np.int64), c, heap, scale))
        elif f.code == "A":
            out.append(_strings(_raw(rows, c.at, f)))
        elif f.code == "X" or f.code == "B" and f.repeat != 1 and not (scale and c.scaled):
            part = np.ascontiguousarray(rows[:, c.at : c.at + f.size]).tobytes()
            offsets = (np.arange(n + 1) * f.size).astype(np.int32)
            out.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(part)]))
        else:
            flat = _raw(rows, c.at, f)
            values = _scaled(flat, c) if scale and c.scaled and f.code in "BIJKED" else _values(flat, f.code)
            if f.code == "L" and null_logical:
                values = pa.array(flat == ord("T"), mask=flat == 0)
            out.append(values if f.repeat == 1 else _lists(values, n, f.repeat))
    return out


class Heap:
    """The heap of a table, read in the ranges that a batch needs."""

    def __init__(self, source: Source, at: int, size: int):
        self.source, self.at, self.size = source, at, size

    def ranges(self, begin: np.ndarray, size: np.ndarray) -> bytes:
        """The bytes of all ranges in a row; one read if they lie close together."""
        some = size > 0
        if not some.any():
            return b""
        low, high = int(begin[some].min()), int((begin + size)[some].max())
        if low < 0 or high > self.size:
            raise InvalidTable("a descriptor points outside the heap")
        if high - low <= 4 * int(size.sum()) + (1 << 20):
            raw = self.source.read(self.at + low, high - low)
            if len(raw) < high - low:
                raise InvalidTable("the heap is truncated")
            if np.array_equal(begin[some][1:], (begin + size)[some][:-1]):
                return raw
            return b"".join(raw[b - low : b - low + s] for b, s in zip(begin.tolist(), size.tolist(), strict=True))
        return b"".join(self.source.read(self.at + b, s) if s else b"" for b, s in zip(begin.tolist(), size.tolist(), strict=True))


def _variable(pairs: np.ndarray, c: Column, heap: Heap | None, scale: bool) -> pa.Array:
    count, begin, code = pairs[:, 0], pairs[:, 1], c.form.of
    if (count < 0).any() or (begin < 0).any():
        raise InvalidTable(f"a negative descriptor in {c.name}")
    size = -(-count // 8) if code == "X" else count * WIDTH[code]
    raw = heap.ranges(begin, size) if heap else b""
    if code in "XAB" and not (code == "B" and scale and c.scaled):
        if code == "A":
            return _text(raw, np.cumsum(size), len(size))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    flat = np.frombuffer(raw, NUMPY[code])
    values = _scaled(flat, c) if scale and c.scaled and code in "BIJKED" else _values(flat, code)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values)


def decode_ascii(rows: np.ndarray, cols: list[Column]) -> list[pa.Array]:
    out = []
    for c in cols:
        text = _strings(rows[:, c.at : c.at + c.form.width])
        if c.form.code == "A":
            out.append(text)
            continue
        text = pc.utf8_ltrim_whitespace(text)
        try:
            if c.form.code == "I":
                value = pc.replace_substring_regex(text, r"^\+", "").cast(pa.int64())
                out.append(value if not c.scaled else pa.array(np.trunc(c.zero + c.scale * value.to_numpy().astype(np.float64)).astype(np.int64)))
            else:
                plain = pc.replace_substring_regex(pc.replace_substring(pc.replace_substring(text, "D", "E"), "d", "e"), r"^\+", "")
                out.append(pa.array(c.zero + c.scale * plain.cast(pa.float64()).to_numpy()))
        except pa.ArrowInvalid as e:
            raise InvalidTable(f"no number in column {c.name}: {e}") from e
    return out


def read_table(source: Source, hdu: Hdu, first: int, last: int, schema: T.StructType, scale: bool, null_logical: bool = False, batch_bytes: int = 1 << 22):
    """Record batches of rows first to last - 1 with the schema's columns, of about batch_bytes with their cells in the heap; others aren't decoded."""
    h = hdu.header
    width = h.require_int("NAXIS1")
    wanted = {f.name: k for k, f in enumerate(schema.fields)}
    cols = [c for c in columns(h) if c.name in wanted]
    heap = Heap(source, hdu.data_offset + heap_at(h), hdu.data_bytes - heap_at(h)) if hdu.kind == "bintable" else None
    types = [arrow_type(f.dataType) for f in schema.fields]
    each = max(1, batch_bytes // max(1, width, hdu.data_bytes // max(1, h.require_int("NAXIS2"))))
    for a in range(first, last, each):
        n = min(each, last - a)
        raw = source.read(hdu.data_offset + a * width, n * width)
        if len(raw) < n * width:
            raise InvalidTable("the table is truncated")
        rows = np.frombuffer(raw, np.uint8).reshape(n, width)
        arrays = decode_ascii(rows, cols) if hdu.kind == "table" else decode_rows(rows, cols, heap, scale, null_logical)
        got = dict(zip((c.name for c in cols), arrays, strict=True))
        if "_row_index" in wanted:
            got["_row_index"] = pa.array(np.arange(a, a + n))
        yield pa.RecordBatch.from_arrays([got[f.name].cast(t) if got[f.name].type != t else got[f.name] for f, t in zip(schema.fields, types, strict=True)], names=list(wanted))


def pixels(raw: bytes, code: int) -> np.ndarray:
    """Native numbers; BITPIX 8 as 16 bits, since Spark's bytes have a sign."""
    a = np.frombuffer(raw, bitpix(code)[0])
    return a.astype(np.int16) if code == 8 else a.astype(a.dtype.newbyteorder("="))


AXES = ("x", "y", "z")


def image_schema(h: Header, mode: str) -> T.StructType:
    """rows: a line along axis 1 each, with its place on the other axes (from 1); pixels: one each, from 1 too."""
    n = h.require_int("NAXIS")
    names = list(AXES[:n]) if n <= 3 else [f"axis{k}" for k in range(1, n + 1)]
    one = BITPIX[h.require_int("BITPIX")][1]
    long = T.LongType()
    if mode == "rows":
        return T.StructType([T.StructField("hdu_index", T.IntegerType()), T.StructField("row_index", long), *(T.StructField(x, long) for x in names[1:]), T.StructField("values", T.ArrayType(one))])
    return T.StructType([T.StructField("hdu_index", T.IntegerType()), T.StructField("pixel_index", long), *(T.StructField(x, long) for x in names), T.StructField("value", one)])


def read_image(source: Source, hdu: Hdu, first: int, last: int, schema: T.StructType, mode: str, batch_bytes: int = 1 << 23):
    """Record batches of lines along axis 1, or of single pixels in the mode pixels, first to last - 1."""
    h, axes = hdu.header, hdu.axes
    code, line = h.require_int("BITPIX"), axes[0] if mode == "rows" else 1
    width = abs(code) // 8
    skip = h.get_int("PCOUNT", 0) * width if not hdu.index else 0
    each = max(1, batch_bytes // max(1, line * width))
    types = [arrow_type(f.dataType) for f in schema.fields]
    names = [f.name for f in schema.fields]
    every = list(AXES[: len(axes)]) if len(axes) <= 3 else [f"axis{k}" for k in range(1, len(axes) + 1)]
    for a in range(first, last, each):
        n = min(each, last - a)
        raw = source.read(hdu.data_offset + skip + a * line * width, n * line * width)
        flat = pixels(raw, code)
        rest = np.arange(a, a + n)
        got: dict[str, pa.Array] = {"hdu_index": pa.array(np.full(n, hdu.index, np.int32))}
        if mode == "pixels":
            got["pixel_index"], got["value"] = pa.array(rest), pa.array(flat)
        else:
            got["row_index"], got["values"] = pa.array(rest), _lists(pa.array(flat), n, line)
        for k, x in enumerate(every):
            if k or mode == "pixels":
                if x in names:
                    got[x] = pa.array(rest % axes[k] + 1)
                rest = rest // axes[k]
        yield pa.RecordBatch.from_arrays([got[f.name].cast(t) for f, t in zip(schema.fields, types, strict=True)], names=names)
