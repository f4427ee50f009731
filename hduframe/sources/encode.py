"""Arrow columns to bytes of table rows and pixels, and the cards that describe them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from ..errors import InvalidTable
from .cards import Card, Header
from .tform import BITPIX, NUMPY, Ascii, Binary, bitpix


def _filled(col: pa.Array, zero) -> pa.Array:
    return pc.fill_null(col, zero) if col.null_count else col


def _flat(col: pa.Array, code: str) -> np.ndarray:
    """Elements of one code as big-endian numbers; nulls become 0, or NaN for floats."""
    if code in "CM":
        re, im = (_flat(col.field(k), "E" if code == "C" else "D") for k in (0, 1))
        out = np.empty(2 * len(re), re.dtype)  # stacking would give native byte order
        out[0::2], out[1::2] = re, im
        return out
    if code == "L":
        return np.where(_filled(col, False).to_numpy(zero_copy_only=False).astype(bool), ord("T"), ord("F")).astype(np.uint8)
    if pa.types.is_timestamp(col.type):
        col = col.cast(pa.timestamp("us", col.type.tz)).cast(pa.int64())
    values = _filled(col, float("nan") if code in "ED" else 0).to_numpy(zero_copy_only=False)
    kind = np.dtype(NUMPY[code])
    if kind.kind in "iu" and len(values):
        low, high = np.iinfo(kind).min, np.iinfo(kind).max
        if values.min() < low or values.max() > high:
            raise InvalidTable(f"values beyond the range of TFORM {code}")
    return values.astype(kind)


def _fixed(col: pa.Array, width: int, name: str, text: bool) -> np.ndarray:
    """Cells of one width: texts filled with blanks, bytes with zeros."""
    col = _filled(col, "" if text else b"")
    longest = pc.max(pc.binary_length(col)).as_py() or 0
    if longest > width:
        raise InvalidTable(f"a value of {name} is longer than {width} bytes")
    if text:  # counts bytes, as is wanted
        cells = pc.ascii_rpad(col, width)
        flat = np.frombuffer(b"".join(pc.cast(cells, pa.binary()).to_pylist()), np.uint8) if cells.offset else np.frombuffer(cells.buffers()[2] or b"", np.uint8)[: len(col) * width]
    else:
        raw, size = _bytes(col)
        flat = np.zeros(len(col) * width, np.uint8)
        into = np.repeat(np.arange(len(col)) * width - (np.cumsum(size) - size), size) + np.arange(len(raw))
        flat[into] = np.frombuffer(raw, np.uint8)
    return flat.reshape(len(col), width)


def _bytes(col: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all cells, texts as UTF-8, and the size of each; nulls are empty."""
    col = _filled(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None and len(col) else b"", np.diff(offsets)


def encode_rows(batch: pa.RecordBatch, forms: list[Binary], heap_base: int = 0) -> tuple[np.ndarray, bytes]:
    """The rows as a matrix of bytes, and what they add to the heap; descriptors count from heap_base."""
    n = batch.num_rows
    parts, heap, at = [], [], heap_base
    for name, col, f in zip(batch.schema.names, batch.columns, forms, strict=True):
        if f.of:
            if f.of in "AXB" and not pa.types.is_list(col.type):
                raw, size = _bytes(col)
                count = size * 8 if f.of == "X" else size
            else:
                col = _filled(col, []) if col.null_count else col
                count = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = _flat(col.flatten(), f.of)
                raw = flat.tobytes()
                size = count * (len(raw) // max(1, int(count.sum()))) if len(raw) else count * 0
            begin = at + np.cumsum(size) - size
            kind = NUMPY[f.code]
            if len(begin) and begin[-1] + size[-1] > np.iinfo(np.dtype(kind)).max:
                raise InvalidTable(f"the heap of {name} is too large for P descriptors; use Q")
            parts.append(np.stack([count, begin], 1).astype(kind).view(np.uint8).reshape(n, f.size))
            heap.append(raw)
            at += len(raw)
        elif f.code == "A":
            parts.append(_fixed(col, f.size, name, True))
        elif f.code == "X" or f.code == "B" and pa.types.is_binary(col.type):
            parts.append(_fixed(col, f.size, name, False))
        else:
            if pa.types.is_list(col.type):
                wrong = pc.any(pc.not_equal(pc.fill_null(pc.list_value_length(col), -1), f.repeat)).as_py()
                if wrong:
                    raise InvalidTable(f"a value of {name} doesn't have {f.repeat} elements")
                col = col.flatten()
            flat = _flat(col, f.code)
            parts.append(np.ascontiguousarray(flat).view(np.uint8).reshape(n, f.size))
    return np.concatenate(parts, 1) if parts else np.empty((n, 0), np.uint8), b"".join(heap)


def bintable_header(fields: list[T.StructField], forms: list[Binary], nrows: int, heap: int, extname: str | None = None, extra: list[Card] = ()) -> Header:
    """The mandatory cards first, then each column's; TSCAL, TZERO and TUNIT where the field's metadata have them."""
    h = Header([Card("XTENSION", "BINTABLE", "binary table"), Card("BITPIX", 8), Card("NAXIS", 2), Card("NAXIS1", sum(f.size for f in forms)), Card("NAXIS2", nrows), Card("PCOUNT", heap), Card("GCOUNT", 1), Card("TFIELDS", len(forms))])
    for k, (field, form) in enumerate(zip(fields, forms, strict=True), 1):
        h.push(Card(f"TTYPE{k}", field.name))
        h.push(Card(f"TFORM{k}", str(form)))
        _meta(h, k, field)
    return _end(h, extname, extra)


def _meta(h: Header, k: int, field: T.StructField) -> None:
    meta = field.metadata or {}
    if meta.get("tscal", 1.0) != 1.0:
        h.push(Card(f"TSCAL{k}", float(meta["tscal"])))
    if meta.get("tzero", 0.0) != 0.0:
        h.push(Card(f"TZERO{k}", float(meta["tzero"])))
    if meta.get("tunit"):
        h.push(Card(f"TUNIT{k}", meta["tunit"]))


def _end(h: Header, extname: str | None, extra: list[Card]) -> Header:
    if extname:
        h.push(Card("EXTNAME", extname))
    for c in extra:
        h.push(c)
    return h


def ascii_places(forms: list[Ascii]) -> list[int]:
    """TBCOL of each column: one blank between them."""
    out, at = [], 1
    for f in forms:
        out.append(at)
        at += f.width + 1
    return out


def ascii_header(fields: list[T.StructField], forms: list[Ascii], nrows: int, extname: str | None = None, extra: list[Card] = ()) -> Header:
    places = ascii_places(forms)
    width = places[-1] - 1 + forms[-1].width if forms else 0
    h = Header([Card("XTENSION", "TABLE", "ASCII table"), Card("BITPIX", 8), Card("NAXIS", 2), Card("NAXIS1", width), Card("NAXIS2", nrows), Card("PCOUNT", 0), Card("GCOUNT", 1), Card("TFIELDS", len(forms))])
    for k, (field, form, at) in enumerate(zip(fields, forms, places, strict=True), 1):
        h.push(Card(f"TTYPE{k}", field.name))
        h.push(Card(f"TBCOL{k}", at))
        h.push(Card(f"TFORM{k}", str(form)))
        _meta(h, k, field)
    return _end(h, extname, extra)


def _ascii_cell(v, f: Ascii, name: str) -> str:
    if v is None:
        text = ""
    elif f.code == "A":
        text = str(v)
    elif f.code == "I":
        text = str(int(v))
    elif f.code == "F":
        text = f"{v:.{f.decimals}f}"
    else:
        text = f"{v:.{f.decimals}E}".replace("E", f.code)
    if len(text.encode()) > f.width:
        raise InvalidTable(f"a value of {name} needs more than {f.width} characters")
    return text.ljust(f.width) if f.code == "A" else text.rjust(f.width)


def _fixed_point(v: np.ndarray, decimals: int) -> tuple[pa.Array, np.ndarray]:
    """Texts of numbers with so many decimals, correctly rounded; and which of them could not be made this way (large, odd, or
    so near the middle of two texts that the scaled value's rounding matters)."""
    with np.errstate(all="ignore"):
        p = np.abs(v) * 10.0**decimals
        near = np.abs(p - np.floor(p) - 0.5) <= p * 4e-16 + 1e-12
        odd = ~np.isfinite(p) | (p >= 2.0**52) | near
        digits = np.where(odd, 0, np.rint(p)).astype(np.int64)
    parts = [pa.array(np.where(np.signbit(v), "-", "")), pa.array(digits // 10**decimals).cast(pa.string())]
    if decimals:
        parts += [pa.scalar("."), pc.utf8_lpad(pa.array(digits % 10**decimals).cast(pa.string()), decimals, "0")]
    return pc.binary_join_element_wise(*parts, ""), odd


def _ascii_column(col: pa.Array, f: Ascii, name: str) -> pa.Array:
    """Cells of the form's width; whole columns at a time where that gives the same texts as one by one."""
    slow = None
    if f.code == "A" and pa.types.is_string(col.type):
        text = _filled(col, "")
    elif f.code == "I" and pa.types.is_integer(col.type):
        text = _filled(col.cast(pa.string()), "")
    elif f.code == "F" and pa.types.is_floating(col.type) and f.decimals < 16:
        text, odd = _fixed_point(_filled(col, 0.0).to_numpy(zero_copy_only=False).astype(np.float64), f.decimals)
        slow = odd | col.is_null().to_numpy(zero_copy_only=False)
    else:
        text, slow = pa.array([""] * len(col)), np.ones(len(col), bool)
    if slow is not None and slow.any():
        one_by_one = [_ascii_cell(col[k].as_py(), f, name) for k in np.flatnonzero(slow).tolist()]
        text = pc.replace_with_mask(text, pa.array(slow), pa.array(one_by_one, pa.string()))
    if (pc.max(pc.binary_length(text)).as_py() or 0) > f.width:
        raise InvalidTable(f"a value of {name} needs more than {f.width} characters")
    return pc.ascii_rpad(text, f.width) if f.code == "A" else pc.ascii_lpad(text, f.width)


def encode_ascii(batch: pa.RecordBatch, forms: list[Ascii]) -> bytes:
    cols = [_ascii_column(col, f, name) for name, col, f in zip(batch.schema.names, batch.columns, forms, strict=True)]
    return _bytes(pc.binary_join_element_wise(*cols, " "))[0]


def encode_pixels(values: np.ndarray, code: int) -> bytes:
    kind = np.dtype(bitpix(code)[0])
    if kind.kind in "iu" and len(values) and (values.min() < np.iinfo(kind).min or values.max() > np.iinfo(kind).max):
        raise InvalidTable(f"pixels beyond the range of BITPIX {code}")
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def image_header(code: int, axes: list[int], primary: bool, extname: str | None = None, extra: list[Card] = ()) -> Header:
    bitpix(code)
    first = [Card("SIMPLE", True, "conforms to FITS standard")] if primary else [Card("XTENSION", "IMAGE", "image extension")]
    h = Header([*first, Card("BITPIX", code), Card("NAXIS", len(axes)), *(Card(f"NAXIS{k}", n) for k, n in enumerate(axes, 1))])
    if primary:
        h.push(Card("EXTEND", True))
    else:
        h.push(Card("PCOUNT", 0))
        h.push(Card("GCOUNT", 1))
    return _end(h, extname, extra)


def empty_primary() -> Header:
    return Header([Card("SIMPLE", True, "conforms to FITS standard"), Card("BITPIX", 8), Card("NAXIS", 0), Card("EXTEND", True)])


BITPIX_OF = {T.ByteType: 16, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64, T.FloatType: -32, T.DoubleType: -64}
assert set(BITPIX_OF.values()) < set(BITPIX)
