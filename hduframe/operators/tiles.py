"""Tile-compressed images: geometry as column expressions, decoding and encoding of tiles, reading and writing images.

A compressed image is a binary table with a row for each tile.  Tiles are independent, so decoding is a map over rows.  Writing
cuts image lines into the tiles' pieces and groups them by tile, one shuffle, whose groups are as large as a tile; tiles
that are whole lines need none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompressionError, MissingKeyword, UnsupportedCompression
from ..session import ship
from ..sources.cards import Card, Header
from ..sources.decode import columns, read_table
from ..sources.encode import encode_pixels
from ..sources.layout import Hdu, Source, files, find, index
from ..sources.tform import BITPIX, arrow_type, bitpix
from . import quantize as quant
from .codecs import gz, hcompress, plio, rice

CODECS = {"RICE_1": "RICE_1", "RICE_ONE": "RICE_1", "GZIP_1": "GZIP_1", "GZIP_2": "GZIP_2", "PLIO_1": "PLIO_1", "HCOMPRESS_1": "HCOMPRESS_1", "NOCOMPRESS": "NOCOMPRESS"}
#: So many tiles, and pixels unless one tile has more, are decoded or encoded at a time; bytes of tiles that are read at a time.
MANY, PIXELS, READ = 1 << 13, 1 << 18, 1 << 22
METHODS = {"": quant.NONE, "NONE": quant.NONE, "NO_DITHER": quant.NONE, "SUBTRACTIVE_DITHER_1": quant.DITHER_1, "SUBTRACTIVE_DITHER_2": quant.DITHER_2}


def whole(a: Column, b: Column | int) -> Column:
    """a divided by b, for whole numbers of at least 0."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def codec_named(text: str) -> str:
    name = text.strip().upper()
    if name not in CODECS:
        raise UnsupportedCompression(f"ZCMPTYPE {text!r}")
    return CODECS[name]


def method_named(text: str | None) -> str:
    name = (text or "").strip().upper()
    if name not in METHODS:
        raise UnsupportedCompression(f"ZQUANTIZ {text!r}")
    return METHODS[name]


@dataclass(frozen=True)
class Geometry:
    axes: tuple[int, ...]
    tile: tuple[int, ...]

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-n // t) for n, t in zip(self.axes, self.tile, strict=True))

    @property
    def n_tiles(self) -> int:
        return int(np.prod(self.counts, dtype=object)) if self.axes else 0

    def coords(self, k: int) -> list[int]:
        """Of tile k on each axis, axis 1 the fastest."""
        out = []
        for c in self.counts:
            out.append(k % c)
            k //= c
        return out

    def origin(self, k: int) -> list[int]:
        return [c * t for c, t in zip(self.coords(k), self.tile, strict=True)]

    def dims(self, k: int) -> list[int]:
        return [min(t, n - o) for t, n, o in zip(self.tile, self.axes, self.origin(k), strict=True)]

    def places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Origins and dims of tiles, a row for each."""
        origin = np.empty((len(k), len(self.axes)), np.int64)
        for j, (c, t) in enumerate(zip(self.counts, self.tile, strict=True)):
            origin[:, j] = k % c * t
            k = k // c
        return origin, np.minimum(np.array(self.tile, np.int64), np.array(self.axes, np.int64) - origin)

    @property
    def at_once(self) -> int:
        """Tiles that are dealt with at a time."""
        return min(MANY, max(1, PIXELS // max(1, int(np.prod([min(t, n) for t, n in zip(self.tile, self.axes, strict=True)], dtype=object)))))

    # the same as column expressions

    def coord_exprs(self, k: Column) -> list[Column]:
        out, rest = [], k
        for c in self.counts:
            out.append((rest % c).cast("long"))
            rest = whole(rest, c)
        return out

    def origin_exprs(self, k: Column) -> list[Column]:
        return [c * t for c, t in zip(self.coord_exprs(k), self.tile, strict=True)]

    def dims_exprs(self, k: Column) -> list[Column]:
        return [F.least(F.lit(t).cast("long"), F.lit(n).cast("long") - o) for t, n, o in zip(self.tile, self.axes, self.origin_exprs(k), strict=True)]

    def pixel_expr(self, k: Column, pos: Column) -> Column:
        """The index in the image of a tile's pixel number pos: where a tile's values go, without building the image."""
        out, rest, stride = F.lit(0).cast("long"), pos, 1
        for o, d, n in zip(self.origin_exprs(k), self.dims_exprs(k), self.axes, strict=True):
            out = out + (o + rest % d) * F.lit(stride).cast("long")
            rest = whole(rest, d)
            stride *= n
        return out


def grid(spark: SparkSession, g: Geometry) -> DataFrame:
    """A row for each tile: tile_index, coords, origin, dims."""
    k = F.col("id")
    return spark.range(g.n_tiles).select(k.alias("tile_index"), F.array(*g.coord_exprs(k)).alias("coords"), F.array(*g.origin_exprs(k)).alias("origin"), F.array(*g.dims_exprs(k)).alias("dims"))


@dataclass(frozen=True)
class Options:
    """What a compressed image's header says."""

    codec: str
    bitpix: int
    geometry: Geometry
    method: str = quant.NONE
    seed: int = 1
    blank: int | None = None
    block: int = 32
    bytepix: int = 4
    smooth: int = 0
    scale: float | None = None  # ZSCALE and ZZERO as keywords
    zero: float | None = None

    @property
    def integers(self) -> bool:
        return self.bitpix > 0


def options_of(h: Header) -> Options:
    codec = h.get_string("ZCMPTYPE")
    if codec is None:
        raise MissingKeyword("ZCMPTYPE")
    code, n = h.require_int("ZBITPIX"), h.require_int("ZNAXIS")
    bitpix(code)
    axes = tuple(h.require_int(f"ZNAXIS{k}") for k in range(1, n + 1))
    tile = tuple(h.get_int(f"ZTILE{k}", axes[0] if k == 1 else 1) for k in range(1, n + 1))
    named = {}
    k = 1
    while (name := h.get_string(f"ZNAME{k}")) is not None:
        named[name.strip().upper()] = h.get_float(f"ZVAL{k}")
        k += 1
    get = lambda name, default: default if named.get(name) is None else int(named[name])
    return Options(codec_named(codec), code, Geometry(axes, tile), method_named(h.get_string("ZQUANTIZ")), h.get_int("ZDITHER0", 1), h.get_int("ZBLANK"), get("BLOCKSIZE", 32), get("BYTEPIX", 4), get("SMOOTH", 0), h.get_float("ZSCALE"), h.get_float("ZZERO"))


def read_tiles(source: Source, hdu: Hdu, path: str, first: int, last: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of the mode ``tiles``: payload (COMPRESSED_DATA as bytes, GZIP fallback), words (as 16-bit numbers), raw (UNCOMPRESSED_DATA)."""
    cols = {c.name.upper(): c for c in columns(hdu.header)}
    names = ["COMPRESSED_DATA", "GZIP_COMPRESSED_DATA", "UNCOMPRESSED_DATA", "ZSCALE", "ZZERO", "ZBLANK"]
    have = [n for n in names if n in cols]
    wanted = T.StructType([cols[n].spark(False) for n in have])
    at = first
    for batch in read_table(source, hdu, first, last, wanted, False, batch_bytes=READ):
        n = batch.num_rows
        got = dict(zip(have, batch.columns, strict=True))
        payload, words, raw = pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int16())), pa.nulls(n, pa.binary())
        empty = np.ones(n, bool)
        if "COMPRESSED_DATA" in got:
            main = got["COMPRESSED_DATA"]
            if cols["COMPRESSED_DATA"].form.of == "I":
                words, size = main.cast(words.type), pc.list_value_length(main)
            else:
                payload, size = main.cast(payload.type), pc.binary_length(main)
            empty = size.to_numpy(zero_copy_only=False) == 0
        # a tile that isn't in COMPRESSED_DATA lies in one of the other columns; gzipped ones are inflated here
        if "UNCOMPRESSED_DATA" in got or "GZIP_COMPRESSED_DATA" in got:
            own = [None] * n
            if "UNCOMPRESSED_DATA" in got:
                code = cols["UNCOMPRESSED_DATA"].form.of
                kind = {"B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}[code]
                own = [bytes(x) if isinstance(x, bytes) else np.array(x or [], np.dtype(kind)).tobytes() for x in got["UNCOMPRESSED_DATA"].to_pylist()]
            if "GZIP_COMPRESSED_DATA" in got:
                for k in np.flatnonzero(empty).tolist():
                    if zipped := got["GZIP_COMPRESSED_DATA"][k].as_py():
                        own[k] = gz.inflate(zipped)
            raw = pa.array(own, pa.binary())
        own = {
            "path": pa.array([path] * n), "hdu_index": pa.array(np.full(n, hdu.index, np.int32)), "tile_index": pa.array(np.arange(at, at + n)),
            "payload": payload, "words": words, "raw": raw,
            "zscale": got["ZSCALE"].cast(pa.float64()) if "ZSCALE" in got else pa.nulls(n, pa.float64()), "zzero": got["ZZERO"].cast(pa.float64()) if "ZZERO" in got else pa.nulls(n, pa.float64()), "zblank": got["ZBLANK"].cast(pa.int32()) if "ZBLANK" in got else pa.nulls(n, pa.int32()),
        }
        at += n
        yield pa.RecordBatch.from_arrays([own[f.name] for f in schema.fields], names=schema.names)


def of_one_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each size."""
    for n in np.unique(sizes).tolist():
        yield np.flatnonzero(sizes == n)


def decode_tiles(o: Options, index: list[int], payload: list, words: list, raw: list, zscale: list, zzero: list, zblank: list) -> list[np.ndarray]:
    """Pixels of tiles, as the image's numbers."""
    sizes = o.geometry.places(np.array(index, np.int64))[1].prod(1).tolist()
    out: list[np.ndarray | None] = [None] * len(index)
    scale = [s if s is not None else o.scale for s in zscale]
    zero = [z if z is not None else o.zero for z in zzero]
    kind = np.dtype(bitpix(o.bitpix)[0])
    own = kind.newbyteorder("=")
    coded = []
    for k, n in enumerate(sizes):
        held = payload[k] or words[k] is not None and len(words[k])
        if not n:
            out[k] = np.empty(0, own)
        elif held:
            if not o.integers and (scale[k] is None or zero[k] is None or scale[k] == 0):
                out[k] = _floats(o, payload[k], kind)
            else:
                coded.append(k)
        elif raw[k]:
            out[k] = np.frombuffer(raw[k], kind).astype(own)
        else:
            raise CompressionError(f"tile {index[k]} has no data")
        if out[k] is not None and len(out[k]) != n:
            raise CompressionError(f"tile {index[k]} has {len(out[k])} pixels, not {n}")
    if not coded:
        return out
    ints = _integers(o, [payload[k] for k in coded], [words[k] for k in coded], [sizes[k] for k in coded])
    if o.integers:
        for k, q in zip(coded, ints, strict=True):
            out[k] = q.astype(own)
        return out
    blank = [zblank[k] if zblank[k] is not None else o.blank for k in coded]
    none = np.array([b is None for b in blank])
    for same in of_one_size(np.array([len(q) for q in ints]) * 2 + none):  # tiles of one size, with a number for NaN or without
        own_tiles, at = [coded[i] for i in same.tolist()], [ints[i] for i in same.tolist()]
        q = np.concatenate(at).reshape(len(at), -1)
        nan = None if none[same[0]] else np.array([blank[i] for i in same.tolist()], np.int64)
        of = lambda values, own_tiles=own_tiles: np.array([values[k] for k in own_tiles])
        values = quant.unquantize_many(q, of(scale), of(zero), o.method, of(index), o.seed, nan).astype(own)
        for k, v in zip(own_tiles, values, strict=True):
            out[k] = v
    return out


def _floats(o: Options, payload: bytes, kind: np.dtype) -> np.ndarray:
    if o.codec not in ("GZIP_1", "GZIP_2", "NOCOMPRESS"):
        raise UnsupportedCompression(f"{o.codec} of floats that aren't quantized")
    raw = payload if o.codec == "NOCOMPRESS" else gz.decode(payload, kind.itemsize, o.codec == "GZIP_2")
    return np.frombuffer(raw, kind).astype(kind.newbyteorder("="))


def _integers(o: Options, payload: list, words: list, sizes: list[int]) -> list[np.ndarray]:
    if o.codec == "PLIO_1":
        if not o.integers:
            raise UnsupportedCompression("PLIO_1 of floats")
        return [plio.decode(np.array(w if w is not None else np.frombuffer(p, ">i2"), np.int64), n) for w, p, n in zip(words, payload, sizes, strict=True)]
    if o.codec == "RICE_1":
        return rice.decode(payload, sizes, o.bytepix, o.block)
    if o.codec == "HCOMPRESS_1":
        return hcompress.decode_many(payload, sizes, o.bitpix if o.integers else 32, o.smooth)
    width = abs(o.bitpix) // 8 if o.integers else 4  # quantized pixels have 32 bits
    kind = {1: "u1", 2: ">i2", 4: ">i4", 8: ">i8"}[width]
    out = []
    for p, n in zip(payload, sizes, strict=True):
        raw = p if o.codec == "NOCOMPRESS" else gz.decode(p, width, o.codec == "GZIP_2")
        if len(raw) != n * width:
            raise CompressionError(f"a tile of {len(raw)} bytes for {n} pixels")
        out.append(np.frombuffer(raw, kind).astype(np.int64))
    return out


def decompress(tiles: DataFrame, o: Options, by_file: bool = False) -> DataFrame:
    """path, hdu_index, tile_index, origin, dims, axes (from 0) and values of each tile; a map without a shuffle.

    o is what the header says; by_file: each file's header is read where its tiles are decoded, and o only gives the values' type."""
    one = BITPIX[o.bitpix][1]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("hdu_index", T.IntegerType()), T.StructField("tile_index", T.LongType()), T.StructField("origin", T.ArrayType(T.LongType())), T.StructField("dims", T.ArrayType(T.LongType())), T.StructField("axes", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(one))])
    element = arrow_type(one)
    names = ["path", "hdu_index", "tile_index", "payload", "words", "raw", "zscale", "zzero", "zblank"]

    def of_file(path: str, hdu: int, known: dict) -> Options:
        if (path, hdu) not in known:
            known.clear()  # a task's tiles come file by file
            known[path, hdu], _ = compressed_options(path, hdu)
            if known[path, hdu].bitpix != o.bitpix:
                raise UnsupportedCompression(f"{path} has ZBITPIX {known[path, hdu].bitpix}, other files {o.bitpix}")
        return known[path, hdu]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in _of_one_image(batch):
                own = of_file(part.column("path")[0].as_py(), part.column("hdu_index")[0].as_py(), known) if by_file else o
                part = part.filter(pc.less(part.column("tile_index"), own.geometry.n_tiles))  # rows beyond the grid are no tiles
                for at in range(0, part.num_rows, own.geometry.at_once):
                    yield decoded(own, part.slice(at, own.geometry.at_once))

    def decoded(own: Options, part: pa.RecordBatch) -> pa.RecordBatch:
        c = {n: part.column(n).to_pylist() for n in ("payload", "raw", "zscale", "zzero", "zblank")}
        k, n, g = part.column("tile_index").to_numpy(), part.num_rows, own.geometry
        values = decode_tiles(own, k.tolist(), c["payload"], _cells(part.column("words")), c["raw"], c["zscale"], c["zzero"], c["zblank"])
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        each = lambda rows: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(g.axes)), pa.array(rows.reshape(-1)))
        places = [each(x) for x in (*g.places(k), np.tile(np.array(g.axes, np.int64), n))]
        return pa.RecordBatch.from_arrays([*(part.column(x) for x in ("path", "hdu_index", "tile_index")), *places, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)).cast(element))], names=schema.names)

    ship(tiles.sparkSession)
    return tiles.select(*names).mapInArrow(run, schema)


def _cells(lists: pa.Array) -> list[np.ndarray | None]:
    """Lists of numbers as views, without an object for each number."""
    if lists.null_count == len(lists):
        return [None] * len(lists)
    flat, ends, there = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().tolist(), lists.is_valid().to_pylist()
    return [flat[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], there, strict=True)]


def _of_one_image(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that are of one file and HDU each."""
    n, new = batch.num_rows, np.zeros(max(0, batch.num_rows - 1), bool)
    for name in ("path", "hdu_index"):
        if n > 1:
            col = batch.column(name)
            new |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), n] if n else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def compressed_options(path: str, hdu: int | None = None, extname: str | None = None) -> tuple[Options, int]:
    """The options and the HDU's number, from the header of a file, or the first of a folder."""
    found = files(path)
    if not found:
        raise UnsupportedCompression(f"no files in {path}")
    source = Source(found[0])
    h = next((x for x in index(source) if x.zimage), None) if hdu is None and extname is None else find(source, hdu, extname)
    if h is None or not h.zimage:
        raise UnsupportedCompression(f"no compressed image in {path}")
    o = options_of(h.header)
    if h.header.require_int("NAXIS2") < o.geometry.n_tiles:
        raise CompressionError("fewer rows than tiles")
    return o, h.index


def read_compressed(spark: SparkSession, path: str, hdu: int | None = None, extname: str | None = None) -> DataFrame:
    """The decoded tiles of a compressed image, or of the images of all files of a folder (with hdu or extname that one of each, else each file's
    first compressed image); files may differ in all but ZBITPIX."""
    from ..sources.fits_source import read

    o, _ = compressed_options(path, hdu, extname)
    which = {"hdu": hdu} if hdu is not None else {"extname": extname} if extname is not None else {}
    return decompress(read(spark, path, mode="tiles", **which), o, by_file=True)


def tile_pixels(tiles: DataFrame, g: Geometry | None = None) -> DataFrame:
    """pixel_index and value of all pixels, from decoded tiles; a map as well.  Without g the tiles' own places are taken, so that
    images may differ, and their path is kept."""
    if g:
        each = tiles.select("tile_index", F.posexplode("values").alias("pos", "value"))
        return each.select(g.pixel_expr(F.col("tile_index"), F.col("pos").cast("long")).alias("pixel_index"), "value")
    each = tiles.select("path", "origin", "dims", "axes", F.posexplode("values").alias("pos", "value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.col("pos").cast("long").alias("rest"), F.lit(1).cast("long").alias("stride"))
    step = lambda a, p: F.struct((a["at"] + (p["origin"] + a["rest"] % p["dims"]) * a["stride"]).alias("at"), whole(a["rest"], p["dims"]).alias("rest"), (a["stride"] * p["axes"]).alias("stride"))
    return each.select("path", F.aggregate(F.arrays_zip("origin", "dims", "axes"), start, step)["at"].alias("pixel_index"), "value")


def cut(rows: DataFrame, g: Geometry) -> DataFrame:
    """Image lines (row_index from 0, values) as tiles (tile_index, values)."""
    width, counts = g.tile[0], g.counts
    rest, outer, pos = F.col("row_index"), F.lit(0).cast("long"), F.lit(0).cast("long")
    # the tile on the outer axes and the line's place in it
    tile_stride, place = counts[0], F.lit(1).cast("long")
    for n, t, c in zip(g.axes[1:], g.tile[1:], counts[1:], strict=True):
        x = rest % n
        rest = whole(rest, n)
        inside = x % t
        k = whole(x, t)
        outer = outer + k * F.lit(tile_stride).cast("long")
        pos = pos + inside * place
        place = place * F.least(F.lit(t).cast("long"), F.lit(n).cast("long") - k * t)
        tile_stride *= c
    lines = rows.select(outer.alias("outer"), pos.alias("pos"), "values")
    if all(t == 1 for t in g.tile[1:]) and width >= g.axes[0]:
        return lines.select(F.col("outer").alias("tile_index"), "values")
    pieces = lines.select("outer", "pos", F.explode(F.transform(F.sequence(F.lit(0), F.lit(counts[0] - 1)), lambda k: F.struct(k.alias("k"), F.slice("values", k * width + 1, F.lit(width)).alias("piece")))).alias("p"))
    grouped = pieces.groupBy((F.col("outer") + F.col("p.k")).alias("tile_index")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("p.piece").alias("piece")))).alias("pieces"))
    return grouped.select("tile_index", F.flatten("pieces.piece").alias("values"))


@dataclass(frozen=True)
class Compress:
    """How to write: quantize None keeps floats as they are (GZIP_1 only)."""

    algorithm: str = "RICE_1"
    tile: tuple[int, ...] | None = None
    quantize: float | None = 4.0
    method: str = quant.DITHER_1
    seed: int = 1
    block: int = 32


def check(c: Compress, code: int, axes: tuple[int, ...]) -> Options:
    codec = codec_named(c.algorithm)
    if codec not in ("RICE_1", "GZIP_1", "GZIP_2"):
        raise UnsupportedCompression(f"{codec} isn't written")
    if code == 64:
        raise UnsupportedCompression("64-bit integers aren't compressed")
    if code < 0 and c.quantize is None and codec != "GZIP_1":
        raise UnsupportedCompression("floats that aren't quantized are written with GZIP_1 only")
    if not axes or min(axes) < 1:
        raise CompressionError("an image without pixels")
    tile = c.tile or (axes[0], *(1 for _ in axes[1:]))
    if len(tile) != len(axes) or min(tile) < 1:
        raise CompressionError(f"tiles of {len(tile)} axes for an image of {len(axes)}")
    tile = tuple(min(t, n) for t, n in zip(tile, axes, strict=True))
    width = abs(code) // 8 if code > 0 else 4
    return Options(codec, code, Geometry(tuple(axes), tile), method_named(c.method) if code < 0 and c.quantize is not None else quant.NONE, c.seed, quant.NULL if code < 0 and c.quantize is not None else None, c.block, width)


def encode_integers(o: Options, tiles: list[np.ndarray], width: int) -> list[bytes]:
    if o.codec == "RICE_1":
        return rice.encode(tiles, width, o.block)
    code = {1: 8, 2: 16, 4: 32}[width]
    return [gz.encode(encode_pixels(t, code), width, o.codec == "GZIP_2") for t in tiles]


def encode_values(o: Options, q: float | None, index: list[int], values: list[np.ndarray]) -> tuple[list[bytes], list[tuple[float, float]]]:
    """The payloads of tiles and, for quantized floats, their scales and zeros."""
    if o.integers:
        return encode_integers(o, values, abs(o.bitpix) // 8), []
    if q is None:
        return [gz.encode(encode_pixels(v, o.bitpix), abs(o.bitpix) // 8, False) for v in values], []
    scales, zeros, ints, tiles = np.ones(len(values)), np.zeros(len(values)), list(values), np.array(index, np.int64)
    for same in of_one_size(np.array([len(v) for v in values], np.int64)):
        v = np.concatenate([values[k] for k in same.tolist()]).reshape(len(same), -1)
        scales[same], zeros[same] = quant.scale_zero_many(v, q)
        for k, x in zip(same.tolist(), quant.quantize_many(v, scales[same], zeros[same], o.method, tiles[same], o.seed), strict=True):
            ints[k] = x
    return encode_integers(o, ints, 4), list(zip(scales.tolist(), zeros.tolist(), strict=True))


def encode_tiles(tiles: DataFrame, o: Options, q: float | None) -> DataFrame:
    """tile_index, COMPRESSED_DATA and, for quantized floats, ZSCALE and ZZERO."""
    quantized = not o.integers and q is not None
    fields = [T.StructField("tile_index", T.LongType()), T.StructField("COMPRESSED_DATA", T.BinaryType())]
    if quantized:
        fields += [T.StructField("ZSCALE", T.DoubleType()), T.StructField("ZZERO", T.DoubleType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, o.geometry.at_once):
                part = batch.slice(at, o.geometry.at_once)
                index = part.column("tile_index").to_pylist()
                lists = part.column("values")
                ends = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)
                values = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                payload, pairs = encode_values(o, q, index, values)
                out = [part.column("tile_index"), pa.array(payload, pa.binary())]
                if quantized:
                    out += [pa.array([s for s, _ in pairs]), pa.array([z for _, z in pairs])]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    ship(tiles.sparkSession)
    return tiles.select("tile_index", "values").mapInArrow(run, schema)


def z_cards(o: Options, quantized: bool) -> list[Card]:
    """In the order in which other readers look for them."""
    g = o.geometry
    out = [Card("ZIMAGE", True, "a compressed image"), *(Card(f"ZTILE{k}", t) for k, t in enumerate(g.tile, 1)), Card("ZCMPTYPE", o.codec)]
    if o.codec == "RICE_1":
        out += [Card("ZNAME1", "BLOCKSIZE"), Card("ZVAL1", o.block), Card("ZNAME2", "BYTEPIX"), Card("ZVAL2", o.bytepix)]
    if quantized:
        out += [Card("ZQUANTIZ", o.method), Card("ZDITHER0", o.seed)] if o.method != quant.NONE else [Card("ZQUANTIZ", quant.NONE)]
        out.append(Card("ZBLANK", quant.NULL))
    out += [Card("EXTNAME", "COMPRESSED_IMAGE"), Card("ZTENSION", "IMAGE"), Card("ZBITPIX", o.bitpix), Card("ZNAXIS", len(g.axes)), *(Card(f"ZNAXIS{k}", n) for k, n in enumerate(g.axes, 1)), Card("ZPCOUNT", 0), Card("ZGCOUNT", 1)]
    return out


def write_compressed(rows: DataFrame, path: str, code: int, axes: list[int], how: Compress | None = None, checksum: bool = False) -> Options:
    """Writes image lines (row_index from 0, values) as one compressed image; tiles are put in order by a range partition and then encoded, once."""
    from ..sources.fits_sink import write

    how = how or Compress()
    o = check(how, code, tuple(axes))
    quantized = not o.integers and how.quantize is not None
    ordered = cut(rows, o.geometry).repartitionByRange("tile_index").sortWithinPartitions("tile_index")
    done = encode_tiles(ordered, o, how.quantize).drop("tile_index")
    cards = [(c.name, c.value, c.comment) for c in z_cards(o, quantized)]
    write(done, path, single=True, checksum=checksum, tforms="COMPRESSED_DATA=1PB", longest=True, cards=cards)
    return o


def with_options(o: Options, **changes) -> Options:
    return replace(o, **changes)
