"""Tiles that are coded side by side give what they give one by one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from hduframe.errors import CompressionError
from hduframe.functions.checksum import datasum_status, verify_hdu
from hduframe.operators import quantize as quant
from hduframe.operators.codecs import hcompress
from hduframe.operators.tiles import MANY, PIXELS, Compress, Geometry, _cells, check, decode_tiles, encode_values
from hduframe.plans.hcompress_encoder import encode, encode_many
from hduframe.sources.decode import read_table
from hduframe.sources.fits_sink import FitsWriter
from hduframe.sources.fits_source import datasum
from hduframe.sources.layout import Source, find


@pytest.mark.parametrize("shape", [(5, 20), (2, 2), (1, 9), (9, 1), (7, 5)])
def test_hcompress_side_by_side(shape):
    tiles = np.random.default_rng(2).integers(-300, 90_000_000, (hcompress.SIDE_BY_SIDE + 4, *shape))
    tiles[3], tiles[4] = 0, tiles[4] % 3
    raws = [encode(t, k % 2 == 0) for k, t in enumerate(tiles)]
    assert encode_many(tiles[::2]) == raws[::2]
    other = encode(np.arange(6).reshape(2, 3))
    back = hcompress.decode_many([*raws, other], [tiles[0].size] * len(raws) + [6], 32)
    assert all(np.array_equal(b.reshape(shape), t) for b, t in zip(back, tiles, strict=False)) and back[-1].tolist() == list(range(6))


def test_hcompress_damage_in_one_of_many():
    raws = encode_many(np.random.default_rng(3).integers(0, 1000, (hcompress.SIDE_BY_SIDE, 8, 8)))
    for bad in (raws[5][:40], raws[5][:-6], raws[5][:20], raws[5][:25] + b"\x70" + raws[5][26:]):
        with pytest.raises(CompressionError):
            hcompress.decode_many([*raws[:5], bad, *raws[6:]], [64] * len(raws), 32)


@pytest.mark.parametrize("n", [1, 4, 9, 9600])
@pytest.mark.parametrize("method", [quant.NONE, quant.DITHER_1, quant.DITHER_2])
def test_floats_side_by_side(n, method):
    rng = np.random.default_rng(n)
    v = rng.normal(5, 100, (12, n))
    v[rng.random(v.shape) < 0.2], v[rng.random(v.shape) < 0.1] = np.nan, 0
    o = check(Compress("RICE_1", (n, 1), 4.0, method, 9_995), -64, (n, 12))
    raws, pairs = encode_values(o, 4.0, list(range(12)), list(v))
    alone = [encode_values(o, 4.0, [k], [t]) for k, t in enumerate(v)]
    assert raws == [r[0] for r, _ in alone] and pairs == [p[0] for _, p in alone] == [quant.scale_zero(t) for t in v]
    assert np.array_equal(quant.offsets_many(n, np.arange(12), 9_995), [quant.offsets(n, k, 9_995) for k in range(12)])
    scale, zero, none = [p[0] for p in pairs], [p[1] for p in pairs], [None] * 12
    back = decode_tiles(o, list(range(12)), raws, none, none, scale, zero, none)
    assert all(np.array_equal(b, decode_tiles(o, [k], raws[k : k + 1], [None], [None], scale[k : k + 1], zero[k : k + 1], [None])[0], equal_nan=True) for k, b in enumerate(back))
    assert np.array_equal(np.isnan(back), np.isnan(v))


def test_pixels_at_a_time_are_bounded():
    for axes, tile in (((10_000, 50_000), (10_000, 1)), ((4, 1 << 30), (4, 1)), ((100, 100), (1000, 7)), ((1 << 24,), (1 << 24,))):
        g = Geometry(axes, tile)
        assert g.at_once == 1 or g.at_once * int(np.prod(g.dims(0))) <= PIXELS and g.at_once <= MANY


def test_places_of_many_tiles():
    g = Geometry((100, 37, 5), (33, 7, 2))
    origin, dims = g.places(np.arange(g.n_tiles))
    assert origin.tolist() == [g.origin(k) for k in range(g.n_tiles)] and dims.tolist() == [g.dims(k) for k in range(g.n_tiles)]


def test_words_are_views_of_the_batch():
    lists = pa.array([[1, 2], [], None, [3]], pa.list_(pa.int16())).slice(1)
    empty, none, last = _cells(lists)
    assert not len(empty) and none is None and last.tolist() == [3] and last.base is not None
    assert _cells(pa.nulls(2, lists.type)) == [None, None]


@pytest.mark.parametrize("sums", ["true", "false"])
def test_a_file_is_written_in_pieces(sums):
    class Sink(list):
        write = list.append

    pieces = [bytes([k]) * 100_003 for k in range(20)]
    row = np.array([[2_000_060, 0]], ">i4").tobytes()
    sink = Sink()
    FitsWriter({"path": "", "checksum": sums}, T.StructType([T.StructField("t", T.BinaryType())]), True)._file(sink, 1, [row], pieces)
    assert max(map(len, sink)) < 110_000
    source = Source(data=b"".join(sink))
    h = find(source, 1)
    assert source.size % 2880 == 0 and [b["t"][0].as_py() for b in read_table(source, h, 0, 1, T.StructType([T.StructField("t", T.BinaryType())]), False)] == [b"".join(pieces)]
    if sums == "true":
        total = datasum(source, h)
        assert datasum_status(h.header, total) == "ok" and verify_hdu(source.read(h.header_offset, h.data_offset - h.header_offset), total)


def test_batches_are_bounded_with_their_heap():
    n, each = 64, 1 << 18
    rows = np.array([[each, k * each] for k in range(n)], ">i4").tobytes()
    sink = []
    writer = FitsWriter({"path": ""}, T.StructType([T.StructField("t", T.BinaryType())]), True)
    writer._file(type("Sink", (), {"write": lambda self, raw: sink.append(raw)})(), n, [rows], [bytes(each)] * n)
    source = Source(data=b"".join(sink))
    batches = list(read_table(source, find(source, 1), 0, n, T.StructType([T.StructField("t", T.BinaryType())]), False))
    assert sum(b.num_rows for b in batches) == n and max(b.nbytes for b in batches) <= 5 << 20
