import numpy as np
import pytest

from hduframe.errors import CompressionError, UnsupportedCompression
from hduframe.operators import quantize as quant
from hduframe.operators.codecs import gz, hcompress, plio, rice
from hduframe.operators.tiles import Compress, Geometry, check, decode_tiles, options_of
from hduframe.plans.hcompress_encoder import encode as hcompress_encode
from hduframe.sources.cards import Card, Header


def test_rice_golden_bytes():
    assert rice.encode([np.array([1000, 1003, 1001, 1005, 1002])], 4)[0].hex() == "000003e81c6e45"
    assert rice.encode([np.array([42] * 4)], 2)[0].hex() == "002a00"


@pytest.mark.parametrize(("width", "low", "high"), [(1, 0, 255), (2, -(1 << 15), (1 << 15) - 1), (4, -(1 << 31), (1 << 31) - 1)])
@pytest.mark.parametrize("block", [16, 32])
def test_rice_round_trip(width, low, high, block):
    rng = np.random.default_rng(width)
    tiles = [rng.integers(low, high + 1, n) for n in (0, 1, 5, 32, 33, 100)]
    tiles += [np.array([low, high, high, low] * 20), np.full(70, high), (rng.random(300) < 0.02) * high, np.clip(np.cumsum(rng.integers(-3, 4, 500)), max(low, -5000), min(high, 5000))]
    back = rice.decode(rice.encode(tiles, width, block), [len(t) for t in tiles], width, block)
    assert all(np.array_equal(a, b) for a, b in zip(tiles, back, strict=True))


def test_rice_parameter_is_the_least_that_fits():
    rng = np.random.default_rng(0)
    total, n = rng.integers(0, 1 << 30, 2000), rng.integers(1, 33, 2000)
    want = [-1 if t == 0 else next(k for k in range(26) if t >> k <= 2 * m or k == 25) for t, m in zip(total.tolist(), n.tolist(), strict=True)]
    assert rice.parameter(total, n, 25).tolist() == want


def test_rice_damage():
    raw = rice.encode([np.random.default_rng(1).integers(0, 1000, 200)], 4)[0]
    with pytest.raises(CompressionError):
        rice.decode([raw[:40]], [200], 4)
    with pytest.raises(CompressionError):
        rice.decode([b""], [3], 4)
    with pytest.raises(UnsupportedCompression):
        rice.encode([np.array([1])], 8)


def test_gzip():
    raw = np.arange(1000, dtype=">i4").tobytes()
    for shuffled in (False, True):
        assert gz.decode(gz.encode(raw, 4, shuffled), 4, shuffled) == raw
    bad = bytearray(gz.deflate(raw))
    bad[-5] ^= 1
    with pytest.raises(CompressionError):
        gz.inflate(bytes(bad))


def test_plio_golden():
    out = plio.decode(np.array([0, 7, -100, 9, 0, 0, 0, 20659, 333]), 512)
    assert np.flatnonzero(out).tolist() == [178] and out[178] == 1
    # short header; high value set to 5 + (1 << 12), runs, single pixels
    out = plio.decode(np.array([0, 0, 9, 0x1005, 1, 0x4002, 0x2003, 0x6000, 0x0002]), 8)
    assert out.tolist() == [4101, 4101, 4104, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("shape", [(2, 2), (4, 4), (5, 7), (1, 9), (9, 1), (16, 3), (33, 20), (64, 64)])
@pytest.mark.parametrize("huffman", [True, False])
def test_hcompress(shape, huffman):
    rng = np.random.default_rng(5)
    for img in (rng.integers(-300, 3000, shape), np.cumsum(np.cumsum(rng.integers(-2, 3, shape), 0), 1), np.zeros(shape, np.int64)):
        for bits in (16, 32):
            assert np.array_equal(hcompress.decode(hcompress_encode(img, huffman), img.size, bits).reshape(shape), img)


def test_hcompress_errors():
    raw = hcompress_encode(np.arange(64).reshape(8, 8))
    with pytest.raises(UnsupportedCompression):
        hcompress.decode(raw, 64, 32, smooth=1)
    with pytest.raises(UnsupportedCompression):
        hcompress.decode(raw[:2] + (1).to_bytes(4, "big") * 2 + raw[10:], 1, 32)
    for bad in (raw[:30], b"xx" + raw[2:]):
        with pytest.raises(CompressionError):
            hcompress.decode(bad, 64, 32)
    with pytest.raises(CompressionError):
        hcompress.decode(raw, 63, 32)


def test_random_table():
    t = quant.random_table()
    assert np.allclose(t[:5], [7.8263693e-06, 0.13153780, 0.75560534, 0.45865014, 0.53276724]) and round(float(t[-1]) * 2147483647) in range(1043618000, 1043618131)
    assert [int(np.float32(x) * np.float32(500)) for x in t[:5]] == [0, 65, 377, 229, 266]


def test_quantize():
    v = np.array([np.nan, 0.0, 1.0, -2.5, np.inf, 7.25])
    q = quant.quantize(v, 0.5, 1.0, quant.DITHER_2, 3, 5)
    assert q[0] == quant.NULL and q[4] == quant.NULL and q[1] == quant.ZERO
    back = quant.unquantize(q, 0.5, 1.0, quant.DITHER_2, 3, 5, quant.NULL)
    assert np.isnan(back[[0, 4]]).all() and back[1] == 0 and np.abs(back[[2, 3, 5]] - v[[2, 3, 5]]).max() <= 0.25
    assert quant.unquantize(np.array([10, 20]), 0.5, 3.0).tolist() == [8.0, 13.0]
    assert quant.half_away(np.array([2.5, -2.5, 0.49999999999999994, 1.5, -0.5])).tolist() == [3, -3, 0, 2, -1]
    assert quant.scale_zero(np.array([np.nan])) == (1.0, 0.0) and quant.scale_zero(np.full(3, 2.0)) == (1.0, 2.0)


def test_dither_goes_on_after_the_table_s_end():
    assert len(quant.offsets(25_000, 9_999, 7)) == 25_000


def test_geometry():
    g = Geometry((5, 4, 3), (2, 3, 2))
    assert g.counts == (3, 2, 2) and g.n_tiles == 12 and g.coords(11) == [2, 1, 1] and g.dims(11) == [1, 1, 1] and sum(int(np.prod(g.dims(k))) for k in range(12)) == 60


def zheader(codec="RICE_1", **more):
    base = {"ZCMPTYPE": codec, "ZBITPIX": 32, "ZNAXIS": 1, "ZNAXIS1": 4} | more
    return Header([Card(k, v) for k, v in base.items()])


def test_options():
    o = options_of(zheader("rice_one", ZNAME1="BLOCKSIZE", ZVAL1=16, ZQUANTIZ="NONE"))
    assert (o.codec, o.block, o.bytepix, o.geometry.tile) == ("RICE_1", 16, 4, (4,))
    for bad in ({"codec": "XYZ"}, {"ZQUANTIZ": "ODD"}):
        with pytest.raises(UnsupportedCompression):
            options_of(zheader(**bad))


def test_fallback_columns_and_keywords():
    o = options_of(zheader("GZIP_1", ZBITPIX=-32, ZSCALE=0.5, ZZERO=3.0))
    q = gz.deflate(np.array([10, 20, 30, 40], ">i4").tobytes())
    raw = np.array([1.5, 2.5, 3.5, 4.5], ">f4").tobytes()
    a, b = decode_tiles(o, [0, 0], [q, None], [None, None], [None, raw], [None, None], [None, None], [None, None])
    assert a.tolist() == [8.0, 13.0, 18.0, 23.0] and b.tolist() == [1.5, 2.5, 3.5, 4.5]
    with pytest.raises(CompressionError):
        decode_tiles(o, [0], [None], [None], [None], [None], [None], [None])
    with pytest.raises(UnsupportedCompression):
        decode_tiles(options_of(zheader("PLIO_1", ZBITPIX=-32)), [0], [b"x"], [None], [None], [0.5], [1.0], [None])


def test_what_isn_t_written():
    for how, code, axes in ((Compress("PLIO_1"), 16, (4, 4)), (Compress("HCOMPRESS_1"), 16, (4, 4)), (Compress(), 64, (4, 4)), (Compress("RICE_1", quantize=None), -32, (4, 4))):
        with pytest.raises(UnsupportedCompression):
            check(how, code, axes)
    for how, axes in ((Compress(), ()), (Compress(tile=(2,)), (4, 4))):
        with pytest.raises(CompressionError):
            check(how, 16, axes)


def test_plio_word_by_word():
    """Random words against a walk through them."""
    r = np.random.default_rng(6)

    def walk(w, n):
        out, at, high, k = [0] * n, 0, 1, 7
        while k < len(w) and at < n:
            op, d = w[k] >> 12 & 15, w[k] & 4095
            if op in (0, 4, 5):
                for j in range(at, min(n, at + d)):
                    out[j] = high if op == 4 or op == 5 and j == at + d - 1 else 0
                at += d
            elif op == 1:
                k += 1
                high = (w[k] << 12) + d
            elif op in (2, 3, 6, 7):
                high += d if op in (2, 6) else -d
                if op > 5:
                    out[at], at = high, at + 1
            k += 1
        return out

    for trial in range(400):
        ops = r.integers(0, 8, 12) << 12 | r.integers(0, 30, 12)
        words = [0, 7, -100, 20, 0, 0, 0, *ops.tolist(), 0x4003]
        n = int(r.integers(1, 200))
        assert plio.decode(np.array(words), n).tolist() == walk(words, n), trial


def test_plio_encoder_uses_every_opcode():
    from hduframe.plans.queries import plio_words

    r = np.random.default_rng(7)
    values = np.repeat(r.choice([0, 0, 1, 7, 300, 5000, 20000], 400), r.integers(1, 5, 400)).tolist()
    words = plio_words(values)
    assert plio.decode(np.array(words), len(values)).tolist() == values and {w >> 12 & 15 for w in words[7:]} >= set(range(8))
