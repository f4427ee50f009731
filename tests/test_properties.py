"""Round trips of made-up values."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hduframe.functions.checksum import MOD, checksum, combine, decode, encode
from hduframe.operators import quantize as quant
from hduframe.operators.codecs import gz, rice
from hduframe.sources.cards import Card, Header, parse_header

TEXT = st.text(st.characters(min_codepoint=32, max_codepoint=0x2FF, exclude_characters="\x7f"), max_size=200).map(lambda s: s.rstrip())
VALUES = st.one_of(st.booleans(), st.integers(-(1 << 63), (1 << 63) - 1), st.floats(-1e300, 1e300), TEXT)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, max_size=6))
def test_headers(values):
    raw = Header([Card(f"K{k}", v) for k, v in enumerate(values)]).to_bytes()
    back, n = parse_header(raw[k : k + 2880] for k in range(0, len(raw), 2880))
    assert n == len(raw) == -(-len(raw) // 2880) * 2880
    got = [c.value for c in back]
    assert len(got) == len(values)
    for a, b in zip(got, values, strict=True):
        assert a == b or isinstance(b, float) and abs(a - b) <= 1e-15 * abs(b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 31), (1 << 31) - 1), max_size=80), max_size=5), st.sampled_from([16, 32]))
def test_rice(tiles, block):
    tiles = [np.array(t, np.int64) for t in tiles]
    back = rice.decode(rice.encode(tiles, 4, block), [len(t) for t in tiles], 4, block)
    assert all(np.array_equal(a, b) for a, b in zip(tiles, back, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400).map(lambda b: b[: len(b) // 4 * 4]))
def test_gzip(raw):
    assert gz.decode(gz.encode(raw, 4, True), 4, True) == raw


@settings(max_examples=200, deadline=None)
@given(st.integers(0, MOD), st.binary(max_size=100), st.binary(max_size=100))
def test_checksums(value, a, b):
    text = encode(value)
    assert decode(text) == value or value in (0, MOD)
    assert len(text) == 16 and text.isalnum() and decode(encode(value, True), True) in (value, 0, MOD)
    assert combine(checksum(a), checksum(b, len(a))) == checksum(a + b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=50), st.sampled_from([quant.NONE, quant.DITHER_1, quant.DITHER_2]), st.integers(0, 20_000))
def test_quantizing_stays_within_half_a_step(values, method, tile):
    v = np.array(values)
    scale, zero = quant.scale_zero(v)
    back = quant.unquantize(quant.quantize(v, scale, zero, method, tile, 1), scale, zero, method, tile, 1, quant.NULL)
    assert np.abs(back - v).max() <= scale / 2 * (1 + 1e-6) + 1e-9 * np.abs(v).max()
