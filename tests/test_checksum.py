import numpy as np
import pytest
from pyspark.sql import functions as F

from hduframe.errors import ChecksumMismatch
from hduframe.functions.checksum import MOD, Checksum, checksum, combine, datasum_status, decode, decode_expr, encode, encode_checksums, require_datasum, stamp, verify_hdu, words_checksum
from hduframe.sources.cards import Card, Header

GOLDEN = {0: "0000000000000000", 1: "0000100000000000", 42: "3000A0005000A000", 0xDEADBEEF: "kiafngVZkgadkgUZ", 0x12345678: "N6AGN49EN4AEN49E", 0xFFFFFFFF: "orrrrooooooooooo", 2503531142: "QVChSU9fQUCfQU9f"}


def test_golden_texts():
    for value, text in GOLDEN.items():
        assert encode(value) == text and decode(text) == value
    with pytest.raises(ChecksumMismatch):
        decode("short")


def test_all_ones_and_overflow():
    assert checksum(b"\xff" * (1 << 20)) == MOD and checksum(b"") == 0 and checksum(b"\x01") == 1 << 24


def test_chunks_don_t_matter():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5001, dtype=np.uint8).tobytes()
    for _ in range(50):
        cuts = sorted(rng.integers(0, len(data), 4).tolist())
        c = Checksum()
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            c.update(data[a:b])
        assert c.finish() == checksum(data)
        a, b = cuts[0], cuts[1]
        assert combine(combine(checksum(data[:a]), checksum(data[a:b], a)), checksum(data[b:], b)) == checksum(data)


def test_stamp_and_verify():
    data = bytes(range(256)) * 12
    h = stamp(Header([Card("SIMPLE", True), Card("BITPIX", 8), Card("NAXIS", 0)]), checksum(data))
    assert verify_hdu(h.to_bytes(), checksum(data)) and not verify_hdu(h.to_bytes(), checksum(data[1:]))
    assert datasum_status(h, checksum(data)) == "ok" and datasum_status(h, 5) == "mismatch"
    with pytest.raises(ChecksumMismatch):
        require_datasum(h, 5)
    for value in (5, "0", "x"):
        h.set("DATASUM", value)
        assert datasum_status(h, 7) == "unchecked"
    assert datasum_status(Header(), 7) == "absent"


def test_expressions(spark):
    df = spark.createDataFrame([(v,) for v in GOLDEN], "v long")
    rows = encode_checksums(df, "v", "t").select("v", "t", decode_expr("t").alias("d")).collect()
    assert {r.v: r.t for r in rows} == GOLDEN and all(r.v == r.d for r in rows)
    words = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint64)
    got = spark.createDataFrame([(int(w),) for w in words], "w long").agg(words_checksum(F.col("w")).alias("s")).first().s
    assert got == checksum(words.astype(">u4").tobytes())
