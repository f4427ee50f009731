import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hduframe.errors import InvalidFormat, InvalidTable, UnsupportedExtension
from hduframe.operators.from_bytes import schema_of, tables
from hduframe.operators.rows import with_index
from hduframe.operators.scan import scan
from hduframe.operators.tiles import Compress, read_compressed, tile_pixels, write_compressed
from hduframe.sources.cards import Card, Header
from hduframe.sources.decode import columns
from hduframe.sources.encode import empty_primary
from hduframe.sources.fits_sink import FitsBuilder, write
from hduframe.sources.fits_source import read
from hduframe.sources.layout import Source, data_bytes, files, find, index, padded
from hduframe.streaming.watch import watch

SCHEMA = "l boolean, b binary, i short, j int, k long, e float, d double, s string, arr array<int>, z struct<re:double,im:double>, v array<double>, t string"
ROWS = [
    (True, b"\x01\x02", -5, 7, 1 << 60, 1.5, -2.25, "ab", [1, 2, 3], (1.0, -1.0), [0.5], "é long text"),
    (False, b"\xff\x00", 32767, -(1 << 31), 0, -0.0, 1e300, "it's", [4, 5, 6], (0.0, 2.5), [], ""),
]
FORMS = "b=2B;s=8A;arr=3J;v=1QD"


def test_every_type(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for single in (True, False):
        path = str(tmp_path / f"t{single}.fits")
        write(df, path, single=single, checksum=True, tforms=FORMS)
        back = read(spark, path)
        got = {r.k: tuple(bytes(x) if isinstance(x, bytearray) else tuple(x) if isinstance(x, T.Row) else x for x in r) for r in back.collect()}
        assert got == {r[4]: r for r in ROWS}
        assert [f.dataType for f in back.schema.fields] == [f.dataType for f in df.schema.fields]
        sums = read(spark, path, mode="hdus", verify=True).where("hdu_index = 1").select("datasum_status", "checksum_ok").distinct().collect()
        assert [tuple(r) for r in sums] == [("ok", True)]


def test_nulls_have_defined_values(spark, tmp_path):
    df = spark.createDataFrame([(None, None, None, None, None)], "i int, d double, s string, v array<int>, l boolean")
    write(df, str(tmp_path / "n"))
    r = read(spark, str(tmp_path / "n")).first()
    assert (r.i, r.s, r.v, r.l) == (0, "", [], False) and math.isnan(r.d)


def test_no_rows_keep_the_schema(spark, tmp_path):
    df = spark.createDataFrame([], "a int, b string")
    for single in (True, False):
        path = str(tmp_path / f"e{single}.fits")
        write(df, path, single=single)
        back = read(spark, path, hdu=1)
        assert back.columns == ["a", "b"] and back.count() == 0


def test_timestamps_are_microseconds(spark, tmp_path):
    t = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901, tzinfo=datetime.timezone.utc)
    write(spark.createDataFrame([(t,)], "t timestamp"), str(tmp_path / "t"))
    assert read(spark, str(tmp_path / "t")).first().t == int(t.timestamp()) * 1_000_000 + 678901


def test_values_that_don_t_fit(spark, tmp_path):
    from pyspark.errors import PythonException

    for df, forms in ((spark.createDataFrame([("too long",)], "s string"), "s=3A"), (spark.createDataFrame([(70000,)], "s int"), "s=1I"), (spark.createDataFrame([([1, 2],)], "s array<int>"), "s=3J")):
        with pytest.raises((PythonException, Exception), match="longer than|beyond the range|doesn't have"):
            write(df, str(tmp_path / "x"), tforms=forms)


def test_columns_scale_and_row_numbers(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("short").alias("a", metadata={"tscal": 0.5, "tzero": 1.0, "tunit": "m"}), "id")
    path = str(tmp_path / "s.fits")
    write(df, path, single=True)
    assert read(spark, path, columns="id").columns == ["id"]
    assert [r.a for r in read(spark, path, columns="a").orderBy("a").collect()] == list(range(10))
    assert sorted(r.a for r in read(spark, path, columns="a", scale=True).collect()) == [1.0 + 0.5 * k for k in range(10)]
    assert read(spark, path).schema["a"].metadata["tunit"] == "m"
    picked = read(spark, path, rowIndex=True, pushdown=True, partitionBytes=30).where("_row_index IN (2, 3)")
    assert sorted(r.id for r in picked.collect()) == [2, 3]


def test_ascii(spark, tmp_path):
    df = spark.createDataFrame([("  NGC 1  ", -12, 1234.5, -1.5e-10), ("", 0, 0.0, 1e20)], "n string, i long, f double, d double")
    path = str(tmp_path / "a.fits")
    write(df, path, single=True, hdu="ascii", checksum=True, tforms="n=A10;i=I6;f=F10.3;d=D24.16")
    assert sorted(map(tuple, read(spark, path).collect())) == [("", 0, 0.0, 1e20), ("  NGC 1", -12, 1234.5, -1.5e-10)]
    assert read(spark, path, mode="hdus", verify=True).where("hdu_index = 1").first().datasum_status == "ok"


def hand_made(rows: bytes, cards: list, heap: bytes = b"") -> bytes:
    h = Header([Card("XTENSION", "BINTABLE"), Card("BITPIX", 8), Card("NAXIS", 2), *cards])
    data = rows + heap
    return empty_primary().to_bytes() + h.to_bytes() + data.ljust(padded(len(data)), b"\0")


def test_layouts_made_by_hand(spark, tmp_path):
    # no TTYPE, the same TTYPE twice, a heap behind a gap (THEAP), logical bytes other than T
    cards = [Card("NAXIS1", 17), Card("NAXIS2", 1), Card("PCOUNT", 8), Card("GCOUNT", 1), Card("TFIELDS", 4), Card("TFORM1", "1L"), Card("TTYPE2", "x"), Card("TFORM2", "1J"), Card("TTYPE3", "X"), Card("TFORM3", "1J"), Card("TTYPE4", "v"), Card("TFORM4", "PI(2)"), Card("THEAP", 21)]
    raw = hand_made(b"Y" + np.array([5, 6, 2, 0], ">i4").tobytes(), cards, b"\0\0\0\0" + np.array([7, -8], ">i2").tobytes())
    p = tmp_path / "h.fits"
    p.write_bytes(raw)
    df = read(spark, str(p))
    assert df.columns == ["col_1", "x", "X_2", "v"] and [tuple(r) for r in df.collect()] == [(False, 5, 6, [7, -8])]
    files_df = spark.createDataFrame([("a", raw), ("b", raw)], "path string, content binary")
    assert sorted(tuple(r)[:3] for r in tables(files_df, schema_of(raw)).collect()) == [("a", False, 5), ("b", False, 5)]


def test_descriptors_outside_the_heap(spark, tmp_path):
    cards = [Card("NAXIS1", 8), Card("NAXIS2", 1), Card("PCOUNT", 4), Card("GCOUNT", 1), Card("TFIELDS", 1), Card("TFORM1", "PJ")]
    for pair in ((-1, 0), (1, -4), (5, 0)):
        p = tmp_path / "d.fits"
        p.write_bytes(hand_made(np.array(pair, ">i4").tobytes(), cards, b"\0" * 4))
        with pytest.raises(Exception, match="descriptor"):
            read(spark, str(p)).collect()


def test_truncated_extensions(spark, tmp_path):
    path = tmp_path / "t.fits"
    write(spark.range(1000), str(path), single=True)
    path.write_bytes(path.read_bytes()[:-2880])
    assert [h.index for h in index(Source(str(path)))] == [0]
    with pytest.raises(InvalidFormat):
        list(index(Source(str(path)), strict=True))
    path.write_bytes(b"")
    with pytest.raises(InvalidFormat):
        list(index(Source(str(path))))


def test_unknown_extension_and_sizes():
    h = Header([Card("XTENSION", "FOREIGN"), Card("BITPIX", 8), Card("NAXIS", 0)])
    with pytest.raises(UnsupportedExtension):
        list(index(Source(data=empty_primary().to_bytes() + h.to_bytes())))
    h = Header([Card("BITPIX", -32), Card("NAXIS", 2), Card("NAXIS1", 3), Card("NAXIS2", 5), Card("PCOUNT", 2), Card("GCOUNT", 3)])
    assert data_bytes(h) == 4 * 3 * (2 + 15)
    with pytest.raises(InvalidTable):
        columns(Header([Card("XTENSION", "BINTABLE"), Card("TFIELDS", 1), Card("NAXIS1", 2), Card("TFORM1", "J")]))


def test_builder_and_extname(spark, tmp_path):
    path = str(tmp_path / "b.fits")
    img = spark.range(3).select(F.col("id").alias("row_index"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda x: (x + F.col("id") * 4).cast("short")).alias("values"))
    FitsBuilder().primary_image(img.coalesce(1), [4, 3]).bintable(spark.range(2), "ONE").bintable(spark.range(5), "TWO", cards=[["EXPTIME", 1.5, "s"]]).save(path, checksum=True)
    assert [h.extname for h in index(Source(path))] == [None, "ONE", "TWO"]
    assert read(spark, path, extname="TWO").count() == 5 and find(Source(path), extname="TWO").header.get_float("EXPTIME") == 1.5
    pix = read(spark, path, mode="pixels", hdu=0).orderBy("pixel_index").collect()
    assert [r.value for r in pix] == list(range(12)) and (pix[5].x, pix[5].y) == (2, 2)
    assert {r.checksum_ok for r in read(spark, path, mode="hdus", verify=True).collect()} == {True}
    with pytest.raises(InvalidTable):
        FitsBuilder().bintable(spark.range(1)).primary_image(img, [4, 3])


@pytest.mark.parametrize(("code", "kind", "values"), [(8, "short", [0, 128, 255]), (16, "short", [-32768, 0, 32767]), (32, "int", [-(1 << 31), 0, (1 << 31) - 1]), (64, "long", [-(1 << 63), 0, (1 << 63) - 1]), (-32, "float", [-1.5, 0.0, 3.4e38]), (-64, "double", [-1e300, 0.0, 1e300])])
def test_images_of_all_types(spark, tmp_path, code, kind, values):
    path = str(tmp_path / "i.fits")
    write(spark.createDataFrame([(0, values)], f"row_index long, values array<{kind}>"), path, hdu="image", bitpix=code, axes="3")
    got = read(spark, path, mode="rows", hdu=1).first()["values"]
    numpy = {"short": np.int16, "int": np.int32, "long": np.int64, "float": np.float32, "double": np.float64}[kind]
    assert np.array_equal(np.array(got, numpy), np.array(values, numpy))


def test_image_of_the_wrong_size(spark, tmp_path):
    with pytest.raises(Exception, match="axes need"):
        write(spark.createDataFrame([(0, [1, 2])], "row_index long, values array<int>"), str(tmp_path / "w.fits"), hdu="image", axes="3,1")


def test_ragged_tiles(spark, tmp_path):
    lines = spark.range(11).select(F.col("id").alias("row_index"), F.transform(F.sequence(F.lit(0), F.lit(12)), lambda x: (x * 7 - F.col("id") * 3).cast("short")).alias("values"))
    want = {k: (k % 13) * 7 - (k // 13) * 3 for k in range(143)}
    for tile in (None, (5, 5), (13, 11), (4, 1)):
        path = str(tmp_path / "z.fits")
        o = write_compressed(lines, path, 16, [13, 11], Compress("RICE_1", tile), checksum=True)
        assert {r.pixel_index: r.value for r in tile_pixels(read_compressed(spark, path), o.geometry).collect()} == want


def test_folders_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    write(spark.range(20).repartition(2), str(folder))
    assert len(files(str(folder))) == 2
    raw = next(folder.glob("*.fits")).read_bytes()
    q = watch(spark, str(folder), schema_of(raw)).writeStream.format("memory").queryName("rows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.sql("SELECT id FROM rows").collect()) == list(range(20))


def test_with_index(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert with_index(df, ["x"], str(tmp_path / "r")).where("x <> row_index").count() == 0


def test_scan_by_catalog(spark, tmp_path):
    write(spark.range(500).withColumn("s", F.col("id").cast("string")).repartition(4), str(tmp_path / "c"))
    catalog = read(spark, str(tmp_path / "c"), mode="hdus").where("kind = 'bintable'")
    back = scan(catalog, read(spark, str(tmp_path / "c")).schema, range_bytes=512)
    assert back.columns == ["path", "hdu_index", "id", "s"] and sorted(r.id for r in back.collect()) == list(range(500))
    lines = spark.range(6).select(F.col("id").alias("row_index"), F.array(F.col("id"), F.col("id") * 10).alias("values"))
    write(lines.coalesce(1), str(tmp_path / "i.fits"), hdu="image", axes="2,3,2")
    images = read(spark, str(tmp_path / "i.fits"), mode="hdus")
    for mode in ("rows", "pixels"):
        want = read(spark, str(tmp_path / "i.fits"), mode=mode)
        assert sorted(map(str, scan(images, want.schema, range_bytes=20).drop("path").collect())) == sorted(map(str, want.collect()))


def test_null_logicals(spark, tmp_path):
    p = tmp_path / "l.fits"
    p.write_bytes(hand_made(b"T\0F", [Card("NAXIS1", 1), Card("NAXIS2", 3), Card("PCOUNT", 0), Card("GCOUNT", 1), Card("TFIELDS", 1), Card("TFORM1", "L")]))
    assert [r[0] for r in read(spark, str(p)).collect()] == [True, False, False]
    assert [r[0] for r in read(spark, str(p), nullLogical=True).collect()] == [True, None, False]
