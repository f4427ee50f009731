"""Planning of scans, pushdown, files of many parts and folders of them, and names that could clash."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hduframe.functions import wcs
from hduframe.operators import quantize as quant
from hduframe.operators.codecs import rice
from hduframe.operators.folders import compress_images, write_images
from hduframe.operators.rows import with_index
from hduframe.operators.scan import scan
from hduframe.operators.tiles import Compress, read_compressed, tile_pixels, write_compressed
from hduframe.sources import fits_source
from hduframe.sources.encode import _ascii_cell, encode_ascii, encode_rows
from hduframe.sources.fits_sink import write
from hduframe.sources.fits_source import TILES, read
from hduframe.sources.tform import parse_ascii, parse_binary


def test_pushdown_takes_row_numbers_only(spark, tmp_path):
    """A table's own row_index and tile_index are values."""
    path = f"file://{tmp_path}/t.fits"
    write(spark.range(1000, numPartitions=3).select((999 - F.col("id")).alias("row_index"), (F.col("id") * 2).alias("tile_index")), path, single=True)
    for plan in ({}, {"rowIndex": True}):
        t = read(spark, path, pushdown=True, partitionBytes=500, **plan)
        assert t.where("row_index >= 900").count() == 100 and t.where("tile_index < 10").count() == 5 and t.where("tile_index IN (4, 6, 7)").count() == 2
    t = read(spark, path, pushdown=True, partitionBytes=500, rowIndex=True)
    got = t.where("_row_index >= 990 AND row_index < 5").collect()
    assert sorted(r._row_index for r in got) == [995, 996, 997, 998, 999]


def test_many_files_are_dealt_whole(spark, tmp_path, monkeypatch):
    """The driver reads no header but the first file's; each row comes once."""
    folder = f"file://{tmp_path}/many"
    write(spark.range(4000, numPartitions=4), folder, fileBytes=800)
    few = read(spark, folder, rowIndex=True)
    opened = []
    whole = fits_source.Source
    monkeypatch.setattr(fits_source, "FEW_FILES", 3)
    monkeypatch.setattr(fits_source, "Source", lambda path: opened.append(path) or whole(path))
    r = fits_source.Reader({"path": folder, "partitionbytes": "3000"}, few.schema)
    parts = r.partitions()
    assert not opened and 2 < len(parts) < 40 and {p.hdu for p in parts} == {-3}
    ids = [x for p in parts for b in r.read(p) for x in b.column("id").to_pylist()]
    assert sorted(ids) == list(range(4000)) == sorted(x.id for x in few.collect())
    r = fits_source.PushingReader({"path": folder, "partitionbytes": "3000", "rowindex": "true"}, few.schema)
    r.low, r.high = 3, 5  # of each file
    assert {x for p in r.partitions() for b in r.read(p) for x in b.column("_row_index").to_pylist()} == {3, 4}


def test_one_long_line_is_cut(spark, tmp_path):
    path = f"file://{tmp_path}/line.fits"
    write(spark.createDataFrame([(0, list(range(5000)))], "row_index long, values array<int>"), path, hdu="image", axes="5000")
    pixels = read(spark, path, mode="pixels", partitionBytes=4000, pathColumn="file")
    assert pixels.rdd.getNumPartitions() == 5
    assert sorted((r.pixel_index, r.x, r.value, r.file) for r in pixels.collect()) == [(k, k + 1, k, path) for k in range(5000)]
    catalog = read(spark, path, mode="hdus").where("kind = 'image'")
    assert scan(catalog, pixels.drop("file").schema).agg(F.sum("value")).first()[0] == 5000 * 4999 // 2
    pushed = read(spark, path, mode="pixels", partitionBytes=4000, pushdown=True).where("pixel_index >= 4900")
    assert sorted(r.value for r in pushed.collect()) == list(range(4900, 5000))


def test_permissive_catalog(spark, tmp_path):
    folder = f"file://{tmp_path}/mixed"
    write(spark.range(10, numPartitions=1), folder)
    (tmp_path / "mixed" / "broken.fits").write_bytes(b"no header at all")
    (tmp_path / "mixed" / "empty.fits").write_bytes(b"")
    for mode in ("hdus", "cards"):
        rows = read(spark, folder, mode=mode, permissive=True).collect()
        bad = {r.path.rsplit("/", 1)[1]: r.error for r in rows if r.error}
        assert set(bad) == {"broken.fits", "empty.fits"} and "InvalidFormat" in bad["empty.fits"] and any(r.error is None for r in rows)
        with pytest.raises(Exception, match="InvalidFormat"):
            read(spark, folder, mode=mode).collect()


@pytest.mark.parametrize("form", ["1PB", "1QB"])
def test_checksums_of_many_parts(spark, tmp_path, form):
    """Partial sums of rows of odd widths and of heaps, addresses moved on; the longest cell is named."""
    path = f"file://{tmp_path}/v.fits"
    r = random.Random(2)
    rows = [(k % 7, bytearray(r.randbytes(r.randrange(40))), "x" * (k % 3)) for k in range(503)]
    df = spark.createDataFrame(rows, "a short, v binary, s string").repartition(5)
    write(df, path, single=True, checksum=True, longest=True, tforms=f"v={form};s=3A")
    h = read(spark, path, mode="hdus", verify=True).collect()
    assert [x.datasum_status for x in h[1:]] == ["ok"] and all(x.checksum_ok for x in h[1:])
    got = sorted((x.a, bytes(x.v), x.s) for x in read(spark, path).collect())
    assert got == sorted((a, bytes(v), s) for a, v, s in rows)
    forms = [x.v_str for x in read(spark, path, mode="cards").where("name = 'TFORM2'").collect()]
    assert forms == [f"{form}({max(len(v) for _, v, _ in rows)})"]


def test_checksums_of_image_parts(spark, tmp_path):
    path = f"file://{tmp_path}/i.fits"
    lines = spark.range(91, numPartitions=7).select(F.col("id").alias("row_index"), F.array(*(((F.col("id") * 7 + k) % 251).cast("short") for k in range(3))).alias("values"))
    write(lines, path, hdu="image", axes="3,91", bitpix=8, checksum=True)  # parts of odd sizes
    assert all(x.checksum_ok and x.datasum_status in ("ok", "unchecked") for x in read(spark, path, mode="hdus", verify=True).collect())


def test_folder_of_compressed_images(spark, tmp_path):
    """Images of other geometries and codecs, merged by nothing but the values' type."""
    folder, want = f"file://{tmp_path}/c", set()
    for name, axes, tile, codec in (("a", (4, 3), (4, 1), "RICE_1"), ("b", (3, 4), (2, 3), "GZIP_1"), ("c", (50,), (7,), "RICE_1")):
        flat = [ord(name) * 1000 + k for k in range(math.prod(axes))]
        lines = [(y, flat[y * axes[0] : (y + 1) * axes[0]]) for y in range(len(flat) // axes[0])]
        write_compressed(spark.createDataFrame(lines, "row_index long, values array<int>"), f"{folder}/{name}.fits", 32, list(axes), Compress(codec, tile))
        want |= {(name, k, v) for k, v in enumerate(flat)}
    got = tile_pixels(read_compressed(spark, folder)).collect()
    assert len(got) == len(want) and {(r.path.rsplit("/", 1)[1][0], r.pixel_index, r.value) for r in got} == want
    catalog = read(spark, folder, mode="hdus").where("zimage")
    tiles = scan(catalog, spark.createDataFrame([], TILES).schema)
    assert tiles.groupBy("path").count().count() == 3 and tiles.count() == read(spark, folder, mode="tiles").count()


def test_rice_windows_and_long_tiles(monkeypatch):
    r = np.random.default_rng(0)
    for width, kind in ((1, np.uint8), (2, np.int16), (4, np.int32)):
        tiles = []
        for n in [0, 1, 31, 32, 33, 100, 1000, 5000]:
            low, high = np.iinfo(kind).min, np.iinfo(kind).max
            tiles += [np.zeros(n), np.cumsum(r.integers(-3, 4, n)), r.integers(low, high + 1, n), np.cumsum(r.integers(-40, 41, n))]
        tiles = [np.asarray(t).astype(np.int64).astype(kind).astype(np.int64) for t in tiles]
        for block in (16, 32, 7):
            packed = rice.encode(tiles, width, block)
            for window in (1 << 16, 300, 64):
                monkeypatch.setattr(rice, "WINDOW", window)
                got = rice.decode(packed, [len(t) for t in tiles], width, block)
                assert all(np.array_equal(a, b) for a, b in zip(tiles, got, strict=True))
    with pytest.raises(Exception, match="too early"):
        rice.decode([packed[-1][:-3]], [5000], width, block)


def test_a_tile_of_a_million_pixels_takes_a_second():
    import time

    t = np.cumsum(np.random.default_rng(1).integers(-200, 201, 1_000_000))
    packed = rice.encode([t], 4)
    at = time.process_time()
    got = rice.decode(packed, [len(t)], 4)[0]
    assert time.process_time() - at < 3 and np.array_equal(got, rice.wrap(t, 32))  # under one where nothing else runs


def test_one_rounding():
    r = np.random.default_rng(3)
    for trial in range(60):
        x = (r.integers(-(2**31), 2**31, 500) - r.random(500).astype(np.float32) + 0.5).astype(float)
        scale, zero = float(r.normal()) * 10.0 ** int(r.integers(-300 if trial % 9 == 0 else -9, 9)), float(r.normal()) * 10.0 ** int(r.integers(-9, 9))
        assert np.array_equal(quant.multiply_add(x, scale, zero if trial % 4 else -x[0] * scale), [math.fma(v, scale, zero if trial % 4 else -x[0] * scale) for v in x])


def test_ascii_columns_like_cells():
    r = random.Random(5)
    floats = [r.choice([-1, 1]) * r.random() * 10 ** r.randrange(-4, 9) for _ in range(400)] + [0.0, -0.0, -0.001, 0.125, 0.375, 2.5, 3.5, 1.005, 1e15, 0.5, 1.5, None, float("nan")]
    n = len(floats)
    batch = pa.RecordBatch.from_arrays([pa.array(floats), pa.array([None if k % 9 == 0 else k * 37 - 900 for k in range(n)], pa.int64()), pa.array([None if k % 5 == 0 else "äx"[: k % 3] for k in range(n)]), pa.array(floats)], names=list("fias"))
    for d in (0, 2, 5):
        forms = [parse_ascii(x) for x in (f"F24.{d}", "I8", "A6", "E26.8")]
        lines = [" ".join(_ascii_cell(batch.column(j)[k].as_py(), f, "x") for j, f in enumerate(forms)) for k in range(n)]
        got = encode_ascii(batch, forms)
        want = "".join(x for x in lines).encode()
        # cells are as wide in bytes as their form says
        width = 24 + 8 + 6 + 26 + 3
        assert len(got) == n * width
        for k, line in enumerate(lines):
            assert got[k * width : (k + 1) * width].decode().split() == line.split(), (d, k)
    assert want


def test_bytes_of_cells():
    batch = pa.RecordBatch.from_arrays([pa.array([b"ab", b"", None, b"abc"]), pa.array(["é", None, "xyz", ""])], names=["b", "s"]).slice(1)
    rows, heap = encode_rows(batch, [parse_binary("4B"), parse_binary("1PA")])
    assert rows[:, :4].tobytes() == b"\0\0\0\0\0\0\0\0abc\0" and heap == b"xyz"
    assert rows[:, 4:].copy().view(">i4").tolist() == [[0, 0], [3, 0], [0, 3]]


def test_names_do_not_clash(spark, tmp_path):
    df = spark.createDataFrame([(5.0, 6.0, 1, 2, 3, 4, "r")], "px double, py double, _a int, _d int, _u int, _v int, row string")
    w = wcs.Wcs("TAN", (150.0, 30.0), (50.5, 50.5), (-0.1, 0.0, 0.0, 0.1))
    back = wcs.with_pixel(wcs.with_world(df, w, "px", "py"), w)
    assert back.columns == [*df.columns, "lon", "lat", "x", "y"]
    r = back.first()
    assert (r._a, r._d, r._u, r._v, r.row) == (1, 2, 3, 4, "r") and abs(r.x - 5) < 1e-9 and abs(r.y - 6) < 1e-9
    rows = with_index(spark.createDataFrame([(2, "b"), (1, "a")], "_range int, row string"), ["_range"], f"{tmp_path}/w").collect()
    assert sorted((x._range, x.row, x.row_index) for x in rows) == [(1, "a", 0), (2, "b", 1)]


@pytest.mark.parametrize("checksum", [False, True])
def test_images_written_by_tasks(spark, tmp_path, checksum):
    folder, want = f"file://{tmp_path}/images", {}
    rows = []
    for name, (w, h) in {"a": (4, 3), "b": (7, 1), "c": (1, 9), "d": (5, 40)}.items():
        for y in range(h):
            rows.append((name, y, [ord(name) * 100 + y * w + k for k in range(w)]))
            want |= {(name, y * w + k): ord(name) * 100 + y * w + k for k in range(w)}
    lines = spark.createDataFrame(rows, "file string, row_index long, values array<int>").repartition(5)
    made = {r.path.rsplit("/", 1)[1]: r for r in write_images(lines, folder, checksum=checksum).collect()}
    assert {n: r.lines for n, r in made.items()} == {"a.fits": 3, "b.fits": 1, "c.fits": 9, "d.fits": 40} and {r.bytes % 2880 for r in made.values()} == {0}
    of = lambda rows, c: {(r[c].rsplit("/", 1)[1][0], r.pixel_index): r.value for r in rows}
    assert of(read(spark, folder, mode="pixels", pathColumn="from").collect(), "from") == want
    sums = read(spark, folder, mode="hdus", verify=True).collect()
    assert {r.datasum_status for r in sums} == ({"ok"} if checksum else {"absent"}) and all(r.checksum_ok is (True if checksum else None) for r in sums)
    for k, how in enumerate((Compress("RICE_1"), Compress("GZIP_2", (3, 2)), Compress("RICE_1", (1, 100)))):
        to = f"file://{tmp_path}/packed{k}"
        done = compress_images(spark, folder, to, how, checksum).collect()
        assert len(done) == 4 and of(tile_pixels(read_compressed(spark, to)).collect(), "path") == want
        sums = read(spark, to, mode="hdus", verify=True).where("hdu_index = 1").collect()
        assert {r.datasum_status for r in sums} == ({"ok"} if checksum else {"absent"})
    gap = spark.createDataFrame([("x", 0, [1]), ("x", 2, [3])], "file string, row_index long, values array<int>")
    with pytest.raises(Exception, match="line 1"):
        write_images(gap, f"file://{tmp_path}/gap").collect()


def test_cubes_and_floats_compressed_by_tasks(spark, tmp_path):
    """Tiles across planes, quantized as by the operator for one image."""
    values = [[float(np.sin(k * 5 + j) * 100) for j in range(5)] for k in range(4 * 6)]
    path, one = f"file://{tmp_path}/in/cube.fits", f"file://{tmp_path}/one.fits"
    lines = spark.createDataFrame(list(enumerate(values)), "row_index long, values array<float>")
    write(lines.coalesce(1), path, hdu="image", axes="5,4,6")
    for how in (Compress("RICE_1", (3, 2, 4)), Compress("GZIP_1", (5, 4, 1), None)):
        write_compressed(lines, one, -32, [5, 4, 6], how)
        compress_images(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", how).collect()
        a, b = (sorted((r.pixel_index, r.value) for r in tile_pixels(read_compressed(spark, p)).collect()) for p in (one, f"file://{tmp_path}/out"))
        assert a == b and len(a) == 120
