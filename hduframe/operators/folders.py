"""Folders of images, a file each: written and compressed by tasks, whole files at a time, so that nothing goes through the driver.

One image of a file is of moderate size; what grows is the number of files.  A task writes under a name of its own and moves the
whole file into place, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SizeMismatch
from ..functions.checksum import Checksum, stamp
from ..session import ship
from ..sources.decode import pixels
from ..sources.encode import BITPIX_OF, encode_pixels, encode_rows, image_header
from ..sources.fits_sink import FitsWriter, primary
from ..sources.layout import Source, filesystem, index, padded, sized_files
from .tiles import Compress, Geometry, Options, check, encode_values, z_cards

MADE = "path string, lines long, bytes long"


class _Whole:
    """A file that comes into being when it is closed."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.to = f"{base.rstrip('/')}/{name}"
        self.fs.create_dir(self.to.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.to.rsplit('/', 1)[0]}/_{name.rsplit('/', 1)[-1]}.{TaskContext.get().taskAttemptId()}"
        self.path, self.out = f"{folder.rstrip('/')}/{name}", self.fs.open_output_stream(self.own)

    def close(self) -> int:
        size = self.out.tell()
        self.out.close()
        if not isinstance(self.fs, pafs.LocalFileSystem) and self.fs.get_file_info(self.to).type == pafs.FileType.File:
            self.fs.delete_file(self.to)
        self.fs.move(self.own, self.to)
        return size


def write_images(lines: DataFrame, folder: str, key: str = "file", bitpix: int | None = None, checksum: bool = False) -> DataFrame:
    """Writes the lines (key, row_index from 0, values) of each key as one 2-D image, ``<key>.fits``; gives path, lines and bytes of each.

    Lines are shuffled once, by key, and an image's lines stream through one task; its height comes from a count by key.  Lines
    of one image that differ in length, and row numbers that leave a gap, raise."""
    element = lines.schema["values"].dataType.elementType
    code = bitpix or BITPIX_OF[type(element)]
    width = abs(code) // 8
    heights = lines.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("height"))
    every = lines.select(F.col(key).cast("string").alias("name"), F.col("row_index").cast("long").alias("row_index"), "values")
    dealt = every.join(heights.withColumn("name", F.col("name").cast("string")), "name").repartition("name").sortWithinPartitions("name", "row_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, line, made, total = None, None, 0, [], Checksum()

        def close() -> None:
            size = line * at * width
            file.out.write(bytes(padded(size) - size))
            made.append((file.path, line, file.close()))

        held: list[bytes] = []
        for batch in batches:
            lists = batch.column("values")
            size = pa.compute.list_value_length(lists).to_pylist()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum([0, *size])
            for k, (name, row, height) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("name", "row_index", "height")), strict=True)):
                if name != now:
                    if file:
                        close()
                    now, line, at, file, total, held = name, 0, size[k], _Whole(folder, f"{name}.fits"), Checksum(), []
                    if not checksum:
                        file.out.write(image_header(code, [at, height], True).to_bytes())
                if row != line or size[k] != at:
                    raise SizeMismatch(f"image {name}: line {row} of {size[k]} pixels where line {line} of {at} is due")
                raw = encode_pixels(flat[begin[k] : begin[k + 1]], code)
                line += 1
                if not checksum:
                    file.out.write(raw)
                    continue
                held.append(raw)  # the header in front holds the sum of what comes behind it
                total.update(raw)
                if line == height:
                    file.out.write(stamp(image_header(code, [at, height], True), total.finish()).to_bytes())
                    for raw in held:
                        file.out.write(raw)
                    held = []
        if file:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "lines", "bytes"])

    ship(lines.sparkSession)
    return dealt.mapInArrow(run, MADE)


def compress_file(source: Source, to, how: Compress, checksum: bool = False) -> Options | None:
    """Compresses the first image of a file into an open one, some rows of tiles at a time; None if there is no image."""
    h = next((x for x in index(source) if x.kind == "image"), None)
    if h is None:
        return None
    code, axes = h.header.require_int("BITPIX"), h.axes
    o = check(how, code, tuple(axes))
    g = o.geometry
    quantized = not o.integers and how.quantize is not None
    fields = [T.StructField("COMPRESSED_DATA", T.BinaryType())] + [T.StructField(n, T.DoubleType()) for n in ("ZSCALE", "ZZERO") if quantized]
    cards = json.dumps([(c.name, c.value, c.comment) for c in z_cards(o, quantized)])
    writer = FitsWriter({"path": "", "tforms": "COMPRESSED_DATA=1PB", "longest": "true", "cards": cards, "checksum": str(checksum).lower()}, T.StructType(fields), True)
    per = int(np.prod(axes[:-1], dtype=np.int64)) if len(axes) > 1 else 1  # pixels of a step on the outermost axis
    rows: list[bytes] = []
    heap: list[bytes] = []
    n = size = most = 0
    for first in range(0, axes[-1], g.tile[-1]):
        depth = min(g.tile[-1], axes[-1] - first)
        width = abs(code) // 8
        block = pixels(source.read(h.data_offset + first * per * width, depth * per * width), code).reshape([depth, *axes[-2::-1]])
        slab = Geometry((*axes[:-1], depth), (*g.tile[:-1], depth))
        values = []
        for k in range(slab.n_tiles):
            place = tuple(slice(a, a + d) for a, d in zip(slab.origin(k), slab.dims(k), strict=True))
            values.append(np.ascontiguousarray(block[place[::-1]]).reshape(-1))
        payload, pairs = encode_values(o, how.quantize, list(range(n, n + len(values))), values)
        columns = [pa.array(payload, pa.binary())] + ([pa.array([p[j] for p in pairs]) for j in (0, 1)] if quantized else [])
        matrix, more = encode_rows(pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields]), writer.forms, size)
        rows.append(matrix.tobytes())
        heap.append(more)
        n, size, most = n + len(values), size + len(more), max(most, *map(len, payload))
    writer._file(to, n, rows, heap, [most])
    return o


def compress_images(spark: SparkSession, source: str, folder: str, how: Compress | None = None, checksum: bool = False) -> DataFrame:
    """Compresses the first image of each file below ``source`` into a file of the same place below ``folder``; gives path, tiles and
    bytes of each.  Files are dealt to tasks one by one; those without an image give nothing."""
    how = how or Compress()
    found = sized_files(source)
    base = source.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path[len(base) :].lstrip("/") or path.rsplit("/", 1)[1]
                src = Source(path)
                try:
                    if not any(h.kind == "image" for h in index(src)):
                        continue
                    file = _Whole(folder, name)
                    o = compress_file(src, file.out, how, checksum)
                    yield pa.RecordBatch.from_arrays([pa.array([file.path]), pa.array([o.geometry.n_tiles]), pa.array([file.close()])], names=["path", "tiles", "bytes"])
                finally:
                    src.close()

    ship(spark)
    paths = spark.createDataFrame([(p,) for p, _ in found], "path string").repartition(max(1, min(len(found), 100_000)), "path")
    return paths.mapInArrow(run, "path string, tiles long, bytes long")
