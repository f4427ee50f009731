"""Scans of very many files, planned by Spark instead of the driver.

``read`` steps through each file's headers on the driver when it plans a scan.  Here a catalog (the mode ``hdus``, itself a job whose tasks
take some files each) is turned into ranges of rows, which are dealt out and read as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..sources.decode import read_image, read_table
from ..sources.layout import Source, find

RANGE_BYTES = 16 << 20


def ranges(catalog: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, hdu_index, first, last): the rows of tables and the lines of images of a catalog, cut into ranges."""
    table = F.col("kind").isin("table", "bintable")
    lines = F.when(table, F.col("nrows")).when(F.col("kind") == "image", F.aggregate(F.slice("axes", 2, 999), F.lit(1).cast("long"), lambda a, n: a * n)).otherwise(0)
    cut = catalog.withColumn("_n", lines).where("_n > 0").withColumn("_each", F.greatest(F.lit(1), F.floor(range_bytes / F.greatest(F.lit(1.0), F.col("data_bytes") / F.col("_n")))).cast("long"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.col("_each"))
    return cut.select("path", "hdu_index", "_n", "_each", F.explode(starts).alias("first")).select("path", "hdu_index", "first", F.least(F.col("first") + F.col("_each"), F.col("_n")).alias("last"))


def scan(catalog: DataFrame, schema: T.StructType, scale: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, hdu_index and the schema's columns of all HDUs of a catalog (filter it first); they must have these columns.
    Images are read as lines, or as pixels if the schema has a column ``value``; compressed images as tiles if it has ``payload`` (the schema of the
    mode ``tiles``, TILES of the data source)."""
    from .tiles import read_tiles

    ship(catalog.sparkSession)
    schema = T.StructType([f for f in schema.fields if f.name != "path"])
    out = T.StructType([T.StructField("path", T.StringType()), *([] if "hdu_index" in schema.names else [T.StructField("hdu_index", T.IntegerType())]), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = Source(path)
                try:
                    h = find(source, k)
                    if "payload" in schema.names:
                        parts = read_tiles(source, h, path, first, last, schema)
                    elif h.kind in ("table", "bintable"):
                        parts = read_table(source, h, first, last, schema, scale)
                    else:
                        each = h.axes[0] if "value" in schema.names else 1
                        parts = read_image(source, h, first * each, last * each, schema, "pixels" if each > 1 or "value" in schema.names else "rows")
                    for part in parts:
                        head = [pa.array([path] * part.num_rows, pa.string())]
                        if "hdu_index" not in schema.names:
                            head.append(pa.array([k] * part.num_rows, pa.int32()))
                        yield pa.RecordBatch.from_arrays([*head, *part.columns], names=out.names)
                finally:
                    source.close()

    dealt = ranges(catalog, range_bytes).repartition("path", "first")  # a row is a range of many bytes
    return dealt.select("path", "hdu_index", "first", "last").mapInArrow(run, out)
