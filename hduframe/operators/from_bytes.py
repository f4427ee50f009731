"""FITS files that are held in a binary column, such as Spark's ``binaryFile`` source gives."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship
from ..sources.decode import read_image, read_table, table_schema
from ..sources.layout import Source, find


def schema_of(data: bytes, hdu: int | None = None, extname: str | None = None, scale: bool = False) -> T.StructType:
    """The columns of a table HDU of one file, held in memory."""
    return table_schema(find(Source(data=data), hdu, extname).header, scale)


def tables(df: DataFrame, schema: T.StructType, content: str = "content", path: str = "path", hdu: int | None = None, extname: str | None = None, scale: bool = False) -> DataFrame:
    """The rows of a table HDU of each file, behind the file's path; all files have the schema's columns."""
    ship(df.sparkSession)
    out = T.StructType([T.StructField(path, T.StringType()), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = Source(data=data.as_py())
                h = find(source, hdu, extname)
                if h.kind in ("table", "bintable"):
                    parts = read_table(source, h, 0, h.header.require_int("NAXIS2"), schema, scale)
                else:
                    n = 1
                    for k in h.axes[1:]:
                        n *= k
                    parts = read_image(source, h, 0, n * h.axes[0] if "value" in schema.names else n, schema, "pixels" if "value" in schema.names else "rows")
                for part in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows, pa.string()), *part.columns], names=[path, *schema.names])

    return df.select(path, content).mapInArrow(run, out)
