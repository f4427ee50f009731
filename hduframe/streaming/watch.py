"""A folder to which FITS files are added, as a stream of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.from_bytes import tables

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.fits", files_per_trigger: int | None = None, hdu: int | None = None, extname: str | None = None, scale: bool = False) -> DataFrame:
    """Rows of a table HDU of each file, once it is there; files are read whole, so they should be of moderate size."""
    r = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return tables(r.load(folder), schema, hdu=hdu, extname=extname, scale=scale)
