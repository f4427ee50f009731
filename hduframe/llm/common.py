"""Helpers shared by the operators: the shared scratch folder, word splitting, caches and Arrow slices."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and \t \n \v \f \r.
WORD_CLASS = r"[^\x20\x09-\x0D]"
WORD = re.compile(WORD_CLASS + "+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where it is unset and the session is a local one, a temporary folder is set instead.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc._jsc.sc().getCheckpointDir().isDefined():
        root = sc._jsc.sc().getCheckpointDir().get()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hduframe-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


class Scratch:
    """Tables and files of one operator run below the shared folder; written tables cut the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            pass


#: A key of more than one in HOT of a table's rows is hot, so there are fewer than HOT of them.
HOT, HOT_LEAST = 200, 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", sizes: DataFrame | None = None) -> DataFrame:
    """left (a written table) joined to right, which has one row for each key; how is left or inner.

    Rows of a hot key meet their one row by broadcast (fewer than HOT rows), where they lie; the others are shuffled, and none of
    their keys has more than one in HOT of the rows.  A null key finds nothing.  sizes: (key, size) of left's keys, if known.
    """
    sizes = sizes or left.groupBy(key).agg(F.count("*").alias("size"))
    least = F.greatest(F.lit(left.count() // HOT), F.lit(HOT_LEAST))
    hot = [r[0] for r in sizes.where(F.col(key).isNotNull() & (F.col("size") > least)).select(key).collect()]  # fewer than HOT
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(reduce(lambda a, b: a | b, (F.col(key) == F.lit(bytes(h) if isinstance(h, bytearray) else h) for h in hot)), F.lit(False))
    few = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return left.where(~is_hot).join(right, key, how).unionByName(few)


#: Least number of a filter's bits for each key.
BITS_EACH = 16


def may_hold(keys: DataFrame, key: str, room: int) -> Callable[[Column], Column]:
    """A condition that is true for each value of ``keys`` (a written table) and false for most others, whatever their number.

    It is a bitmap of bounded size at hashed places, so that rows of a large table that join nothing are left out where they lie, and only the
    others are shuffled to the exact join.  With more keys than ``room`` it lets more others pass and never leaves out a key.
    """
    shift = 64 - max(6, (BITS_EACH * min(room, keys.count())).bit_length())
    at = F.shiftrightunsigned(F.xxhash64(key), shift)
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}), {shift}) & 63 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (64 - shift - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def held(hashes: pa.Array) -> pa.Array:
        place = hashes.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(shift)
        return pa.array((sent.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

    of = F.arrow_udf(held, "boolean")
    return lambda column: of(F.xxhash64(column))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nobody holds any more; else it does so when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most so many rows, so that long texts don't add up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Cache(dict):
    """A dict that computes what it lacks and starts afresh at a bound of entries; texts over ``longest`` are computed each time
    and never kept, so that memory is bounded in bytes too."""

    def __init__(self, compute, bound: int = 250_000, longest: int = 256):
        super().__init__()
        self.compute, self.bound, self.longest = compute, bound, longest

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > self.longest:
            return self.compute(key)
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_fields(schema, drop=()) -> list:
    return [f for f in schema.fields if f.name.lower() not in {d.lower() for d in drop}]
