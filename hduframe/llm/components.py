"""Connected components by contraction, in tables of the shared folder: nothing is gathered on the driver.

In each round every node points to the smallest of itself and its neighbours; pointers are followed, twice as far each time,
until they end; edges are moved to where their ends point, and loops and repeats go.  Each round at least halves the nodes that
still have edges, and a chain in order of its nodes ends in one.  At last the rounds' pointers are put together, the last first.
A node with very many edges is no hot key: its edges meet its pointer by broadcast (``hot_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) for each node of the edges (u, v); comp is the smallest node of its component."""
    ends = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    ends = scratch.write(ends, f"{name}-edges-0")
    pointers: list[DataFrame] = []
    while not ends.isEmpty():
        k = len(pointers)
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.col("node"), F.min("v"))
        to, step = scratch.write(both.groupBy(F.col("u").alias("node")).agg(least.alias("to")), f"{name}-to-{k}-0"), 0
        while True:
            step += 1
            further = scratch.write(_follow(to, to), f"{name}-to-{k}-{step}")
            done = further.where("moved").isEmpty()
            scratch.drop(f"{name}-to-{k}-{step - 1}")
            to = further.select("node", "to")
            if done:
                break
        pointers.append(to)
        moved = _move(scratch.write(_move(ends, to, "u"), f"{name}-moved-{k}"), to, "v")
        moved = moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
        ends = scratch.write(moved, f"{name}-edges-{k + 1}")
    if not pointers:
        return ends.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    last = pointers[-1]
    for k in range(len(pointers) - 2, -1, -1):
        last = scratch.write(_follow(pointers[k], last).select("node", "to"), f"{name}-end-{k}")
    return last.select("node", F.col("to").alias("comp"))


def _follow(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's pointers, moved on to where b points from there, and whether that is elsewhere."""
    far = b.select(F.col("node").alias("to"), F.col("to").alias("far"))
    end = F.coalesce("far", "to")
    return hot_join(a, far, "to").select("node", end.alias("to"), (end != F.col("to")).alias("moved"))


def _move(edges: DataFrame, to: DataFrame, end: str) -> DataFrame:
    other = "v" if end == "u" else "u"
    at = to.select(F.col("node").alias(end), F.col("to").alias("far"))
    return hot_join(edges, at, end).select(F.coalesce("far", end).alias(end), other)
