"""Stupid-backoff scores of every document under n-gram counts of the whole corpus, computed as a partitioned hash join.

S(w | context) = c(context w) / c(context) where the n-gram is in the table, else BACKOFF * S(w | shorter context), and
c(w) / N for single words.  Tables hold the n-grams that occur LEAST times or more in the corpus; single words all.  With LEAST = 2 an n-gram
that comes once counts as absent: it is known from the scored document alone, and with it every text's own n-grams would be certain.  Scores
are natural logarithms summed over a document's words, so that longer documents have lower ones; mean_score compares
documents of different lengths.  Contexts don't reach over a document's beginning.

n-grams are 64-bit hashes.  Documents are gathered into blocks; a block explodes its n-grams, adds up equal ones and
sends them, sorted, to the shard that their hash names: a row for each block and shard, packed, instead of a row for each
n-gram.  A shard is a hash partition of the count table: it merges what the blocks sent, adds the counts and joins
them back to each block's n-grams.  The block then holds a count for each of its n-grams and sums up scores by document.
Common n-grams reach a shard once for each block, so none is hot; the number of shards and blocks grows with the
corpus, so that no task holds more than a bounded part.  Shards are dealt with in WAVES, one after another, so that only
a part of all n-grams lies on disk at a time.  Nothing but the number of words goes to the driver.

Null and empty texts have no words and get a score of 0 over 0 words; equal rows are scored alike, each for itself, and are counted
each; words are runs without white space.  A null doc_id stays null.  A text longer than a block is a block of its own, read whole.  An empty
table gives no rows; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, Scratch, free_shuffles
from .near_dedup import mix

ORDER, BACKOFF, LEAST = 3, 0.4, 2
BLOCK_WORDS, SHARD_GRAMS, WAVES = 1_000_000, 3_000_000, 3
STEP = np.uint64(0x9E3779B97F4A7C15)


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """Bytes of one place together, which compress better."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).reshape(-1).view(kind)


def pack_words(words: np.ndarray) -> bytes:
    """Hashes as places in the block's words, the frequent first."""
    distinct, place, count = np.unique(words, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    head, body = pack(distinct[order]), pack(rank[place], 3)
    return len(head).to_bytes(8, "little") + head + body


def unpack_words(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return unpack(raw[8 : 8 + n], "<u8")[unpack(raw[8 + n :], "<u4")]


def grams(words: np.ndarray, lens: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: a hash for each word, of the n-gram that it ends, and the words that have n - 1 words before them."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(lens) - lens, lens)
    out = [(mix(words + np.uint64(1)), np.arange(len(words)))]
    for n in range(2, order + 1):
        h = np.zeros_like(words)
        h[1:] = mix(out[-1][0][:-1] * STEP + mix(words[1:] + np.uint64(n)))  # from the context's hash
        out.append((h, np.flatnonzero(place >= n - 1)))
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, lens, words): documents of about BLOCK_WORDS words together, words as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(lambda w: xxhash.xxh64_intdigest(w), 300_000)
        part, k = TaskContext.get().partitionId(), 0
        ids: list = []
        words: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            lens = [len(w) for w in words]
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())), pa.array([pack_words(np.concatenate(words) if held else np.empty(0, np.uint64))], pa.binary())],
                names=["block", "doc_ids", "lens", "words"],
            )

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = (t or "").encode().split()
                w = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
                if held and held + len(w) > BLOCK_WORDS:
                    yield out()
                    ids, words, held, k = [], [], 0, k + 1
                ids.append(d)
                words.append(w)
                held += len(w)
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, doc_ids array<long>, lens array<int>, words binary")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _block_grams(row: dict, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return grams(unpack_words(row["words"]), np.array(row["lens"], np.int64), order)


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the upper half of a hash, in the order of hashes; at most 2**32 shards."""
    return ((grams >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def sent(blocks: DataFrame, low: int, high: int, shards: int, order: int) -> DataFrame:
    """(shard, block, grams, counts) of the shards from low to high - 1: each block's distinct n-grams of a shard as differences, and how often
    they occur.  There is a row only where a block has n-grams of a shard, so there are never more rows than these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            every = np.concatenate([h[at] for h, at in _block_grams(row, order)])
            shard = shard_of(every, shards)
            every = np.sort(every[(shard >= low) & (shard < high)])
            if not len(every):
                continue
            start = np.flatnonzero(np.diff(every, prepend=every[:1] - np.uint64(1)))
            distinct, count = every[start], np.diff(np.append(start, len(every))).astype(np.uint32)
            shard = shard_of(distinct, shards)
            del every
            cuts = np.flatnonzero(np.diff(shard)) + 1
            names = shard[np.concatenate([[0], cuts])].tolist()
            for s, g, c in zip(names, np.split(distinct, cuts), np.split(count, cuts), strict=True):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "block": pa.array([row["block"]], pa.int64()), "grams": pa.array([pack(np.diff(g, prepend=np.uint64(0)))], pa.binary()), "counts": pa.array([pack(c)], pa.binary())})

    return blocks.mapInArrow(run, "shard int, block long, grams binary, counts binary")


def counted(sent: DataFrame) -> DataFrame:
    """(block, shard, counts): the corpus counts of each block's n-grams, in the order in which it sent them."""

    def merge(table):
        table = table.sort_by("block")
        sizes, grams, counts = [], [], []
        for g, c in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist(), strict=True):
            grams.append(np.cumsum(unpack(g, "<u8"), dtype=np.uint64))
            counts.append(unpack(c, "<u4"))
            sizes.append(len(grams[-1]))
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        new = np.empty(len(ordered), bool)
        new[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        start = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], start)
        back = np.empty(len(every), np.int64)
        back[order] = np.repeat(total, np.diff(np.append(start, len(every))))
        replies = [pack(x.astype(np.uint64)) for x in np.split(back, np.cumsum(sizes)[:-1])]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "counts": pa.array(replies, pa.binary())})

    return sent.groupBy("shard").applyInArrow(merge, "block long, shard int, counts binary")


def scores(blocks: DataFrame, replies: DataFrame, n_words: int, order: int, backoff: float, least: int) -> DataFrame:
    """(doc_id, n_words, score): the join of blocks with the counts of their n-grams."""

    def of_block(left, right):
        ids: list = []
        lens_out: list = []
        sums: list = []
        for row in left.to_pylist():
            lens = np.array(row["lens"], np.int64)
            each = _block_grams(row, order)
            ids += row["doc_ids"]
            lens_out += row["lens"]
            if not len(each[0][0]):
                sums += [0.0] * len(lens)
                continue
            counts = np.concatenate([unpack(c, "<u8") for c in right.sort_by("shard").column("counts").to_pylist()])
            found = np.empty(sum(len(at) for _, at in each), np.int64)
            every = np.concatenate([h[at] for h, at in each])
            sort = np.argsort(every)
            ordered = every[sort]
            found[sort] = counts[np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)]
            del every, ordered, sort
            parts = np.split(found, np.cumsum([len(at) for _, at in each])[:-1])
            context = parts[0].astype(np.float64)  # of each word the count of its (n - 1)-gram
            best = context / n_words
            for (_, at), c in zip(each[1:], parts[1:], strict=True):
                before = context[at - 1]
                best[at] = np.where(c >= least, c / before, backoff * best[at])
                context[at] = c
            rows = np.repeat(np.arange(len(lens)), lens)
            sums += np.bincount(rows, np.log(best), len(lens)).tolist()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(lens_out, pa.int64()), "score": pa.array(sums, pa.float64())})

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(of_block, "doc_id long, n_words long, score double")


def lm_scores(spark: SparkSession, docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST) -> DataFrame:
    """op9: doc_id, n_words, score (log), mean_score (by word; null without words)."""
    scratch = Scratch(spark, "lm-score")
    b = scratch.write(blocks(docs), "blocks")
    n_words = b.select(F.explode("lens").alias("n")).agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(n_words) * order // SHARD_GRAMS))
    replies, edges = None, sorted({shards * k // WAVES for k in range(WAVES + 1)})
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        rows = sent(b, low, high, shards, order).repartition(min(high - low, 20_000), "shard")
        part = scratch.write(counted(rows), f"replies-{k}")
        replies = part if replies is None else replies.unionByName(part)
        del rows, part
        free_shuffles(spark)
    out = scores(b, replies, max(1, int(n_words)), order, backoff, least)
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
