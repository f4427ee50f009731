"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of w[t] + sum over pairs t < u of <v[t], v[u]>) over the distinct hashed terms of the whole text.
Terms are lower-cased words and the beginnings of longer words, which stand for their inflected and joined forms.
The factors learn which terms make each other worse or harmless, beyond the sum of their own weights.

The machine is fitted on the driver on a bounded sample of labelled rows: the TRAIN_MOST rows outside the held-out third with the
smallest hash of their doc_id, with TRAIN_TERMS terms together (rows that don't fit are left out one by one, those with the most
terms first).  A row that is like an earlier one of its label (half of the terms in common) is left out as a copy.  Of the terms
in LEAST_DOCS rows, those get into the machine whose presence goes with the label, and those of pairs whose joint presence
goes with it beyond what either term alone says; both by Chernoff's bound over all terms or pairs that were tried, so that a pair which tells only
jointly reaches the factors though its terms alone tell nothing.  The machine's size is bounded by the number of BUCKETS, so it may be broadcast.

A row is held out if crc32(doc_id as text) mod 3 is 1 (a null doc_id isn't).  Labels, languages and sources are no input of
a score.  Null and empty texts have no terms and get the score of b alone; texts of any length are scored whole.  Each row gets its own
score, so repeated rows get equal ones; rows that share a labelled doc_id all carry its label.  A doc_id labelled more than once counts as
toxic if any of its labels says so.  Without labels of both kinds, all scores are 0 and nothing is predicted; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, Scratch, keep_fields, slices

TERM = re.compile(r"\w+")
BUCKETS, FACTORS, TRAIN_MOST, TRAIN_TERMS, LEAST_DOCS = 1 << 20, 6, 6000, 12_000_000, 4
#: Chance that any term, or any pair, gets into the machine whose presence has nothing to do with the label.
CHANCE = 0.01
BEGINNINGS = (4, 5, 6)
EPOCHS, RATE, DECAY, BATCH = 60, 0.2, 3e-4, 64
THRESHOLD = 0.7


@dataclass
class Machine:
    bucket: np.ndarray  # the buckets that have weights, sorted
    w: np.ndarray
    v: np.ndarray
    b: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: for each text the places of its terms in ``bucket``."""
        size = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.b)
        some = np.flatnonzero(size)
        if len(some):
            at = np.concatenate([rows[i] for i in some])
            out[some] += margin(self, at, np.concatenate([[0], np.cumsum(size[some])[:-1]]))[0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def margin(m: Machine, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows, given as one list of places and where each begins, add to b; and the sums of their factors."""
    v = m.v[at]
    total = np.add.reduceat(v, start)
    return np.add.reduceat(m.w[at], start) + 0.5 * (total**2 - np.add.reduceat(v * v, start)).sum(1), total


def buckets(word: str) -> tuple[int, ...]:
    """Of a word and of its beginnings."""
    return tuple(zlib.crc32(t.encode()) & (BUCKETS - 1) for t in (word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)))


def terms(text: str | None, cache: Cache) -> set[int]:
    """The distinct buckets of a text; cache gives those of a word."""
    return set().union(*{*map(cache.__getitem__, {*TERM.findall((text or "").lower())})})


def held_out(doc: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_MOST) -> DataFrame:
    """(toxic, terms) of the bounded sample."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    both = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(buckets)
        for part in slices(batches):
            found = [sorted(terms(t, cache)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    return both.mapInArrow(run, "doc_id long, toxic int, terms array<int>")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_MOST) -> Machine | None:
    rows = Scratch(docs.sparkSession, "toxicity").write(training_rows(docs, labels, most), "sample")
    taken, left = [], TRAIN_TERMS
    for r in sorted(rows.groupBy("doc_id").agg(F.sum(F.size("terms")).alias("n")).collect(), key=lambda r: (r.n, r.doc_id)):  # at most ``most`` ids
        if r.n <= left:
            taken.append((r.doc_id,))
            left -= r.n
    got = rows.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id", "left_semi").toArrow()  # at most TRAIN_TERMS terms
    lists = got.column("terms").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    ends = ends - ends[0] if len(ends) else np.zeros(1, np.int64)
    every = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    # an order that doesn't depend on how Spark dealt the rows
    order = sorted(range(len(every)), key=lambda i: (got.column("doc_id")[i].as_py(), every[i].tobytes()))
    sets, y = [every[i] for i in order], np.array([got.column("toxic")[i].as_py() for i in order], np.float64)
    one = distinct_rows(sets, y)
    if not len(one) or y[one].min() == y[one].max():
        return None
    sets, y = [sets[i] for i in one], y[one]
    known = telling(sets, y)
    rows = [np.searchsorted(known, np.intersect1d(t, known, assume_unique=True)) for t in sets]
    return train(known, rows, y)


def distinct_rows(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The rows that are no copy or near copy (half of the terms in common) of an earlier one with the same label: copies are no evidence."""
    rng = np.random.default_rng(11)
    xor, mul = rng.integers(0, 1 << 32, 24, dtype=np.uint32), rng.integers(0, 1 << 31, 24, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    seen: dict[tuple, int] = {}
    keep = []
    for i, r in enumerate(rows):
        if not len(r):
            continue
        h = r.astype(np.uint32) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        low = [int(((h ^ x) * m).min()) for x, m in zip(xor, mul, strict=True)]
        bands = [(y[i], k, low[k], low[k + 1]) for k in range(0, 24, 2)]
        for j in {seen[x] for x in bands if x in seen}:
            both = len(np.intersect1d(r, rows[j], assume_unique=True))
            if 2 * both >= len(r) + len(rows[j]) - both:
                break
        else:
            keep.append(i)
            for x in bands:
                seen.setdefault(x, i)
    return np.array(keep, np.int64)


def divergence(q: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Of a share q of toxic rows from the rate that was expected; times the rows, Chernoff's exponent."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(q > 0, q * np.log(q / rate), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - rate)), 0)


def telling(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The terms, of those in LEAST_DOCS rows, whose presence goes with the label, alone or beside another one."""
    known, inv = np.unique(np.concatenate(sets), return_inverse=True)
    docs, hits = np.bincount(inv).astype(float), np.bincount(inv, np.repeat(y, [len(t) for t in sets]))
    tried = docs >= LEAST_DOCS
    alone = tried & (docs * divergence(hits / docs, y.mean()) >= np.log(2 * max(1, tried.sum()) / CHANCE))
    return np.union1d(known[alone], in_pairs(sets, y, known[tried], docs[tried], hits[tried]))


def in_pairs(sets: list[np.ndarray], y: np.ndarray, known: np.ndarray, docs: np.ndarray, hits: np.ndarray, block: int = 1024) -> np.ndarray:
    """The terms of pairs that tell more than either term: their rows' share of toxic ones is unlikely at the rate of each alone.

    A term's own counts bound what any pair with it could reach, so only terms that could are multiplied out, block by block."""
    need = np.log(max(1.0, len(known) * (len(known) - 1.0)) / CHANCE)
    rate = (hits + 0.5) / (docs + 1)
    could = np.maximum(-hits * np.log(rate), -(docs - hits) * np.log1p(-rate)) >= need
    known, rate = known[could], rate[could]
    there = np.zeros((len(sets), len(known)), bool)
    for k, t in enumerate(sets):
        there[k, np.searchsorted(known, np.intersect1d(t, known, assume_unique=True))] = True
    told = np.zeros(len(known), bool)
    toxic = y > 0
    for a in range(0, len(known), block):
        left = there[:, a : a + block].T.astype(np.float32)
        for b in range(a, len(known), block):
            right = there[:, b : b + block].astype(np.float32)
            both, bad = left @ right, left[:, toxic] @ right[toxic]
            q = bad / np.maximum(both, 1)
            gain = both * np.minimum(divergence(q, rate[a : a + block, None]), divergence(q, rate[None, b : b + block]))
            x, z = np.nonzero(gain >= need)
            told[a + x[a + x != b + z]] = told[b + z[a + x != b + z]] = True
    return known[told]


def train(known: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> Machine:
    """Logistic loss, AdaGrad with decay, over rows in an order drawn with a fixed seed."""
    rng = np.random.default_rng(7)
    n = len(known)
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m = Machine(known, np.zeros(n), rng.normal(0, 0.01, (n, FACTORS)), float(np.log(rate / (1 - rate))))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            size = np.array([len(rows[i]) for i in batch])
            some = size > 0
            z = np.full(len(batch), m.b)  # rows without terms have a say in b alone
            if some.any():
                at = np.concatenate([rows[i] for i in batch])
                start = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                more, total = margin(m, at, start)
                z[some] += more
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]
            db = err.mean()
            gb += db**2
            m.b -= RATE * db / np.sqrt(gb)
            if not some.any():
                continue
            err, size = err[some], size[some]
            each = np.repeat(err / len(batch), size)
            u, inv = np.unique(at, return_inverse=True)
            dw = np.bincount(inv, each) + DECAY * m.w[u]
            gw[u] += dw**2
            m.w[u] -= RATE * dw / np.sqrt(gw[u])
            part = each[:, None] * (np.repeat(total, size, 0) - m.v[at])
            dv = np.stack([np.bincount(inv, part[:, f]) for f in range(FACTORS)], 1) + DECAY * m.v[u]
            gv[u] += dv**2
            m.v[u] -= 0.2 * RATE * dv / np.sqrt(gv[u])
    return m


def score(spark: SparkSession, docs: DataFrame, machine: Machine | None, column: str = "score") -> DataFrame:
    """Adds the score of each whole text; other columns stay, one of that name is replaced."""
    if machine is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = spark.sparkContext.broadcast(machine)  # at most BUCKETS * (FACTORS + 1) numbers, by the sample far fewer
    keep = keep_fields(docs.schema, (column,))
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {b: k for k, b in enumerate(m.bucket.tolist())}
        cache = Cache(lambda word: tuple(place[b] for b in buckets(word) if b in place))
        for part in slices(batches):
            rows = [np.array(sorted(terms(t, cache)), np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(m.score(rows), pa.float64())], names=[*names, column])

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField(column, T.DoubleType())]))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op2: doc_id, held_out, score, predicted."""
    scored = score(spark, docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
