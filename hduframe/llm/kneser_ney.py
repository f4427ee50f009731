"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is the classifier that is fitted: on the whole texts of all documents labelled good but a fifth of them by the hash of their
doc_id (KEPT_BACK), which gives the cutoffs.  ``classify`` can be asked for a bounded sample instead.

The texts to fit on are gathered into packed blocks of about BLOCK_WORDS words.  A block sends the distinct trigrams of the model's documents in it, and
how often they have them, to the shard that the trigram's middle word names: packed, a row for each block and shard.  A trigram shares its
middle word with its context (the first two words) and its bigram (the last two), so a shard can add up the trigrams' counts, the
continuation counts of bigrams, and for both orders' contexts the total and the numbers of n-grams with counts 1, 2, 3 and more.  The model
is a row for each shard, its distinct trigrams with their counts, and shards of words with their continuation counts.  Shards are counted in
MODEL_WAVES.  The driver gets eight numbers of each and has the discounts from them, the counts of counts.

Then the documents are scored in at most WAVES parts, by a hash of what they hold, one after another: a part's blocks are written, their distinct trigrams and words
meet the model's shards, the answers go back to the blocks, which then have all parts of their words' probabilities and sum up logarithms by document, and blocks, requests
and answers are gone before the next part's.  So beside the model only a part lies on disk; the documents are scanned once for each part, and must read alike each time.
A shard has all trigrams around its words, so the most common word's trigrams are the least that a task gets.

All documents are scored on whole texts.  The cutoff of a language is the QUANTILE of the perplexities of its labelled good
documents that the model has not seen, and at most the largest of these but ODD_MOST; a language (null is one too) with fewer than LEAST of them uses that of all languages.  Null and
empty texts have no perplexity and are not kept.  Without good documents nothing is rejected but these.  A text longer than a block is a block
of its own, read whole; each row of the documents gets its own perplexity, so repeated rows and ids get one each, and a doc_id's label holds for all its rows.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Cache, Scratch, free_shuffles, keep_fields, may_hold, slices
from .lm_score import pack, pack_words, shard_of, unpack

TRAIN_MOST, TRAIN_WORDS, QUANTILE, LEAST, LANGUAGES_MOST = 2000, 800_000, 0.995, 30, 10_000
ODD_MOST = 2  # so many of a stratum's held-out documents may be mislabelled or odd without setting its cutoff
KEPT_BACK = 5  # one of so many good documents, by hash, is never fitted on, so that cutoffs always have some
BEGIN = np.uint64(0x5BD1E995)


def word_cache() -> Cache:
    return Cache(lambda w: xxhash.xxh64_intdigest(w), 300_000)


# ---- documents to fit on ------------------------------------------------------------------------------------------------------


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the good documents that a model may be fitted on."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().where(F.pmod(F.xxhash64("doc_id"), F.lit(KEPT_BACK)) != 0)


def training_ids(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of a bounded sample of good documents, for callers who want a small model."""
    chars = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(good_ids(labels), "doc_id").groupBy("doc_id").agg(F.sum("n").alias("chars"))
    # long texts come last, so that a few of them never make up the sample; one that doesn't fit excludes no other
    first = chars.where(F.col("chars") <= TRAIN_CHARS).orderBy(F.col("chars") > TRAIN_CHARS // LONG_PART, F.xxhash64("doc_id"), "doc_id").limit(TRAIN_MOST)
    taken, left = [], TRAIN_CHARS
    for r in first.collect():  # at most TRAIN_MOST ids
        if r.chars <= left:
            taken.append((r.doc_id,))
            left -= r.chars
    return docs.sparkSession.createDataFrame(taken, first.select("doc_id").schema)


#: Of the sample's texts together: TRAIN_WORDS words of usual length, and never more than three times as many.
TRAIN_CHARS = 6 * TRAIN_WORDS
LONG_PART = 20  # a text of more than one in so many of these characters is long


def discounts(n: list[int]) -> np.ndarray:
    """Of modified Kneser-Ney, from the numbers of n-grams with counts 1 to 4; usual values where these are too few."""
    if not all(n):
        return np.array([0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([min(max(x, 0.05), k) for k, x in zip((0.95, 1.95, 2.95), d, strict=True)])


# ---- blocks -------------------------------------------------------------------------------------------------------

BLOCK_WORDS, SHARD_WORDS, WAVES, MODEL_WAVES = 1_000_000, 3_000_000, 12, 4
WORD_BYTES = 6  # of a word and the space after it, to know the number of words before they are read
SEEN_MOST = 1 << 24  # ids for which the filter of documents to fit on has room; of more, others pass it and are left out later


def words_about(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD_BYTES


def waves_of(n_words: int) -> int:
    return max(1, min(WAVES, -(-n_words // SHARD_WORDS)))


def blocks(docs: DataFrame, wave: int | None = None, waves: int = 1) -> DataFrame:
    """(block, docs, lens, words): documents of about BLOCK_WORDS words together; docs has their columns but text, words are 64-bit hashes.
    Documents are dealt to waves by what they hold: those of one wave, or of all, a wave after another."""
    if wave is None:
        waves = waves_of(words_about(docs))
        return reduce(DataFrame.unionByName, (blocks(docs, k, waves) for k in range(waves)))
    if waves > 1:
        docs = docs.where(F.pmod(F.xxhash64(*(c for c in ("doc_id", "text") if c in docs.columns)), F.lit(waves)) == wave)
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, k = word_cache(), TaskContext.get().partitionId() << 8 | wave, 0
        rows: list = []
        words: list[np.ndarray] = []
        held, kind = 0, None

        def out() -> pa.RecordBatch:
            packed = pack_words(np.concatenate(words) if held else np.empty(0, np.uint64))
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k], pa.int64()), pa.array([rows], pa.list_(kind)), pa.array([[len(w) for w in words]], pa.list_(pa.int32())), pa.array([packed], pa.binary())],
                names=["block", "docs", "lens", "words"],
            )

        for batch in slices(batches, 64):
            kind = pa.struct([batch.schema.field(n) for n in names])
            for row, t in zip(batch.select(names).to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = (t or "").encode().split()
                w = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
                if held and held + len(w) > BLOCK_WORDS:
                    yield out()
                    rows, words, held, k = [], [], 0, k + 1
                rows.append(row)
                words.append(w)
                held += len(w)
        if rows:
            yield out()

    one = T.StructType([docs.schema[n] for n in names])
    return docs.mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(one)), T.StructField("lens", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType())]))


def ordered(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct words and the mark before texts, sorted, and for each of its words, as they are packed, the place there."""
    own = unpack(raw[8 : 8 + int.from_bytes(raw[:8], "little")], "<u8")
    order = np.argsort(own)
    distinct, number = own[order], np.empty(len(own), np.uint64)
    number[order] = np.arange(len(own), dtype=np.uint64)
    mark = int(np.searchsorted(distinct, BEGIN))
    if mark == len(distinct) or distinct[mark] != BEGIN:
        distinct = np.insert(distinct, mark, BEGIN)
        number[number >= mark] += np.uint64(1)
    return distinct, number


def places(lens: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct words, sorted, and for each of its words the numbers of the word two before it, of that before it and of itself;
    two marks stand before a text."""
    distinct, number = ordered(raw)
    rank = unpack(raw[8 + int.from_bytes(raw[:8], "little") :], "<u4")
    flat = np.full(int(lens.sum()) + 2 * len(lens), np.searchsorted(distinct, BEGIN), np.uint64)
    real = np.ones(len(flat), bool)
    first = np.cumsum(lens + 2) - (lens + 2)
    real[first] = real[first + 1] = False
    flat[real] = number[rank]
    at = np.flatnonzero(real)
    return distinct, flat[at - 2], flat[at - 1], flat[at]


def trigrams(n: int, left: np.ndarray, mid: np.ndarray, right: np.ndarray, placed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Of words numbered below n: the distinct contexts as mid * n + left, in order; of each distinct trigram, ordered by its context and
    last word, the context's place and the last word; and, if placed, the trigram's place for each given one."""
    n = np.uint64(max(1, n))
    if int(n) ** 3 < 1 << 64:  # one sort instead of two
        keys = (mid * n + left) * n + right
        if placed:
            distinct, place = np.unique(keys, return_inverse=True)
        else:
            distinct, place = np.sort(keys), None
            distinct = distinct[_changes(distinct)]
        pair = distinct // n
        new = _changes(pair)
        return pair[new], np.cumsum(new) - 1, distinct - pair * n, place
    contexts, at = np.unique(mid * n + left, return_inverse=True)
    distinct, place = np.unique(at.astype(np.uint64) * n + right, return_inverse=True)
    return contexts, (distinct // n).astype(np.int64), distinct % n, place


def _changes(a: np.ndarray) -> np.ndarray:
    """Where a value of a sorted array comes first."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return new



def _differences(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def _summed(raw: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


def trained_bits(blocks: DataFrame, seen: DataFrame) -> DataFrame:
    """(block, trained): a bit for each document of a block, set where its doc_id is in seen."""

    def bits(table):
        at = np.zeros(table.column("n")[0].as_py(), bool)
        at[table.column("place").to_numpy()] = True
        return pa.table({"block": table.column("block").slice(0, 1), "trained": pa.array([np.packbits(at).tobytes()], pa.binary())})

    each = blocks.select("block", F.size("lens").alias("n"), F.posexplode("docs.doc_id").alias("place", "doc_id"))
    return each.join(seen, "doc_id").select("block", "n", "place").groupBy("block").applyInArrow(bits, "block long, trained binary")


# ---- counting -----------------------------------------------------------------------------------------------------


def sent(blocks: DataFrame, low: int, high: int, shards: int, trained: bool) -> DataFrame:
    """(shard, block, words, left, mid, right, counts) of the shards from low to high - 1: each block's distinct trigrams.  trained: only of the documents that the model is of,
    by blocks' column trained (a bit for each document), with how often they have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                lens = np.array(row["lens"], np.int64)
                distinct, left, mid, right = places(lens, row["words"])
                shard = shard_of(distinct, shards).astype(np.int64)
                mine = (shard[mid.astype(np.int64)] >= low) & (shard[mid.astype(np.int64)] < high)
                if trained:
                    mine &= np.repeat(np.unpackbits(np.frombuffer(row["trained"], np.uint8), count=len(lens)).astype(bool), lens)
                if not mine.any():
                    continue
                n = np.uint64(len(distinct))
                contexts, context, right, place = trigrams(len(distinct), left[mine], mid[mine], right[mine], trained)
                counts = np.bincount(place).astype(np.uint32) if trained else None
                mid, left = contexts[context] // n, contexts[context] % n
                of = shard[mid.astype(np.int64)]
                cuts = np.flatnonzero(np.diff(of)) + 1
                here, local = np.zeros(len(distinct), bool), np.empty(len(distinct), np.uint32)
                for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
                    each = [c[a:b].astype(np.int64) for c in (left, mid, right)]
                    for c in each:
                        here[c] = True
                    used = np.flatnonzero(here)
                    here[used], local[used] = False, np.arange(len(used), dtype=np.uint32)
                    x, y, z = (local[c] for c in each)
                    values = [_differences(distinct[used]), _differences(x), _differences(y), pack(z), pack(counts[a:b]) if trained else b""]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(of[a])], pa.int32()), pa.array([row["block"]], pa.int64()), *(pa.array([v], pa.binary()) for v in values)],
                        names=["shard", "block", "words", "left", "mid", "right", "counts"],
                    )

    return blocks.select("block", "lens", "words", *(["trained"] if trained else [])).mapInArrow(run, "shard int, block long, words binary, left binary, mid binary, right binary, counts binary")


def _sums(place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each of n contexts the sum of its n-grams' counts and how many have 1, 2, 3 and more."""
    return np.stack([np.bincount(place, w, n) for w in (counts, counts == 1, counts == 2, counts >= 3)]).astype(np.uint64)


ANSWER = "block long, shard int, tri binary, ctx2 binary, bi binary, ctx1 binary"


def answers_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "shard", "tri", "ctx2", "bi", "ctx1"])


def _triples(row: dict) -> tuple[np.ndarray, ...]:
    """Words, and the places there of each trigram's left, middle and right one."""
    return _summed(row["words"], "<u8"), _summed(row["left"], "<u4"), _summed(row["mid"], "<u4"), unpack(row["right"], "<u4")


def counted(sent: DataFrame) -> DataFrame:
    """The model, a row for each shard: (shard, words, left, mid, right, counts) like those sent, of all blocks together; in ends for each of its words how many of the
    shard's distinct bigrams end in it; and in few how many trigrams and bigrams have counts 1 to 4."""

    def merge(table):
        rows = table.to_pylist()
        each = [_triples(r) for r in rows]
        words, number = np.unique(np.concatenate([e[0] for e in each]), return_inverse=True)
        number = np.split(number.astype(np.uint64), np.cumsum([len(e[0]) for e in each])[:-1])
        left, mid, right = (np.concatenate([at[e[c]] for at, e in zip(number, each, strict=True)]) for c in (1, 2, 3))
        del each, number
        n = np.uint64(len(words))
        contexts, context, last, place = trigrams(len(words), left, mid, right)
        del left, mid, right
        counts = np.bincount(place, np.concatenate([unpack(r["counts"], "<u4") for r in rows]), len(context)).astype(np.uint32)
        mid = contexts[context] // n
        bigrams, continued = np.unique(mid * n + last, return_counts=True)
        ends = np.bincount((bigrams % n).astype(np.int64), minlength=len(words)).astype(np.uint32)
        few = np.array([(x == k).sum() for x in (counts, continued) for k in (1, 2, 3, 4)], np.uint64)
        left = (contexts[context] - mid * n).astype(np.uint32)
        values = [_differences(words), _differences(left), _differences(mid.astype(np.uint32)), pack(last.astype(np.uint32)), pack(counts), pack(ends), pack(few)]
        return pa.table([table.column("shard").slice(0, 1), *(pa.array([v], pa.binary()) for v in values)], names=["shard", "words", "left", "mid", "right", "counts", "ends", "few"])

    return sent.groupBy("shard").applyInArrow(merge, "shard int, words binary, left binary, mid binary, right binary, counts binary, ends binary, few binary")


def _found(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each one asked in sorted keys, len(keys) of those that aren't there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.searchsorted(keys, asked)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == asked, at, len(keys))


def _and_none(a: np.ndarray) -> np.ndarray:
    """With a column of zeros for what isn't found."""
    return np.concatenate([a, np.zeros((*a.shape[:-1], 1), a.dtype)], axis=-1)


def answered(sent: DataFrame, model: DataFrame, parts: int) -> DataFrame:
    """(block, shard, tri, ctx2, bi, ctx1): the model's counts of each block's trigrams, contexts, bigrams and their contexts, in the order of the block."""

    def merge(table):
        rows = table.to_pylist()
        asks = [r for r in rows if r["block"] is not None]
        if not asks:
            return answers_table([(None, 0, b"", b"", b"", b"")]).slice(0, 0)
        own = [r for r in rows if r["block"] is None]  # one at most
        words, left, mid, right = _triples(own[0]) if own else (np.empty(0, np.uint64), *[np.empty(0, np.uint32)] * 3)
        counts = unpack(own[0]["counts"], "<u4").astype(np.uint64) if own else np.empty(0, np.uint64)
        n = np.uint64(len(words) + 1)  # the last number is of words that the model lacks
        pair = mid.astype(np.uint64) * n + left
        new = _changes(pair)
        contexts, context = pair[new], np.cumsum(new) - 1
        keys = context.astype(np.uint64) * n + right
        of_contexts = _and_none(_sums(context, counts, len(contexts)))
        bigrams, continued = np.unique(mid.astype(np.uint64) * n + right, return_counts=True)
        of_words = _and_none(_sums((bigrams // n).astype(np.int64), continued, len(words)))
        counts, continued = _and_none(counts), _and_none(continued.astype(np.uint64))
        del pair, new, context, left, mid, right
        out = []
        for r in asks:
            w, x, y, z = _triples(r)
            to = _found(words, w).astype(np.uint64)
            new = _changes(x) | _changes(y)
            c = _found(contexts, to[y[new]] * n + to[x[new]])
            tri = _found(keys, c[np.cumsum(new) - 1].astype(np.uint64) * n + to[z])
            pairs = np.sort(y.astype(np.uint64) * np.uint64(len(w)) + z)  # faster here than np.unique, which hashes
            pairs = pairs[_changes(pairs)]
            before = pairs // np.uint64(len(w))
            bi = _found(bigrams, to[before] * n + to[pairs - before * np.uint64(len(w))])
            answers = counts[tri], of_contexts[:, c].ravel(), continued[bi], of_words[:, to[y[_changes(y)]].astype(np.int64)].ravel()
            out.append((r["block"], r["shard"], *(pack(a) for a in answers)))
        return answers_table(out)

    own = model.select("shard", F.lit(None).cast("long").alias("block"), "words", "left", "mid", "right", "counts")
    return sent.unionByName(own).repartition(parts, "shard").groupBy("shard").applyInArrow(merge, ANSWER)


def _pieces(words: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Of sorted words: each shard that has some, and where they are."""
    of = shard_of(words, shards)
    cuts = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
        if b > a:
            yield int(of[a]), slice(a, b)


#: Added to the shards of answers for words, which so come before those for trigrams.
OF_WORDS = -(1 << 30)


def words_counted(model: DataFrame, shards: int) -> DataFrame:
    """(shard, words, counts, few): the model's words and their continuation counts, the number of distinct bigrams that end in them; in few how many
    words have some, the sum, and how many have 1 to 4."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w, c = _summed(w, "<u8"), unpack(c, "<u4")
                w, c = w[c > 0], c[c > 0]
                each = list(_pieces(w, shards))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in each], pa.int32()), pa.array([_differences(w[at]) for _, at in each], pa.binary()), pa.array([pack(c[at]) for _, at in each], pa.binary())], names=["shard", "words", "counts"])

    def merge(table):
        rows = table.to_pylist()
        words, place = np.unique(np.concatenate([_summed(r["words"], "<u8") for r in rows]), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(r["counts"], "<u4") for r in rows]), len(words)).astype(np.uint64)
        few = np.array([len(words), total.sum(), *((total == k).sum() for k in (1, 2, 3, 4))], np.uint64)
        return pa.table([table.column("shard").slice(0, 1), *(pa.array([v], pa.binary()) for v in (_differences(words), pack(total), pack(few)))], names=["shard", "words", "counts", "few"])

    rows = model.select("words", "ends").mapInArrow(known, "shard int, words binary, counts binary")
    return rows.repartition(min(shards, 20_000), "shard").groupBy("shard").applyInArrow(merge, "shard int, words binary, counts binary, few binary")


def words_answered(blocks: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """Like ``answered``, in shards named below 0, in tri: the continuation counts of each block's distinct words."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "words")), strict=True):
                distinct = ordered(raw)[0]
                each = list(_pieces(distinct, shards))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in each], pa.int32()), pa.array([block] * len(each), pa.int64()), pa.array([_differences(distinct[at]) for _, at in each], pa.binary()), pa.array([b""] * len(each), pa.binary())], names=["shard", "block", "words", "counts"])

    def merge(table):
        rows, shard = table.to_pylist(), table.column("shard")[0].as_py() + OF_WORDS
        own = [r for r in rows if r["block"] is None]  # one at most
        known, total = (_summed(own[0]["words"], "<u8"), unpack(own[0]["counts"], "<u8")) if own else (np.empty(0, np.uint64), np.empty(0, np.uint64))
        total = _and_none(total)
        out = [(r["block"], shard, pack(total[_found(known, _summed(r["words"], "<u8"))]), b"", b"", b"") for r in rows if r["block"] is not None]
        return answers_table(out or [(None, shard, b"", b"", b"", b"")]).slice(0, len(out))

    rows = blocks.select("block", "words").mapInArrow(asked, "shard int, block long, words binary, counts binary")
    own = words.select("shard", F.lit(None).cast("long").alias("block"), "words", "counts")
    return rows.unionByName(own).repartition(min(shards, 20_000), "shard").groupBy("shard").applyInArrow(merge, ANSWER)


# ---- scoring ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Blocks of the texts that it is fitted on; they are counted together with those that ask."""

    blocks: DataFrame


def fit(scratch: Scratch, sample: DataFrame) -> Model | None:
    own = scratch.write(blocks(sample.select("text", F.lit(0).alias("_")), 0), "model")
    if own.where(F.exists("lens", lambda n: n > 0)).isEmpty():
        return None
    return Model(own.select("block", "lens", "words", F.unhex(F.expr("repeat('ff', (size(lens) + 7) div 8)")).alias("trained")))


def shares(counts: np.ndarray, total: np.ndarray | float, d: np.ndarray) -> np.ndarray:
    """The discounted share of each n-gram in its context; none of one that the model lacks."""
    c = counts.astype(np.float64)
    return np.where(c > 0, c - d[np.clip(counts, 1, 3).astype(np.int64) - 1], 0.0) / np.maximum(total, 1)


def left_over(sums: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The share that each context leaves to shorter n-grams; all, of one that the model lacks."""
    return np.where(sums[0] > 0, d @ sums[1:].astype(np.float64), 1.0) / np.maximum(sums[0], 1)


def scores(blocks: DataFrame, answers: DataFrame, d2: np.ndarray, d3: np.ndarray, d1: np.ndarray, total: int, unseen: float, trained: bool) -> DataFrame:
    """The blocks' documents with n_words and perplexity."""
    one = blocks.schema["docs"].dataType.elementType

    def of_block(left, right):
        right = right.sort_by("shard")
        sums, lens_out = [], []
        for lens, raw in zip(left.column("lens").to_pylist(), left.column("words").to_pylist(), strict=True):
            lens = np.array(lens, np.int64)
            lens_out.append(lens)
            distinct, a, mid, b = places(lens, raw)
            if not len(b) or not trained:
                sums.append(np.zeros(len(lens)))
                continue
            n = np.uint64(len(distinct))
            contexts, context, last, place = trigrams(len(distinct), a, mid, b)
            middle = contexts // n
            got = right.to_pydict()
            first = sum(x < 0 for x in got["shard"])  # answers for words come before those for trigrams
            shorter = np.concatenate([unpack(x, "<u8") for x in got["tri"][:first]])
            tri, bi = (np.concatenate([unpack(x, "<u8") for x in got[c][first:]]) for c in ("tri", "bi"))
            ctx2, ctx1 = (np.concatenate([unpack(x, "<u8").reshape(4, -1) for x in got[c][first:]], axis=1) for c in ("ctx2", "ctx1"))
            bigram = np.unique(middle[context] * n + last, return_inverse=True)[1]
            word = (np.cumsum(_changes(middle)) - 1)[context]
            p1 = shares(shorter, total, d1)[last.astype(np.int64)] + unseen
            p2 = shares(bi[bigram], ctx1[0][word], d2) + left_over(ctx1, d2)[word] * p1
            p3 = shares(tri, ctx2[0][context], d3) + left_over(ctx2, d3)[context] * p2
            sums.append(np.bincount(np.repeat(np.arange(len(lens)), lens), np.log(p3)[place], len(lens)))
        size, total_log = np.concatenate(lens_out), np.concatenate(sums)
        value = pa.array(np.exp(-total_log / np.maximum(size, 1)), mask=size == 0)
        docs = left.column("docs").combine_chunks().flatten()
        return pa.table([*docs.flatten(), pa.array(size), value], names=[*(f.name for f in one.fields), "n_words", "perplexity"])

    kind = T.StructType([*one.fields, T.StructField("n_words", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    return blocks.select("block", "docs", "lens", "words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(of_block, kind)


def score(scratch: Scratch, docs: DataFrame, own: DataFrame) -> DataFrame:
    """The documents with n_words and perplexity, under the model of own: (block, lens, words, trained), written."""
    n_asked, n_own = words_about(docs), int(own.agg(F.sum(F.expr("aggregate(lens, 0L, (a, n) -> a + n)"))).first()[0] or 0)
    waves, shards = waves_of(n_asked), max(1, -(-max(n_asked, n_own) // SHARD_WORDS))
    edges, model = sorted({shards * k // MODEL_WAVES for k in range(MODEL_WAVES + 1)}), None
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = scratch.write(counted(sent(own, low, high, shards, True).repartition(min(high - low, 20_000), "shard")), f"model-{k}")
        model = part if model is None else model.unionByName(part)
        free_shuffles(scratch.spark)
    known = scratch.write(words_counted(model, shards), "model-words")
    for name in ("own", "trained"):
        scratch.drop(name)
    free_shuffles(scratch.spark)
    summed = lambda rows, n: sum((unpack(r.few, "<u8").astype(np.int64) for r in rows.select("few").collect()), np.zeros(n, np.int64)).tolist()
    few, (n, total, *ones) = summed(model, 8), summed(known, 6)
    d1, d2, d3 = discounts(ones), discounts(few[4:]), discounts(few[:4])
    unseen = float(d1 @ [ones[0], ones[1], n - ones[0] - ones[1]]) / max(total, 1) / (n + 1)
    out = None
    for k in range(waves):
        mine = scratch.write(blocks(docs, k, waves), f"blocks-{k}")
        answers = scratch.spark.createDataFrame([], ANSWER)
        if n:
            answers = scratch.write(words_answered(mine, known, shards), f"answers-words-{k}")
            free_shuffles(scratch.spark)
            answers = answers.unionByName(scratch.write(answered(sent(mine, 0, shards, shards, False), model, min(shards, 20_000)), f"answers-{k}"))
            free_shuffles(scratch.spark)
        part = scratch.write(scores(mine, answers, d2, d3, d1, total, unseen, n > 0), f"scored-{k}")
        out = part if out is None else out.unionByName(part)
        for name in (f"blocks-{k}", f"answers-words-{k}", f"answers-{k}"):
            scratch.drop(name)
        free_shuffles(scratch.spark)
    for name in ("model-words", *(f"model-{k}" for k in range(MODEL_WAVES))):
        scratch.drop(name)
    return out


def perplexity(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds n_words and perplexity (null without words; 1 without a model) of each whole text; the text itself goes."""
    scratch = Scratch(spark, "perplexity")
    keep = [f.name for f in keep_fields(docs.schema, ("text", "n_words", "perplexity"))]
    none = spark.createDataFrame([], "block long, lens array<int>, words binary, trained binary")
    return score(scratch, docs.select(*keep, "text"), none if model is None else model.blocks)


def cutoffs(scored: DataFrame, labels: DataFrame, seen: DataFrame) -> DataFrame:
    """(stratum, threshold) by language, null-safe, and a row with ``all`` set for those with too few."""
    held = scored.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id").join(seen, "doc_id", "left_anti").where("perplexity is not null")
    q = F.percentile_approx("perplexity", QUANTILE, 100_000).alias("quantile")
    # the largest value but ODD_MOST, of at least LEAST: only ODD_MOST + 1 rows of a stratum are kept
    below = lambda rows: rows.agg(F.min("perplexity").alias("below"))
    ranked = held.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("perplexity")))).where(F.col("_r") <= ODD_MOST + 1)
    each = held.groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n"), q).where(F.col("n") >= LEAST)
    each = each.join(below(ranked.groupBy(F.col("lang").alias("s"))), F.col("stratum").eqNullSafe(F.col("s")))
    pooled = held.agg(F.count("*").alias("n"), q).where("quantile is not null").crossJoin(below(held.orderBy(F.desc("perplexity")).limit(ODD_MOST + 1)))
    threshold = F.when(F.col("n") >= LEAST, F.least("quantile", "below")).otherwise(F.col("quantile")).alias("threshold")
    return each.select("stratum", threshold, F.lit(False).alias("all")).unionByName(pooled.select(F.lit(None).cast("string").alias("stratum"), threshold, F.lit(True).alias("all")))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: bool = False) -> DataFrame:
    """op7: doc_id, lang, n_words, perplexity, threshold, kept.  sample: the model is fitted on a bounded sample only."""
    scratch = Scratch(spark, "kneser-ney")
    seen = scratch.write(training_ids(docs, labels) if sample else good_ids(labels), "seen")
    docs = docs.select("doc_id", "lang", "text")
    may = may_hold(seen.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id")), "doc_id", SEEN_MOST)
    own = scratch.write(blocks(docs.where(may(F.col("doc_id"))).select("doc_id", "text"), 0), "own")
    marks = scratch.write(trained_bits(own, seen), "trained")
    scored = score(scratch, docs, own.join(F.broadcast(marks), "block").select("block", "lens", "words", "trained"))  # a bit for each document
    cut = scratch.write(cutoffs(scored, labels, seen), "cutoffs")
    few = cut.limit(LANGUAGES_MOST + 1).count() <= LANGUAGES_MOST
    own = cut.where("not all").select("stratum", F.col("threshold").alias("own"))
    rest = cut.where("all").first()  # one row at most
    both = scored.join(F.broadcast(own) if few else own, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    threshold = F.coalesce("own", F.lit(rest.threshold if rest else None).cast("double"))
    return both.select("doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))).alias("kept"))
