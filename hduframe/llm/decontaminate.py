"""Benchmark decontamination: every passage of every document is a BM25 query against an inverted index of test items.

Items are cut into segments of at most SEGMENT words, the documents of the index; a passage is STEP * 2 words and starts every
STEP words, so each segment of a leaked item lies whole in some passage.  A segment is retrieved if its score reaches
LEAST of the score that its own text would get.  A term's postings are the segments that hold it and their impacts, divided by that
own score; segments are in blocks, and beside the postings each term has its largest impact anywhere and in each block that it occurs in.
As in block-max WAND, passages whose terms' largest impacts don't add up to the threshold are left out.  The terms with the smallest
of these, as long as they stay under the threshold together, can't lead to a segment alone; the postings of the others name the blocks to look at,
those whose block maxima don't add up are left out, and only the rest is scored.  All bounds are upper bounds, so everything
above the threshold is retrieved.  A retrieved item is confirmed by
its question and its answer (the last sentence, or the last third where there is one sentence; five words at least): of the
5-word runs of each, at least OVERLAP must occur around the passage.  One edit takes up to five runs, which may be all that a part of
fewer than LONG words has; such a part is also confirmed if a share of at least ALIGN of its words stands there in their order, within
a stretch of at most SLACK words more than the part has.  The larger of the two shares is given.  Items of fewer than RUN words
must be there word by word.  A last sentence of one word is judged with the four words before it, so its question alone is found too.

The index takes some 30 bytes a word of the items and is broadcast; beyond SHARD_CHARS characters of items it is cut by hash into shards of
about that size (an item is never cut), and the texts are scanned for one after another.  The statistics behind the scores are those of all items in
either case, so shards change no result.

Null and empty items match nothing; null and empty texts hold nothing; texts are looked at whole, a bounded window of passages at a time.
An item that comes twice is found twice; equal rows are found alike, each for itself; a doc_id is not looked at.  An empty table gives no rows,
an empty benchmark finds nothing.  Words are lower-cased runs of letters, digits and underscores.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, keep_fields, slices

WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")
SEGMENT = STEP = 32
LEAST, OVERLAP, RUN = 0.6, 0.5, 5
LONG, ALIGN, SLACK = 14, 0.75, 2  # parts of LONG words have ten runs, of which one edit leaves half
SHARD_CHARS, BLOCK = 32 << 20, 8
WINDOW, TEXT_PART = 8192, 1 << 20  # passages, and characters of a text, that are dealt with at a time
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def ids_of(text: str | None, numbers: Callable[[list[str]], Iterable[int]]) -> np.ndarray:
    """The number of each word, by part so that a very long text never is a list of strings."""
    text, at, out = (text or "").lower(), 0, [np.empty(0, np.int64)]
    while at < len(text):
        end = min(len(text), at + TEXT_PART)
        if end < len(text) and (m := WORDS.match(text, end)) and WORDS.match(text[end - 1]):
            end = m.end()  # not within a word
        words = WORDS.findall(text, at, end)
        out.append(np.fromiter(numbers(words), np.int64, len(words)))
        at = end
    return out[-1] if len(out) < 3 else np.concatenate(out)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def runs(words: list, size: int) -> set[tuple]:
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def aligned(part: list, text: list) -> float:
    """The share of part's words that come in their order in a stretch of text, SLACK words longer at most; 0 under ALIGN."""
    known, width, best = set(part), len(part) + SLACK, 0
    least = ALIGN * len(part)
    hits = np.concatenate([[0], np.cumsum([w in known for w in text])])
    for k in range(len(text)):
        if hits[min(k + width, len(text))] - hits[k] < max(least, best + 1) or text[k] not in known:
            continue
        row = [0] * (len(part) + 1)  # longest common subsequence
        for w in text[k : k + width]:
            before = 0
            for j, x in enumerate(part, 1):
                before, row[j] = row[j], before + 1 if w == x else max(row[j], row[j - 1])
        best = max(best, row[-1])
    return best / len(part) if best >= least else 0.0


def edges_of(n: int) -> list[int]:
    """Where an item of n words is cut into segments."""
    parts = -(-n // SEGMENT)
    return [n * k // parts for k in range(parts + 1)]


@dataclass
class Item:
    n_words: int
    run: int  # RUN, or the words of a shorter item
    question: set[tuple]
    answer: set[tuple]
    short: tuple[list | None, list | None]  # words of question and answer, where one edit could take half of the runs


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of n places from first: which range each place is of, and the places."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


class Index:
    """The inverted index of some items.  corpus gives, for terms, the segments that hold each among all items, the number of all
    segments and that of their words; without it these items are all."""

    def __init__(self, rows: list[tuple[int, str | None]], corpus: Callable[[list[str]], tuple[np.ndarray, int, int]] | None = None):
        self.vocabulary: dict[str, int] = {}
        numbers = lambda words: (self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)
        self.item_ids, self.cuts, flat, starts = [], [], [], [0]  # items with words
        for item_id, text in rows:
            last = next((w for w in map(words_of, reversed(SENTENCE.split(text or ""))) if w), None)
            if last is None:
                continue
            ids = ids_of(text, numbers).astype(np.int32)
            n = len(ids)
            self.item_ids.append(item_id)
            self.cuts.append(n - len(last) if len(last) < n else max(1, 2 * n // 3))
            flat.append(ids)
            starts.append(starts[-1] + n)
        self.words, self.starts = np.concatenate([np.empty(0, np.int32), *flat]), np.array(starts)
        self.known: dict[int, Item] = {}
        edges = [edges_of(b - a) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.item_of = np.repeat(np.arange(len(edges)), [len(e) - 1 for e in edges])
        size = np.concatenate([np.empty(0, np.int64), *(np.diff(e) for e in edges)]).astype(np.int64)
        n, n_terms = len(size), len(self.vocabulary)
        self.n_blocks = -(-n // BLOCK)
        # a posting for each term of each segment
        key, count = np.unique(self.words.astype(np.int64) * max(1, n) + np.repeat(np.arange(n), size), return_counts=True)
        term, segment = key // max(1, n), key % max(1, n)
        if corpus:
            df, n_all, n_words = corpus(list(self.vocabulary))
        else:
            df, n_all, n_words = np.bincount(term, minlength=n_terms), n, int(size.sum())
        idf = np.log(1 + (n_all - df + 0.5) / (df + 0.5))
        impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[segment] * (max(1, n_all) / max(1, n_words))))
        own = np.bincount(segment, impact, n)
        #: Postings in the order of terms and segments: term * n_blocks * BLOCK + segment, and the impact as a share.
        self.place, self.share = term * (self.n_blocks * BLOCK) + segment, (impact / own[segment]).astype(np.float32)
        at_block = term * self.n_blocks + segment // BLOCK
        start = np.flatnonzero(np.diff(at_block, prepend=-1))
        #: Block maxima in the order of terms and blocks: term * n_blocks + block; of each term the first of its own.
        self.block, self.block_most = at_block[start], np.maximum.reduceat(self.share, start) if n else np.empty(0, np.float32)
        self.block_of = (self.block % max(1, self.n_blocks)).astype(np.int32)
        self.first = np.searchsorted(self.block, np.arange(n_terms + 1) * self.n_blocks)
        self.most = np.maximum.reduceat(self.block_most, self.first[:-1]) if n else np.empty(0, np.float32)

    def numbers(self, words: list[str]) -> Iterable[int]:
        """Of words; -1 for those that no item has."""
        return map(self.vocabulary.get, words, repeat(-1))

    def item(self, k: int) -> Item:
        if k not in self.known:
            words = self.words[self.starts[k] : self.starts[k + 1]].tolist()
            size = min(RUN, len(words))  # parts of fewer words are lengthened to that many
            question, answer = words[: max(self.cuts[k], size)], words[min(self.cuts[k], len(words) - size) :]
            short = tuple(p if RUN <= len(p) < LONG else None for p in (question, answer))
            self.known[k] = Item(len(words), size, runs(question, size), runs(answer, size), short)
        return self.known[k]

    def retrieve(self, term: np.ndarray, piece: np.ndarray, n: int) -> list[tuple[int, int, float]]:
        """(first piece of the passage, segment, share) over the threshold; term and piece: known terms and the STEP words they lie in.
        A passage is a piece and the next one, for pieces up to n - 1; callers leave an empty piece between documents."""
        low, n_terms = np.float32(LEAST - 1e-4), len(self.vocabulary)
        seen = distinct(piece.astype(np.int64) * n_terms + term)
        piece, term = seen // n_terms, seen % n_terms
        bound = np.bincount(piece, self.most[term], n + 1)
        live = bound[:n] + bound[1 : n + 1] >= low  # passages that some segment could match
        # a row for each term of each live passage; a query term counts once
        rows = [(p[ok], term[ok]) for p in (piece, piece - 1) if (ok := (p >= 0) & (p < n) & live[np.clip(p, 0, n - 1)]).any()]
        if not rows:
            return []
        key = distinct(np.concatenate([p * n_terms + t for p, t in rows]))
        passage, term = key // n_terms, key % n_terms
        # of each passage the terms with the smallest maxima, while these stay under the threshold together, lead nowhere
        order = np.lexsort((self.most[term], passage))
        most = self.most[term[order]].astype(np.float64)
        total = np.cumsum(most)
        begin = np.flatnonzero(np.diff(passage, prepend=-1))
        n_terms = np.diff(np.append(begin, len(passage)))
        total -= np.repeat(total[begin] - most[begin], n_terms)
        leads = order[total >= low]
        rest = np.zeros(n + 1)  # what the others of each passage can add
        np.maximum.at(rest, passage[order[total < low]], total[total < low])
        of, at = spread(self.first[term[leads]], np.diff(self.first)[term[leads]])
        # blocks that the leading terms name, without those in which their maxima and all the rest stay under the threshold
        key = passage[leads][of] * self.n_blocks + self.block_of[at]
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(start):
            return []
        could = np.add.reduceat(self.block_most[at[by_key]].astype(np.float64), start) + rest[key[start] // self.n_blocks] >= low
        found = key[start[could]]
        row_of = np.zeros(n + 1, np.int64)
        row_of[passage[begin]] = np.arange(len(begin))
        # a passage's terms are added up over all of their blocks, or looked up for the named blocks, whichever are fewer
        many = np.add.reduceat(np.diff(self.first)[term], begin)
        named = np.bincount(row_of[found // self.n_blocks], minlength=len(begin))
        over_all = many <= 4 * named * n_terms
        rows, out = np.flatnonzero(over_all & (named > 0)), []
        chunk = np.cumsum(np.maximum(many[rows], self.n_blocks)) >> 21
        for r in np.split(rows, np.flatnonzero(np.diff(chunk)) + 1):
            of, at = spread(begin[r], n_terms[r])
            of_block, place = spread(self.first[term[at]], np.diff(self.first)[term[at]])
            total = np.bincount(of[of_block] * self.n_blocks + self.block_of[place], self.block_most[place], len(r) * self.n_blocks)
            hit = np.flatnonzero(total >= low)
            out += self._scored(passage[begin[r]][hit // self.n_blocks], hit % self.n_blocks, term, begin, n_terms, row_of, low)
        found = found[~over_all[row_of[found // self.n_blocks]]]
        for a in range(0, len(found), 1 << 14):
            p, block = found[a : a + (1 << 14)] // self.n_blocks, found[a : a + (1 << 14)] % self.n_blocks
            of, at = spread(begin[row_of[p]], n_terms[row_of[p]])
            ok = np.bincount(of, self._at(self.block, self.block_most, term[at] * self.n_blocks + block[of]), len(p)) >= low
            out += self._scored(p[ok], block[ok], term, begin, n_terms, row_of, low)
        return out

    def _scored(self, p: np.ndarray, block: np.ndarray, term: np.ndarray, begin: np.ndarray, n_terms: np.ndarray, row_of: np.ndarray, low: float) -> list[tuple[int, int, float]]:
        """The segments of some blocks that reach the threshold for their passages."""
        out: list[tuple[int, int, float]] = []
        for a in range(0, len(p), 1 << 11):
            q = np.repeat(p[a : a + (1 << 11)], BLOCK)
            segment = np.repeat(block[a : a + (1 << 11)] * BLOCK, BLOCK) + np.tile(np.arange(BLOCK), len(q) // BLOCK)
            of, at = spread(begin[row_of[q]], n_terms[row_of[q]])
            share = np.bincount(of, self._at(self.place, self.share, term[at] * (self.n_blocks * BLOCK) + segment[of]), len(q))
            hit = share >= low
            out += zip(q[hit].tolist(), segment[hit].tolist(), share[hit].tolist(), strict=True)
        return out

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The value of each key, 0 where there is none."""
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], np.float32(0))

    def confirm(self, words: np.ndarray, found: list[tuple[int, int, float]], first: int) -> list[dict]:
        """Items of one document, given as its words' numbers; found: retrieved segments, first: the document's first piece."""
        best: dict[int, dict] = {}
        for p, segment, share in found:
            k = int(self.item_of[segment])
            item = self.item(k)
            a, b = (p - first) * STEP - item.n_words, (p - first + 2) * STEP + item.n_words
            text = words[max(0, a) : b].tolist()
            near = runs(text, item.run)
            q, r = (len(x & near) / len(x) for x in (item.question, item.answer))
            if item.short[0] and q < OVERLAP:
                q = max(q, aligned(item.short[0], text))
            if item.short[1] and r < OVERLAP <= q:
                r = max(r, aligned(item.short[1], text))
            if q >= OVERLAP and r >= OVERLAP and share > best.get(k, {"score": 0.0})["score"]:
                best[k] = {"item_id": self.item_ids[k], "score": share, "question": q, "answer": r}
        return [best[k] for k in sorted(best)]


LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question", T.DoubleType()), T.StructField("answer", T.DoubleType())])
ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))


def statistics(benchmark: DataFrame) -> DataFrame:
    """(term, n): the segments that hold each term; n of the empty term is the number of segments, and of the blank one that of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            terms, n = [], {"": 0, " ": 0}
            for text in part.column(0).to_pylist():
                if words := words_of(text):
                    edges = edges_of(len(words))
                    n[""] += len(edges) - 1
                    n[" "] += len(words)
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        terms += set(words[a:b])
            yield pa.RecordBatch.from_pydict({"term": pa.array([*terms, *n], pa.string()), "n": pa.array([1] * len(terms) + [*n.values()], pa.int64())})

    return benchmark.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[Index]:
    """The index, in shards where the items are many; each is built when it is asked for."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // SHARD_CHARS))
    stats = Scratch(spark, "decontaminate").write(statistics(benchmark), "statistics") if shards > 1 else None

    def corpus(terms: list[str]) -> tuple[np.ndarray, int, int]:
        wanted = spark.createDataFrame([(t,) for t in [*terms, "", " "]], "term string")  # those of one shard
        n = {r.term: r.n for r in stats.join(wanted, "term").collect()}
        return np.array([n[t] for t in terms], np.int64), n[""], n[" "]

    for k in range(shards):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).select("item_id", "text").collect()  # about SHARD_CHARS characters
        yield Index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), corpus if stats else None)


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, leaks: str = "leaks") -> DataFrame:
    """Adds the items that each text holds, array of (item_id, score, question, answer); a column of that name is replaced."""
    out = docs.select(*[f.name for f in keep_fields(docs.schema, (leaks,))]).withColumn(leaks, F.array().cast(T.ArrayType(LEAK)))
    for index in indexes(spark, benchmark):
        out = _scan(out, spark.sparkContext.broadcast(index), leaks)
    return out


def _scan(docs: DataFrame, shared, leaks: str) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for part in slices(batches, 256):
            words = [ids_of(t.as_py(), index.numbers) for t in part.column("text")]
            size = np.array([len(w) for w in words])
            pieces = -(-size // STEP) + 1  # and an empty one, so that no passage holds words of two texts
            first = np.concatenate([[0], np.cumsum(pieces)])
            found: dict[int, list] = {}
            if size.sum():
                term = np.concatenate(words)
                piece = np.concatenate([at + np.arange(n) // STEP for at, n in zip(first[:-1].tolist(), size.tolist(), strict=True)])
                term, piece = term[term >= 0], piece[term >= 0]
                cuts = np.searchsorted(piece, np.arange(0, int(first[-1]) + 2 * WINDOW, WINDOW))
                behind = np.searchsorted(piece, np.arange(0, int(first[-1]) + 2 * WINDOW, WINDOW) + 1)
                for k, at in enumerate(range(0, int(first[-1]), WINDOW)):  # and the first piece of the next window
                    a, b = cuts[k], behind[k + 1]
                    if b > a:
                        for p, *hit in index.retrieve(term[a:b], piece[a:b] - at, WINDOW):
                            found.setdefault(int(np.searchsorted(first, p + at, "right")) - 1, []).append((p + at, *hit))
            old = part.column(leaks).to_pylist()
            new = [(old[i] or []) + (index.confirm(words[i], found[i], int(first[i])) if i in found else []) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(new, ARROW) if n == leaks else part.column(n) for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def leaked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op3: a row for each document and item that it holds."""
    hits = scan(spark, docs.select("doc_id", "text"), benchmark).where(F.size("leaks") > 0)
    return hits.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", F.col("x.score").alias("bm25_share"), F.col("x.question").alias("question_overlap"), F.col("x.answer").alias("answer_overlap"))
