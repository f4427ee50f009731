"""Near-duplicate documents: MinHash signatures joined by a multi-index on their Hamming distance, links confirmed on full sets.

Words are lower-cased (A-Z) runs without white space; a document's set has its distinct 5-word shingles as 64-bit hashes.
Documents of one set form a class, of which only the smallest doc_id goes on.  Its signature has CHUNKS * WIDTH symbols of
24 bits.  Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 places have a chunk with at most ERRORS
differing symbols (pigeonhole), so the index keys are, for each chunk, all ways to leave out ERRORS of its symbols: all pairs
within that distance share a key.  At a similarity of 0.75 a pair lies beyond the distance, or is missed by the
index, with a probability of about one in a million (binomial tails), and less above.

Rows of a key are compared in blocks of bounded size by a longer signature of 8-bit symbols, vectorised; pairs five
deviations below the threshold can't be links.  The pairs of a key are never all put out: first each block is compared with itself
and with the key's first block (a hub), which is linear in the key's rows, and a spanning forest of the likeliest links is
confirmed on the full sets; then the keys that still hold several components are compared again.  There all rows but those
of the key's largest component meet all others, a pair of different components under the first key that it shares; only the rows
of likely pairs get their full sets, pairs are confirmed in place, and only links come out.  So no link that could join two
components stays unconfirmed, and neither copies nor near copies of one text are expanded into pairs.

Each input row is a document of its own, numbered when its features are written; texts are found again by doc_id and the MD5 of
the text.  Rows may share a doc_id or have none: each gets a row in the result, and one row of a component is kept, that with
the smallest doc_id, then the smallest MD5 (null doc_ids come last; a component of these alone has a null component_id).
Null and empty texts, and texts without words, have empty sets, stand alone and are all kept, repeated rows too; a text of
fewer than five words is one shingle; equal texts are copies of one another.  Texts of any length are read whole, and a set takes eight
bytes a word while it is compared.  An empty table gives no rows.  Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, HOT_LEAST, Cache, Scratch, free_shuffles, hot_join, may_hold, slices
from .components import components

SIZE, NUMERATOR, DENOMINATOR = 5, 75, 100
CHUNKS, WIDTH, ERRORS = 10, 3, 1
INDEXED, LONG = CHUNKS * WIDTH, 256
#: Least share of equal symbols of the longer signature: 0.75 less five deviations of a binomial of LONG draws.
LEAST = 0.75 - 5 * (0.75 * 0.25 / LONG) ** 0.5
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Texts that are needed again are told from the others by a filter with room for so many (16 to 32 bits each, sent to all tasks).
WANTED_MOST = 5_000_000
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, INDEXED + LONG, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, INDEXED + LONG, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SIZE)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    def __init__(self):
        self.words = Cache(lambda w: xxhash.xxh64_intdigest(w), 300_000)

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and just the six white-space characters
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = max(1, len(w) - SIZE + 1)
        h = np.zeros(n, np.uint64)
        for k in range(min(SIZE, len(w))):
            h += w[k : k + n] * _POWERS[k]
        if len(w) < SIZE:
            h += np.uint64(len(w))
        return np.unique(mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set, as mixed 32-bit integers."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(INDEXED + LONG, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        np.minimum(low, ((h[at : at + 512, None] ^ _XOR) * _MUL).min(0), out=low)
    return (mix(low.astype(np.uint64) + np.arange(len(low), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a text; null is empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def tag(doc_id: str, key: Column) -> Column:
    """doc_id (a long or null) and text_key in one, never null."""
    return F.concat(key, F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def features(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, text_key, n_shingles, fp (128-bit digest of the set), idx (INDEXED symbols), est (LONG bytes).
    Rows are numbered by partition and place, which holds once the result is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, row = Shingler(), TaskContext.get().partitionId() << 36
        for part in slices(batches):
            n, fp, idx, est = [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingler(text)
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    idx.append((sig[:INDEXED] >> np.uint32(8)).astype("<i4"))
                    est.append((sig[INDEXED:] & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    fp.append(None)
                    idx.append(np.empty(0, "<i4"))
                    est.append(None)
            rows = pa.array(np.arange(row, row + part.num_rows), pa.int64())
            row += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(idx, pa.list_(pa.int32())), pa.array(est, pa.binary())],
                names=["row", "doc_id", "text_key", "n_shingles", "fp", "idx", "est"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key")).mapInArrow(run, "row long, doc_id long, text_key binary, n_shingles long, fp binary, idx array<int>, est binary")


#: The places of the symbols that each of a document's keys is made of.
WAYS = [[c * WIDTH + x for x in way] for c in range(CHUNKS) for way in combinations(range(WIDTH), WIDTH - ERRORS)]


def keys(reps: DataFrame) -> DataFrame:
    """(way, key, doc): the index entries, each of WIDTH - ERRORS symbols and the number of the way they were chosen."""
    entry = F.array(*(F.xxhash64(F.lit(k), *(F.col("idx")[x] for x in way)) for k, way in enumerate(WAYS)))
    return reps.select(F.posexplode(entry).alias("way", "key"), F.col("row").alias("doc"))


class Groups:
    """Rows of whole groups (one key and pair of blocks each) as arrays."""

    def __init__(self, table: pa.Table):
        self.t = {c: table.column(c).to_numpy() for c in ("key", "way", "bi", "bj", "mine", "doc", "comp", "n")}
        for c, kind in (("est", np.uint8), ("idx", np.int32)):
            if c in table.column_names:
                raw = table.column(c).combine_chunks()
                flat = b"".join(raw.to_pylist()) if c == "est" else raw.flatten().to_numpy()
                self.t[c] = (np.frombuffer(flat, kind) if c == "est" else flat).reshape(len(self.t["key"]), -1)
        self.shingles = table.column("shingles") if "shingles" in table.column_names else None
        new = np.ones(len(self.t["key"]), bool)
        new[1:] = np.logical_or.reduce([self.t[c][1:] != self.t[c][:-1] for c in ("key", "bi", "bj")])
        self.group = np.cumsum(new)

    def likely(self, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of the first rows that can be links between components, and their equal symbols; some at a time."""
        t, group = self.t, self.group[:rows]
        last = np.append(np.flatnonzero(group[1:] != group[:-1]), rows - 1)
        end = np.repeat(last, np.diff(np.concatenate([[-1], last])))
        step, row = 1, np.arange(rows)
        while True:
            row = row[row + step <= end[row]]  # rows whose group goes on so far
            if not len(row):
                return
            for at in range(0, len(row), 1 << 15):
                a = row[at : at + (1 << 15)]
                b = a + step
                ok = (t["comp"][a] != t["comp"][b]) & ((t["bi"][a] == t["bj"][a]) | (t["mine"][a] != t["mine"][b]))
                ok &= DENOMINATOR * np.minimum(t["n"][a], t["n"][b]) >= NUMERATOR * np.maximum(t["n"][a], t["n"][b])
                a, b = a[ok], b[ok]
                same = (t["est"][a] == t["est"][b]).sum(1)
                ok = same >= LEAST * LONG
                if ok.any():
                    yield a[ok], b[ok], same[ok]
            step += 1


def _named(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(x), 1 << 16):
        a, b = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def forest(g: Groups, rows: int) -> Iterator[pa.RecordBatch]:
    """Of each group a spanning forest of its likeliest pairs."""
    found = list(g.likely(rows))
    if found:
        a, b = spanning(rows, *(np.concatenate(x) for x in zip(*found, strict=True)))
        yield from _named(g.t["doc"][a], g.t["doc"][b])


def first_shared(g: Groups, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The likely pairs of the first rows that share no earlier key; some at a time."""
    idx, way = g.t["idx"], g.t["way"]
    for a, b, _ in g.likely(rows):
        same = idx[a] == idx[b]
        shared = np.logical_and.reduce([same[:, [w[k] for w in WAYS]] for k in range(WIDTH - ERRORS)])
        first = shared.argmax(1) == way[a]  # a pair is looked at under the first key that it shares
        yield a[first], b[first]


PARTNERED = "key long, way int, bi int, bj int, mine int, doc long, comp long"


def partnered(g: Groups, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of pairs that are to be confirmed: linear in the group's rows, whatever their pairs."""
    asked = np.zeros(rows, bool)
    for a, b in first_shared(g, rows):
        asked[a] = asked[b] = True
    names = [c.split()[0] for c in PARTNERED.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(g.t[c][:rows][asked]) for c in names], names=names)


def links(g: Groups, rows: int) -> Iterator[pa.RecordBatch]:
    """The links between different components, except within what they have joined by then."""
    root = np.arange(rows)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    pairs = list(first_shared(g, rows))
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    docs, out = g.t["doc"], []
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
        if not len(part):
            continue
        x = int(a[part[0]])
        own = np.frombuffer(g.shingles[x].as_py(), np.uint64)
        mine = find(x)
        for y in b[part].tolist():
            theirs = find(y)
            if mine == theirs:
                continue
            other = np.frombuffer(g.shingles[y].as_py(), np.uint64)
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            both = int((own[at] == other).sum())
            if DENOMINATOR * both >= NUMERATOR * (len(own) + len(other) - both):
                root[max(mine, theirs)] = mine = min(mine, theirs)
                out.append((x, y))
    if out:
        x, y = np.array(out).T
        yield from _named(docs[x], docs[y])


def _grouped(rows: DataFrame, of_groups, kind: str = "a long, b long") -> DataFrame:
    """of_groups over rows (key, bi, bj, ...), each group in one partition; some whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 20_000 and held.nbytes < 32 << 20:
                continue
            g = Groups(held)
            whole = int(np.searchsorted(g.group, g.group[-1]))  # the last group may go on in the next batch
            if whole:
                yield from of_groups(g, whole)
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from of_groups(Groups(held), held.num_rows)

    return rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(run, kind)


def spanning(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges with likeness s a spanning forest that prefers the likeliest, by bands of likeness."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    out: list[int] = []
    band = s >> 2
    for level in np.unique(band)[::-1]:
        e = np.flatnonzero(band == level)
        label = np.arange(n)
        while not np.array_equal(label, root[label]):
            label = root[label]
        e = e[label[a[e]] != label[b[e]]]
        pair = label[a[e]] * n + label[b[e]]
        for k in e[np.unique(pair, return_index=True)[1]].tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append(k)
    return a[out], b[out]


def sets(texts: DataFrame) -> DataFrame:
    """(doc, shingles) of (doc, text): sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingler(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["doc", "shingles"])

    return texts.select("doc", "text").mapInArrow(run, "doc long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            keep = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(DENOMINATOR * same >= NUMERATOR * (len(both) - same))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_x = pairs.join(grown(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x"))), "a")
    with_y = with_x.join(grown(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))), "b")
    return with_y.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))


def grown(df: DataFrame) -> DataFrame:
    """A table that grows with the documents: it is joined by a shuffle whatever its size, so that plans are the same at every size."""
    return df.hint("merge")


def order() -> Column:
    """Of documents: the least of a component is kept."""
    return F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_key", "row")


def near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, kept, rep (the smallest doc_id of the same set), text_key."""
    scratch = Scratch(spark, "near-dedup")
    f = scratch.write(features(docs), "features")
    classes = f.where("n_shingles > 0").groupBy("fp").agg(F.min(order()).alias("m")).select("fp", F.col("m.row").alias("rep"), F.col("m.doc_id").alias("rep_id"))
    named = hot_join(f.where("n_shingles > 0").select("row", "doc_id", "text_key", "n_shingles", "fp"), grown(classes), "fp").drop("fp")
    alone = f.where("n_shingles = 0").select("row", "doc_id", "text_key", "n_shingles", F.col("row").alias("rep"), F.col("doc_id").alias("rep_id"))
    member = scratch.write(named.unionByName(alone), "member")
    firsts = member.where("row = rep and n_shingles > 0").select("row", "doc_id", "text_key")
    entries = scratch.write(keys(f.select("row", "idx").join(grown(firsts.select("row")), "row", "left_semi")), "keys")
    count = scratch.write(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = scratch.write(hot_join(entries, grown(count), "key", "inner", count), "shared")
    scratch.drop("keys")
    free_shuffles(spark)
    known = f.select(F.col("row").alias("doc"), F.col("n_shingles").alias("n"), "est", "idx").join(grown(shared.select("doc").distinct()), "doc", "left_semi")
    known = scratch.write(known, "known")

    def blocks(rows: DataFrame, mine: Column, others: Column, *more: str) -> DataFrame:
        """Rows (way, key, doc, comp) of block ``mine`` of their key, dealt to the pairs with each of the blocks ``others``."""
        other = rows.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(others))
        return other.select("way", "key", F.least("mine", "other").cast("int").alias("bi"), F.greatest("mine", "other").cast("int").alias("bj"), "mine", "doc", "comp", *more)

    many = F.ceil(F.col("size") / BLOCK)
    mine = F.pmod(F.xxhash64("doc"), many)
    hub = F.when(F.col("mine") == 0, F.sequence(F.lit(0).cast("long"), many - 1)).otherwise(F.array(F.lit(0).cast("long"), F.col("mine").cast("long")))
    first = blocks(shared.withColumn("comp", F.col("doc")), mine, hub).join(grown(known.drop("idx")), "doc")
    first = scratch.write(_grouped(first, forest).distinct(), "pairs-1")
    free_shuffles(spark)
    # what later pairs can ask for lies among the documents that are like another, or in a key of several blocks
    likely = first.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(shared.where(many > 1).select("doc")).distinct()
    likely = scratch.write(likely, "likely")
    wanted = scratch.write(likely.join(firsts.select(F.col("row").alias("doc"), tag("doc_id", F.col("text_key")).alias("tag")), "doc"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(tag("doc_id", text_key()).alias("tag"), "text")
    texts = texts.where(may_hold(wanted, "tag", WANTED_MOST)("tag")).groupBy("tag").agg(F.first("text").alias("text"))  # one of repeated rows
    whole = scratch.write(sets(texts.join(grown(wanted), "tag")), "sets")
    free_shuffles(spark)
    sure = scratch.write(confirmed(first, whole), "links-1")
    free_shuffles(spark)
    comps = components(scratch, sure, "comps-1")

    labelled = shared.select("way", "key", "doc").join(grown(likely), "doc", "left_semi")
    labelled = labelled.join(grown(comps.select(F.col("node").alias("doc"), "comp")), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    labelled = scratch.write(labelled.join(grown(known.select("doc", "n")), "doc"), "labelled")
    free_shuffles(spark)
    # Keys of several components.  Their largest component needs no pairs within itself, so its blocks meet only those of the
    # others; blocks are bounded in rows and in the bytes of full sets.
    parts = labelled.groupBy("key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    n_blocks = lambda size, total: F.ceil(F.greatest(size / BLOCK, total * 8 / BLOCK_BYTES)).cast("long")
    open_keys = parts.groupBy("key").agg(F.count("*").alias("n_comps"), F.max(F.struct("size", "total", "comp")).alias("top"), F.sum("size").alias("size"), F.sum("total").alias("total")).where("n_comps > 1")
    open_keys = open_keys.select("key", F.col("top.comp").alias("major"), n_blocks(F.col("top.size"), F.col("top.total")).alias("major_blocks"), n_blocks(F.col("size") - F.col("top.size"), F.col("total") - F.col("top.total")).alias("minor_blocks"))
    of_major = F.col("comp") == F.col("major")
    mine = F.when(of_major, F.col("minor_blocks") + F.pmod(F.xxhash64("doc"), F.col("major_blocks"))).otherwise(F.pmod(F.xxhash64("doc"), F.col("minor_blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("minor_blocks") + F.when(of_major, F.lit(0).cast("long")).otherwise(F.col("major_blocks")) - 1)
    opened = blocks(hot_join(labelled, grown(open_keys), "key", "inner"), mine, others).join(grown(known), "doc")
    opened = scratch.write(_grouped(opened, partnered, PARTNERED), "opened")
    free_shuffles(spark)
    more = scratch.write(_grouped(opened.join(grown(known), "doc").join(grown(whole), "doc"), links).distinct().select(F.col("a").alias("u"), F.col("b").alias("v")), "links-2")
    if more.isEmpty():
        final = comps
    else:
        # components of the first round, joined by the further links
        at = comps.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
        bt = comps.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
        joined = more.join(at, "u", "left").join(bt, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        over = components(scratch, joined, "comps-2").select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        lone = more.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(comps, "node", "left_anti").select("node", F.col("node").alias("comp"))
        every = scratch.write(comps.unionByName(lone), "comps-all")
        final = scratch.write(hot_join(every, over, "comp").select("node", F.coalesce("top", "comp").alias("comp")), "final")
    free_shuffles(spark)
    for name in ("features", "shared", "known", "pairs-1", "sets", "links-1", "labelled", "opened"):  # the result doesn't read these
        scratch.drop(name)
    ids = scratch.write(final.join(firsts.withColumnRenamed("row", "node"), "node"), "ids")
    least = ids.withColumnRenamed("node", "row").groupBy("comp").agg(F.min(order()).alias("m")).select("comp", F.col("m.doc_id").alias("component_id"), F.col("m.row").alias("first"))
    linked = hot_join(ids.select("comp", F.col("node").alias("rep")), least, "comp").drop("comp")
    out = hot_join(member, grown(linked), "rep")
    return out.select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("rep_id")).otherwise(F.col("component_id")).alias("component_id"), (F.col("row") == F.coalesce("first", "rep")).alias("kept"), F.col("rep_id").alias("rep"), "text_key")


def survivors(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; of rows with the same doc_id and text one, unless the text has no words."""
    scratch = Scratch(spark, "survivors")
    seen = near_dedup(spark, docs).where("n_shingles > 0").groupBy(tag("doc_id", F.col("text_key")).alias("tag")).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    marked = scratch.write(seen.where("not kept or rows > 1"), "marked")
    tagged = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("mine")).select("doc", tag("mine", text_key("doc.text")).alias("tag"))
    may = may_hold(marked, "tag", WANTED_MOST)
    some = tagged.where(may("tag"))  # only these are shuffled: the marked ones and a few others
    rows = marked.agg(F.sum("rows")).first()[0] or 0
    hot = marked.where(F.col("rows") > max(rows // HOT, HOT_LEAST)).select("tag")  # fewer than HOT
    out = tagged.where(~may("tag")).unionByName(some.join(F.broadcast(hot), "tag", "left_anti").join(grown(marked), "tag", "left_anti"))
    again = marked.where("kept")
    if not again.isEmpty():
        out = out.unionByName(some.groupBy("tag").agg(F.first("doc").alias("doc")).join(grown(again), "tag", "left_semi").select("doc", "tag"))
    return out.select("doc.*")
