import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents, odd_frame

from hduframe.llm import decontaminate as dc

ITEMS = "item_id long, text string"


def words(r, n):
    return [r.choice("ka lo mi ne pu ra se ti".split()) + r.choice("ban den fal gor hin".split()) + r.choice(["", "x", "yy"]) for _ in range(n)]


def item(r):
    w = words(r, r.randrange(8, 90))
    w[len(w) * 3 // 4] += "."
    return " ".join(w).capitalize() + "."


def plain_scores(items, query, all_items=None):
    """BM25 of a query's distinct words for each segment, as a share of the segment's score for its own words; in dictionaries."""

    def segments(rows):
        out = []
        for k, w in rows:
            n = -(-len(w) // dc.SEGMENT)
            out += [(k, w[len(w) * i // n : len(w) * (i + 1) // n]) for i in range(n)]
        return out

    every = segments(enumerate(map(dc.words_of, all_items or items)))
    df = Counter(x for _, s in every for x in set(s))
    mean = sum(len(s) for _, s in every) / len(every)

    def score(s, terms):
        out = 0.0
        for x, c in Counter(s).items():
            if x in terms:
                out += math.log(1 + (len(every) - df[x] + 0.5) / (df[x] + 0.5)) * c * (dc.K1 + 1) / (c + dc.K1 * (1 - dc.B + dc.B * len(s) / mean))
        return out

    return [score(s, query) / score(s, set(s)) for _, s in segments(enumerate(map(dc.words_of, items)))]


@pytest.mark.parametrize("n_items", [5, 120, 700])
def test_retrieval_against_brute_force(n_items):
    """Pruning by bounds loses no segment over the threshold and finds none below, and scores are those of BM25."""
    r = random.Random(1)
    items = [item(r) for _ in range(n_items)]
    index = dc.Index(list(enumerate(items)))
    texts = [" ".join(words(r, 150)) for _ in range(8)]
    for k in range(8):
        part = items[k % n_items].split()
        texts.append(texts[k][:300] + " " + " ".join(part[k : 40 + k]) + " " + texts[k][300:])
    hits = 0
    for t in texts:
        w = dc.words_of(t)
        known = dc.ids_of(t, index.numbers)
        at = np.flatnonzero(known >= 0)
        n = -(-len(w) // dc.STEP) + 1
        got = {(p, s): x for p, s, x in index.retrieve(known[at], at // dc.STEP, n)}
        for p in range(n):
            want = plain_scores(items, set(w[p * dc.STEP : (p + 2) * dc.STEP]))
            for s, x in enumerate(want):
                if (p, s) in got:
                    assert got[p, s] == pytest.approx(x, abs=1e-4)
                assert x < dc.LEAST if (p, s) not in got else x >= dc.LEAST - 2e-4
            hits += sum(x >= dc.LEAST for x in want)
    assert hits >= 8


def plain_leaks(items, text):
    """Every item against every passage in strings, by the definition of the module."""
    w, out = dc.words_of(text), set()
    for k, t in enumerate(items):
        iw = dc.words_of(t)
        if not iw:
            continue
        sentences = [x for x in map(dc.words_of, dc.SENTENCE.split(t)) if x]
        cut = len(iw) - len(sentences[-1]) if len(sentences) > 1 else max(1, 2 * len(iw) // 3)
        size = min(dc.RUN, len(iw))
        parts = iw[: max(cut, size)], iw[min(cut, len(iw) - size) :]
        at = [0]
        for j in items[:k]:
            at.append(at[-1] + -(-len(dc.words_of(j)) // dc.SEGMENT))
        mine = range(at[-1], at[-1] + -(-len(iw) // dc.SEGMENT))
        for p in range(-(-len(w) // dc.STEP) + 1):
            if max(plain_scores(items, set(w[p * dc.STEP : (p + 2) * dc.STEP]))[s] for s in mine) < dc.LEAST:
                continue
            near = w[max(0, p * dc.STEP - len(iw)) : (p + 2) * dc.STEP + len(iw)]
            there = {tuple(near[j : j + size]) for j in range(len(near) - size + 1)}

            def share(part, near=near, there=there, size=size):
                own = {tuple(part[j : j + size]) for j in range(len(part) - size + 1)}
                x = len(own & there) / len(own)
                return max(x, dc.aligned(part, near)) if x < dc.OVERLAP and dc.RUN <= len(part) < dc.LONG else x

            if min(map(share, parts)) >= dc.OVERLAP:
                out.add(k)
    return out


def test_confirmation_against_brute_force(spark):
    r = random.Random(7)
    items = [item(r) for _ in range(12)]
    texts = []
    for k in range(36):
        part = items[k % 12].split()
        for _ in range(k // 12 * 3):  # more and more edits
            part[r.randrange(len(part))] = "edited"
        a = r.randrange(len(part) // 3 + 1) if k % 2 else 0
        texts.append(" ".join(words(r, r.randrange(50)) + part[a:] + words(r, r.randrange(50))))
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    got = {(x.doc_id, x.item_id) for x in dc.leaked(spark, documents(spark, texts), bench).collect()}
    want = {(k, j) for k, t in enumerate(texts) for j in plain_leaks(items, t)}
    assert got == want and 8 < len(want) < 36


def test_long_texts_in_parts(spark, monkeypatch):
    """Parts of a text, and windows of passages, change nothing."""
    r = random.Random(9)
    items = [item(r) for _ in range(30)]
    texts = [" ".join(words(r, 900) + items[k].split() + words(r, 900 + k) + items[k + 1].split() + words(r, 50)) for k in range(0, 28, 2)]
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    one = sorted(dc.leaked(spark, documents(spark, texts), bench).collect())
    assert [(x.doc_id, x.item_id) for x in one] == [(k // 2, j) for k in range(0, 28, 2) for j in (k, k + 1)]
    for size in (3, 17, 1000):
        monkeypatch.setattr(dc, "TEXT_PART", size)
        assert dc.ids_of(texts[0], lambda words: map(len, words)).tolist() == [len(w) for w in dc.words_of(texts[0])]
    index = next(dc.indexes(spark, bench))
    w = dc.ids_of(texts[3], index.numbers)
    assert len(w) > 4 * dc.STEP
    monkeypatch.setattr(dc, "WINDOW", 4)

    class Shared:
        value = index

    frame = documents(spark, texts).withColumn("leaks", dc.F.array().cast(dc.T.ArrayType(dc.LEAK)))
    run = {}

    class Frame:  # the mapped function, run here, where the small window holds
        columns, schema = frame.columns, frame.schema

        def mapInArrow(self, f, schema):
            run["f"] = f

    dc._scan(Frame(), Shared, "leaks")
    got = [x for b in run["f"](iter(frame.toArrow().to_batches())) for x in b.to_pylist()]
    assert sorted((x["doc_id"], y["item_id"]) for x in got for y in x["leaks"]) == [(x.doc_id, x.item_id) for x in one]


def test_finds_what_is_planted(spark):
    r = random.Random(2)
    items = [item(r) for _ in range(60)] + ["short one", "two"]
    texts, want = [], []
    for k in range(200):
        w = words(r, r.randrange(5, 300))
        if k % 4 == 0:
            j = r.randrange(60)
            at = r.randrange(len(w))
            texts.append(" ".join(w[:at]) + " " + items[j].upper() + "### " + " ".join(w[at:]))
            want.append((k, j))
        else:
            texts.append(" ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    got = sorted((x.doc_id, x.item_id) for x in dc.leaked(spark, documents(spark, texts), bench).collect())
    assert got == want


def test_shards_find_the_same(spark, monkeypatch):
    """Scores too: the statistics are those of all items."""
    r = random.Random(3)
    items = [item(r) for _ in range(40)]
    docs = documents(spark, [items[k] + " tail" for k in range(0, 40, 3)] + ["nothing here at all"])
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    one = sorted((x.doc_id, x.item_id, x.bm25_share) for x in dc.leaked(spark, docs, bench).collect())
    monkeypatch.setattr(dc, "SHARD_CHARS", sum(map(len, items)) // 4)
    assert len(list(dc.indexes(spark, bench))) >= 4
    many = sorted((x.doc_id, x.item_id, x.bm25_share) for x in dc.leaked(spark, docs, bench).collect())
    assert [x[:2] for x in many] == [x[:2] for x in one] and [x[2] for x in many] == pytest.approx([x[2] for x in one]) and len(one) == 14


def test_large_benchmark_is_one_small_index():
    """10,000 items of 300 words in one shard."""
    import pickle

    r = random.Random(4)
    some = words(r, 3000)
    items = [(k, " ".join(r.choice(some) + str(r.randrange(60)) for _ in range(300))) for k in range(10_000)]
    assert sum(len(t) for _, t in items) < dc.SHARD_CHARS
    index = dc.Index(items)
    assert len(pickle.dumps(index)) < 150 << 20
    w = dc.ids_of("before it " + items[77][1], index.numbers)
    found = index.retrieve(w[w >= 0], np.flatnonzero(w >= 0) // dc.STEP, -(-len(w) // dc.STEP) + 1)
    assert {x["item_id"] for x in index.confirm(w, found, 0)} == {77}


def test_question_alone_is_no_leak(spark):
    text = "Which of the old rivers runs through seven towns before it meets the sea near the harbour? It is the long green river called Vessen by all."
    bench = spark.createDataFrame([(1, text)], ITEMS)
    docs = documents(spark, [text.split("?")[0] + "?", text, "say " + text + " so"])
    assert sorted(x.doc_id for x in dc.leaked(spark, docs, bench).collect()) == [1, 2]


def test_odd(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, ODD[8]), (4, ODD[8]), (None, ODD[8])], ITEMS)
    got = dc.leaked(spark, odd_frame(spark), bench).collect()
    assert sorted({x.doc_id for x in got}) == [8, 9] and {x.item_id for x in got} == {4, None}
    assert dc.leaked(spark, documents(spark, []), bench).count() == 0
    assert dc.leaked(spark, odd_frame(spark), spark.createDataFrame([], ITEMS)).count() == 0


def test_finds_edited_items(spark):
    """One changed, inserted, missing or misspelt word anywhere among the last words, or the first, hides no item."""
    r = random.Random(5)
    items, texts, want = [], [], []
    for k in range(40):
        w, last = words(r, 24 + k % 5), 3 + k % 12
        w[-last - 1] += "."
        items.append(" ".join(w) + ".")
        for at in (len(w) - 1 - k % last, len(w) - 3, len(w) - 5, 1 + k % 9):
            for edit in ([], ["zzother"], [w[at], "zzother"], [w[at][:-1] + "q"]):
                texts.append(" ".join(words(r, 30) + w[:at] + edit + w[at + 1 :] + words(r, 30)))
                want.append((len(texts) - 1, k))
        texts.append(" ".join(words(r, 30) + w[: -max(last, 5)] + words(r, 30)))  # without the answer
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    got = sorted((x.doc_id, x.item_id) for x in dc.leaked(spark, documents(spark, texts), bench).collect())
    assert got == want


def test_alignment():
    part = "a b c d e".split()
    assert dc.aligned(part, "x a b c d e".split()) == 1 and dc.aligned(part, "x a b q c d e".split()) == 1
    assert dc.aligned(part, "a b q d e x".split()) == 0.8 and dc.aligned(part, "b c d e".split()) == 0.8
    assert dc.aligned(part, "e d c b a".split()) == dc.aligned(part, "a b x x x x c d e".split()) == dc.aligned(part, []) == 0
