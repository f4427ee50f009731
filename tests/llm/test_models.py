import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents, odd_frame

from hduframe.llm import kneser_ney as kn
from hduframe.llm import lm_score, quality_rules, toxicity
from hduframe.llm.common import Scratch

LABELS = "doc_id long, quality int, toxic int"


def prose(r, n, extra=()):
    words = ["the", "of", "and", "river", "stone", "light", "garden", "window", "paper", "morning", "people", "travel", "story", "music", "winter", "summer", "house", "letter"]
    out = [r.choice(words) for _ in range(n)]
    for w in extra:
        out.insert(r.randrange(len(out)), w)
    return " ".join(out)


# ---- toxicity


def toxic_corpus(n=1500, label=lambda insult, group: insult and group, noise=(20, 60)):
    """By default an insult is toxic only beside a mention of a group."""
    r, texts, out = random.Random(1), [], []
    for _ in range(n):
        insult, group = r.random() < 0.5, r.random() < 0.5
        texts.append(prose(r, 3, [*(r.choice("bcdfgh") + r.choice("aeiou") + r.choice("lmnrst") + r.choice("aeiou") + r.choice("kpvz") for _ in range(r.randrange(*noise))), *(["grobian"] if insult else []), *(["neighbours"] if group else [])]))
        out.append(int(label(insult, group)))
    return texts, out


@pytest.mark.parametrize("xor", [False, True])
def test_factors_learn_pairs(xor):
    """With xor, neither term alone goes with the label, and no sum of single weights tells it."""
    texts, label = toxic_corpus(label=(lambda a, b: a != b) if xor else (lambda a, b: a and b))
    cache = toxicity.Cache(toxicity.buckets)
    rows = [np.array(sorted(toxicity.terms(t, cache))) for t in texts]
    y = np.array(label, float)
    known = toxicity.telling(rows, y)
    assert {zlib.crc32(w.encode()) & (toxicity.BUCKETS - 1) for w in ("grobian", "neighbours")} <= set(known.tolist())
    m = toxicity.train(known, [np.searchsorted(known, np.intersect1d(x, known)) for x in rows], y)
    score = m.score([np.searchsorted(known, np.intersect1d(x, known)) for x in rows])
    assert score[y == 1].min() > 0.7 and score[y == 0].max() < 0.3
    m.v[:] = 0  # what the weights say without the factors
    alone = m.score([np.searchsorted(known, np.intersect1d(x, known)) for x in rows])
    assert not xor or ((alone >= 0.5) != (y == 1)).mean() > 0.2


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(np.arange(40), rng.normal(0, 1, 40), rng.normal(0, 1, (40, toxicity.FACTORS)), 0.3)
    rows = [np.sort(rng.choice(40, n, replace=False)) for n in (1, 2, 7, 15)] + [np.empty(0, np.int64)]
    for r, got in zip(rows, m.score(rows), strict=True):
        z = m.b + sum(m.w[t] for t in r) + sum(float(m.v[t] @ m.v[u]) for t in r for u in r if t < u)
        assert got == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_terms_without_a_say_stay_out():
    texts, _ = toxic_corpus(noise=(40, 80))
    r = random.Random(5)
    cache = toxicity.Cache(toxicity.buckets)
    known = toxicity.telling([np.array(sorted(toxicity.terms(t, cache))) for t in texts], np.array([float(r.random() < 0.3) for _ in texts]))
    assert len(known) == 0


def test_sample_is_bounded_in_terms(spark, monkeypatch):
    texts, label = toxic_corpus(300)
    texts[5] = " ".join(f"w{k}" for k in range(30_000))
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(label)], LABELS)
    monkeypatch.setattr(toxicity, "TRAIN_TERMS", 40_000)
    assert toxicity.fit(documents(spark, texts), labels) is not None


def test_toxicity_held_out(spark):
    texts, label = toxic_corpus(600)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(label)], LABELS)
    rows = sorted(toxicity.toxicity(spark, docs.selectExpr("*", "9 AS score", "8 AS toxic"), labels).collect())
    assert [r.held_out for r in rows] == [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(len(texts))]
    right = [r.predicted == label[r.doc_id] for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.97 and all(r.predicted == int(r.score >= 0.7) for r in rows)
    # what is held out has no part in the fit
    flipped = spark.createDataFrame([(k, 1, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, t in enumerate(label)], LABELS)
    assert sorted(r.score for r in toxicity.toxicity(spark, docs, flipped).collect()) == sorted(r.score for r in rows)


def test_toxicity_odd(spark):
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.toxicity(spark, odd_frame(spark), none).collect()
    assert len(rows) == len(ODD) + 1 and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    texts, label = toxic_corpus(400)
    labels = spark.createDataFrame([(k + 1000, None, t) for k, t in enumerate(label)] + [(None, 1, 1)], LABELS)
    docs = documents(spark, texts).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars").unionByName(odd_frame(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = {r.doc_id: r for r in toxicity.toxicity(spark, docs, labels).collect()}
    assert rows[0].score == rows[1].score and 0 <= rows[0].score < 0.7
    assert toxicity.toxicity(spark, documents(spark, []), labels).count() == 0


def test_copies_are_no_evidence():
    rows = [np.arange(50)] * 5 + [np.arange(1, 51), np.arange(100, 150), np.empty(0, np.int64), np.arange(50)]
    assert toxicity.distinct_rows(rows, np.array([0.0] * 8 + [1.0])).tolist() == [0, 6, 8]  # the last has another label


# ---- stupid backoff


@pytest.mark.parametrize(("order", "least"), [(3, 2), (2, 1), (4, 2)])
def test_stupid_backoff(spark, order, least, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", 300)
    monkeypatch.setattr(lm_score, "SHARD_GRAMS", 500)
    r = random.Random(3)
    texts = [prose(r, r.randrange(1, 60)) for _ in range(60)] + [t for t in ODD if t is None or len(t) < 20_000]
    words = [(t or "").encode().split() for t in texts]
    counts = [Counter(tuple(w[k : k + n + 1]) for w in words for k in range(len(w) - n)) for n in range(order)]
    total = sum(map(len, words))

    def score(w, k, n):
        if n == 0:
            return counts[0][(w[k],)] / total
        c = counts[n][tuple(w[k - n : k + 1])]
        return c / counts[n - 1][tuple(w[k - n : k])] if c >= least else 0.4 * score(w, k, n - 1)

    got = {x.doc_id: x for x in lm_score.lm_scores(spark, documents(spark, texts).repartition(3), order, least=least).collect()}
    for k, w in enumerate(words):
        want = sum(math.log(score(w, j, min(j, order - 1))) for j in range(len(w)))
        assert got[k].n_words == len(w) and got[k].score == pytest.approx(want, abs=1e-9)
        assert (got[k].mean_score is None) == (not w)
    assert lm_score.lm_scores(spark, documents(spark, [])).count() == 0


def test_stupid_backoff_odd(spark):
    assert lm_score.lm_scores(spark, odd_frame(spark)).count() == len(ODD) + 1


def test_packing():
    a = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    for x in (a, a[:0]):
        assert np.array_equal(lm_score.unpack(lm_score.pack(x), "<u8"), x) and np.array_equal(lm_score.unpack_words(lm_score.pack_words(x)), x)


# ---- Kneser-Ney


def plain_kneser_ney(train):
    """Interpolated modified Kneser-Ney of order 3 in dictionaries."""
    pad = [["<s>", "<s>", *t.split()] for t in train]
    tri = Counter(tuple(w[k - 2 : k + 1]) for w in pad for k in range(2, len(w)))
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1:] for g in bi)

    def discounts(c):
        n = [0] + [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not all(n[1:]):
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))

    levels = []
    for c in (uni, bi, tri):
        d = discounts(c)
        of = lambda v, d=d: d[min(v, 3) - 1]
        total, taken = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            taken[g[:-1]] += of(v)
        levels.append((c, of, total, taken))

    def p(g):
        if not g:
            return 1 / (len(uni) + 1)
        c, of, total, taken = levels[len(g) - 1]
        if g[:-1] not in total:
            return p(g[1:])
        return ((c[g] - of(c[g])) if g in c else 0) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p, set(uni)


def test_kneser_ney_against_dictionaries(spark):
    r = random.Random(8)
    train = [prose(r, r.randrange(5, 80)) for _ in range(60)]
    model = kn.fit(Scratch(spark, "t"), documents(spark, train))
    p, words = plain_kneser_ney(train)
    texts = [prose(r, 30), "music unseen music of the window", train[0], "zzz", None, ""]
    got = {x.doc_id: x for x in kn.perplexity(spark, documents(spark, texts), model).collect()}
    for k, t in enumerate(texts):
        w = ["<s>", "<s>", *(t or "").split()]
        if len(w) == 2:
            assert got[k].perplexity is None and got[k].n_words == 0
            continue
        want = math.exp(-sum(math.log(p(tuple(w[j - 2 : j + 1]))) for j in range(2, len(w))) / (len(w) - 2))
        assert got[k].perplexity == pytest.approx(want, rel=1e-4)
    assert sum(p(("the", "of", w)[0:0] + ("the", "of", w)) for w in words) < 1.0 + 1e-9


def test_classifier(spark):
    r = random.Random(4)
    good = [prose(r, r.randrange(60, 120)) for _ in range(400)]
    bad = [" ".join("".join(r.choice("qxzjk#$") for _ in range(7)) for _ in range(80)) for _ in range(40)]
    texts = good + bad + [None, ""]
    langs = ["en" if k % 2 else None for k in range(len(texts))]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)] + [(k, 0, 0) for k in range(400, 420)], LABELS)
    rows = sorted(kn.classify(spark, documents(spark, texts, langs), labels).collect(), key=lambda x: x.doc_id)
    assert sum(r.kept for r in rows[:400]) >= 395 and not any(r.kept for r in rows[400:]) and rows[-1].perplexity is None
    none = spark.createDataFrame([], LABELS)
    kept = {r.doc_id: r.kept for r in kn.classify(spark, odd_frame(spark), none).collect()}
    assert [kept[k] for k in range(len(ODD))] == [bool((t or "").encode().split()) for t in ODD]
    assert kn.classify(spark, documents(spark, []), labels).count() == 0


@pytest.mark.parametrize("long", [4000, 1900])
def test_long_text_does_not_empty_the_sample(spark, monkeypatch, long):
    """The first document in hash order is over the bound on the sample, or fills it almost."""
    monkeypatch.setattr(kn, "TRAIN_CHARS", 2000)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], LABELS)
    docs = documents(spark, ["x" * 50] * 60)
    f = kn.F
    first = docs.where(f.pmod(f.xxhash64("doc_id"), f.lit(kn.KEPT_BACK)) != 0).orderBy(f.xxhash64("doc_id")).first().doc_id
    ids = [r.doc_id for r in kn.training_ids(documents(spark, ["x" * (long if k == first else 50) for k in range(60)]), labels).collect()]
    assert len(ids) == len(set(ids)) == 40 and first not in ids


def test_model_is_of_all_good_documents(spark, monkeypatch):
    """perplexities of all documents are those of dictionaries of every good document that isn't kept back, whatever the sample's bounds,
    in blocks and shards of a few words."""
    for name, value in (("TRAIN_MOST", 3), ("TRAIN_CHARS", 300), ("BLOCK_WORDS", 300), ("SHARD_WORDS", 500)):
        monkeypatch.setattr(kn, name, value, raising=False)
    r = random.Random(5)
    texts = [prose(r, r.randrange(5, 60), [f"w{r.randrange(60)}"]) for _ in range(60)] + [None, "", "zzz"]
    docs, labels = documents(spark, texts), spark.createDataFrame([(k, int(k < 50), 0) for k in range(60)], LABELS)
    f = kn.F
    fitted = {x.doc_id for x in docs.where(f.pmod(f.xxhash64("doc_id"), f.lit(kn.KEPT_BACK)) != 0).collect()} & set(range(50))
    p, _ = plain_kneser_ney([texts[k] for k in sorted(fitted)])
    got = {x.doc_id: x for x in kn.classify(spark, docs, labels).collect()}
    assert len(got) == len(texts) and got[60].perplexity is None and got[61].n_words == 0
    for k, t in enumerate(texts):
        w = ["<s>", "<s>", *(t or "").split()]
        if len(w) > 2:
            want = math.exp(-sum(math.log(p(tuple(w[j - 2 : j + 1]))) for j in range(2, len(w))) / (len(w) - 2))
            assert got[k].perplexity == pytest.approx(want, rel=1e-6) and got[k].n_words == len(w) - 2


def test_words_are_answered_in_waves(spark, monkeypatch):
    """no step sends or answers the words of all shards at once; together the waves answer each block's words."""
    for name, value in (("BLOCK_WORDS", 300), ("SHARD_WORDS", 50)):
        monkeypatch.setattr(kn, name, value)
    r = random.Random(6)
    texts = [prose(r, r.randrange(5, 60), [f"w{r.randrange(60)}"]) for _ in range(60)]
    answered, write = [], Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name.startswith("answers-words"):
            answered.append(sum(len(kn.unpack(x.tri, "<u8")) for x in out.where("block is not null").collect()))
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    rows = kn.classify(spark, documents(spark, texts), spark.createDataFrame([(k, 1, 0) for k in range(60)], LABELS)).collect()
    assert all(x.perplexity > 1 for x in rows)
    blocks = kn.blocks(documents(spark, texts)).collect()
    assert sum(answered) == sum(len(kn.ordered(b.words)[0]) for b in blocks) and max(answered) < sum(answered) / 2


def test_documents_are_scored_in_parts(spark, monkeypatch):
    """no written table holds the blocks of more than a part of the documents, and each row of them is in one part, whatever repeats."""
    for name, value in (("BLOCK_WORDS", 300), ("SHARD_WORDS", 300)):
        monkeypatch.setattr(kn, name, value)
    r = random.Random(7)
    texts = [prose(r, r.randrange(5, 60), [f"w{r.randrange(60)}"]) for _ in range(60)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(3, texts[3], "en"), (3, texts[4], "en"), (None, texts[5], None), (None, texts[5], None), (70, None, "en"), (71, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3, "doc_id").localCheckpoint()
    held, write = [], Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if "docs" in out.columns:
            held.append(sum(len(x.docs) for x in out.collect()))
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    got = kn.classify(spark, docs, spark.createDataFrame([(k, 1, 0) for k in range(20)], LABELS)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_words) for x in got) == sorted((d is None, d or 0, len((t or "").split())) for d, t, _ in rows)
    assert len(held) > 2 and max(held) < len(rows) / 2


def test_odd_documents_set_no_cutoff(spark):
    """Two outliers of 100 held-out documents: the cutoff is the next value; a language with few takes that of all."""
    rows = [(k, "de", 1e7 if k < 2 else float(k)) for k in range(100)] + [(100 + k, "fr", 5.0) for k in range(10)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, perplexity double")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], LABELS)
    got = {(r.stratum, r["all"]): r.threshold for r in kn.cutoffs(scored, labels, scored.select("doc_id").where("false")).collect()}
    assert got == {("de", False): 99.0, (None, True): 99.0}
    few = {(r.stratum, r["all"]): r.threshold for r in kn.cutoffs(scored.where("doc_id >= 100"), labels, scored.select("doc_id").where("false")).collect()}
    assert few == {(None, True): 5.0}


# ---- quality rules


def test_signals(spark):
    texts = [*ODD, "a b c a b c a b c", "x y\nx y\n \nx y\n", "# $ a%b|c", "aa bb cc dd aa bb cc"]
    got = {r.doc_id: r for r in quality_rules.signals(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + d for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 200, 0.01), (5, 1000, 0.0025), (0, 5000, 0.0025), (40, 3000, 0.0025), (2900, 100_000, 0.03), (7, 3000, 0.0025)]
    for k, n, p in cases:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1)) if k <= n * p else 1.0  # no test passes beyond the mean
        got = spark.createDataFrame([(k, n)], "k long, n long").select(quality_rules.binomial_tail(quality_rules.F.col("k"), quality_rules.F.col("n"), p).alias("x")).first().x
        assert got == pytest.approx(want, rel=1e-8)


def test_risk_is_controlled(spark):
    r = random.Random(6)
    texts, labels = [], []
    words = [f"{a}{b}" for a in ("ri", "sto", "lu", "ga", "wi", "pa") for b in ("ver", "ne", "men", "rden", "ndow", "per", "ta", "ko")]
    for k in range(3000):
        bad = k % 5 == 0
        texts.append(" ".join(r.choice(words) + ("###" if bad else "") for _ in range(80)))
        labels.append((k, int(not bad), 0))
    rows = {x.doc_id: x for x in quality_rules.quality_rules(spark, documents(spark, texts), spark.createDataFrame(labels, LABELS)).collect()}
    kept = [rows[k].kept for k, q, _ in labels if q and not rows[k].base_failed]
    assert sum(kept) / len(kept) > 0.99 and not any(rows[k].kept for k, q, _ in labels if not q)
    few = quality_rules.quality_rules(spark, documents(spark, texts[:100]), spark.createDataFrame(labels[:100], LABELS)).collect()
    assert all(x.kept or x.base_failed for x in few)  # too few labels to vouch for any cutoff


def test_holdout_has_each_text_once(spark):
    """400 labels of 20 texts vouch for no cutoff, nor do labels that come many times."""
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(20)]
    docs = documents(spark, [*(texts * 20), " ".join(["w###"] * 5 + [f"v{k}###" for k in range(80)])])
    once = [(k, 1, 0) for k in range(400)]
    assert quality_rules.cutoffs(quality_rules.signals(docs), spark.createDataFrame(once, LABELS)).count() == 0
    few = [(k, 1, 0) for k in range(20)] * 30
    assert quality_rules.cutoffs(quality_rules.signals(docs), spark.createDataFrame(few, LABELS)).count() == 0
    own = documents(spark, [f"{t} x{k}" for k, t in enumerate(texts * 20)])
    chosen = quality_rules.cutoffs(quality_rules.signals(own), spark.createDataFrame(once + [(3, 0, 0)], LABELS)).collect()
    assert {x.rule for x in chosen} == set(quality_rules.GRIDS) and {x.good for x in chosen} == {399}


def test_rules_reject_beyond_the_base(spark):
    rows = quality_rules.quality_rules(spark, *(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))).where("not base_failed")
    assert 0 < rows.where("not kept").count() < 0.2 * rows.count()


def test_quality_odd(spark):
    rows = quality_rules.quality_rules(spark, odd_frame(spark), spark.createDataFrame([(8, 1, 0), (None, None, None)], LABELS)).collect()
    assert len(rows) == len(ODD) + 1 and all(r.base_failed != r.kept for r in rows)
    assert quality_rules.quality_rules(spark, documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0
