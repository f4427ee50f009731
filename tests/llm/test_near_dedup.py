import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD, documents, odd_frame

from hduframe.llm import near_dedup as nd
from hduframe.llm.common import Scratch, may_hold
from hduframe.llm.components import components


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(texts):
    s = sets_of(texts)
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and min(len(s[a]), len(s[b])) * 100 >= 75 * max(len(s[a]), len(s[b])):
                both = len(s[a] & s[b])
                if 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(s))], [len(x) for x in s]


def corpus(n=260, seed=1):
    """Texts alone, copies, chains of edited texts, and one large group of edited copies of one text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    out = [" ".join(word() for _ in range(r.randrange(3, 120))) for _ in range(n // 4)]
    out += [r.choice(out).upper() for _ in range(n // 8)]
    chain = [word() for _ in range(100)]
    for _ in range(n // 4):
        chain = list(chain)
        chain[r.randrange(100)] = word()
        out.append(" ".join(chain))
    base = [word() for _ in range(90)]
    for _ in range(n - len(out)):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(90)] = word()
        out.append("  ".join(w))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 32)  # so that hot keys are dealt to several blocks
    monkeypatch.setattr(nd, "WANTED_MOST", 0 if seed == 2 else 1000)  # texts by shuffle, and by broadcast
    texts = corpus(seed=seed)
    comp, size = brute(texts)
    rows = sorted(nd.near_dedup(spark, documents(spark, texts).repartition(5)).collect())
    assert [r.component_id for r in rows] == comp and [r.n_shingles for r in rows] == size
    assert [r.kept for r in rows] == [k == c for k, c in enumerate(comp)]


def test_pairs_within_the_distance_share_a_key():
    r = np.random.default_rng(4)
    limit = nd.CHUNKS * (nd.ERRORS + 1) - 1
    for _ in range(500):
        a = r.integers(0, 1 << 24, nd.INDEXED)
        b = a.copy()
        at = r.choice(nd.INDEXED, r.integers(0, limit + 1), replace=False)
        b[at] += 1
        assert any(all(a[x] == b[x] for x in way) for way in nd.WAYS)


def test_symbols_agree_as_often_as_the_sets():
    r, got, want = random.Random(0), [], []
    shingler = nd.Shingler()
    for share in (0.3, 0.6, 0.8):
        for _ in range(20):
            w = [str(r.random()) for _ in range(300)]
            v = w[: int(300 * share)] + [str(r.random()) for _ in range(300)]
            x, y = shingler(" ".join(w)), shingler(" ".join(v))
            both = len(np.intersect1d(x, y))
            want.append(both / (len(x) + len(y) - both))
            got.append((nd.signature(x) == nd.signature(y)).mean())
    assert abs(np.mean(np.array(got) - np.array(want))) < 0.01 and np.abs(np.array(got) - np.array(want)).max() < 0.13


def test_odd_documents(spark):
    every = nd.near_dedup(spark, odd_frame(spark)).collect()
    rows = {r.doc_id: r for r in sorted(every, key=lambda r: r.kept, reverse=True)}
    size = [len(x) for x in sets_of(ODD)]
    assert len(every) == len(ODD) + 1 and sum(r.doc_id == 9 for r in every) == 2
    assert [rows[k].n_shingles for k in range(len(ODD))] == size
    assert rows[9].component_id == 8 and not rows[9].kept and all(rows[k].component_id == k for k in range(len(ODD)) if k != 9)
    assert nd.near_dedup(spark, documents(spark, [])).count() == 0


def oracle(spark, frame, path):
    import duckdb

    from hduframe.llm.queries import NEAR

    frame.write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = con.sql(NEAR)
    return sorted(map(repr, ({c: v for c, v in zip(got.columns, r, strict=True)} for r in got.fetchall())))


A, B = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
TWICE = [(2, B), (5, A), (5, B), (9, A + " more"), (7, "lone text of seven words in all"), (7, "lone text of seven words in all"), (None, A), (None, "nobody has this text but nobody"), (None, "nobody has this text but nobody"), (3, ""), (3, ""), (None, None), (4, B + " x"), (4, B + " y")]


def test_one_id_with_two_texts_repeated_rows_and_null_ids(spark, tmp_path):
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in TWICE], documents(spark, []).schema).repartition(3)
    got = nd.near_dedup(spark, frame).drop("text_key")
    rows = got.collect()
    assert sorted(map(repr, (r.asDict() for r in rows))) == oracle(spark, frame, str(tmp_path / "d"))
    kept = [(r.doc_id, r.n_shingles) for r in rows if r.kept]
    assert sorted(kept, key=repr) == sorted([(2, 56), (5, 56), (7, 3), (None, 2), (3, 0), (3, 0), (None, 0)], key=repr)
    left = nd.survivors(spark, frame)
    assert left.columns == frame.columns
    want = [(2, B), (5, A), (7, TWICE[4][1]), (None, TWICE[7][1]), (3, ""), (3, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)


def test_hot_keys(spark, monkeypatch):
    """A third of the rows are copies of one text, a third near copies of another; hot keys are met by broadcast, blocks through a hub."""
    from hduframe.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 10)
    monkeypatch.setattr(common, "HOT", 12)
    monkeypatch.setattr(nd, "BLOCK", 16)
    r = random.Random(8)
    base = [f"b{k}" for k in range(80)]
    texts = ["the same text in all of these rows"] * 80
    for _ in range(80):
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(80)] = str(r.random())
        texts.append(" ".join(w))
    texts += corpus(90, 5)
    r.shuffle(texts)
    comp, _ = brute(texts)
    rows = sorted(nd.near_dedup(spark, documents(spark, texts).repartition(4)).collect())
    assert [x.component_id for x in rows] == comp and [x.kept for x in rows] == [k == c for k, c in enumerate(comp)]


def test_hot_join(spark, tmp_path, monkeypatch):
    from hduframe.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 5)
    monkeypatch.setattr(common, "HOT", 4)
    keys = [b"a"] * 30 + [b"b"] * 25 + [b"%d" % k for k in range(40)] + [None] * 5
    left = spark.createDataFrame([(bytearray(k) if k else None, i) for i, k in enumerate(keys)], "k binary, i int")
    right = spark.createDataFrame([(bytearray(k), k.decode()) for k in sorted({k for k in keys if k} - {b"b", b"7"})], "k binary, name string")
    for how in ("left", "inner"):
        got = sorted((x.i, x.name) for x in common.hot_join(left, right, "k", how).collect())
        want = [(i, k.decode() if k not in (None, b"b", b"7") else None) for i, k in enumerate(keys)]
        assert got == [x for x in want if how == "left" or x[1]]


def test_only_texts_that_are_needed_are_shuffled(spark, tmp_path):
    """with autobroadcast off, 4 of 400 documents are copies; the plan of what survives shuffles these and not all texts."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)) for _ in range(396)]
    documents(spark, texts + texts[:4]).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = nd.survivors(spark, docs)
        assert sorted(x.doc_id for x in out.collect()) == list(range(396))
        plan = out._jdf.queryExecution().executedPlan()
        sent = shuffled(plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 4 <= max(sent) < 100


def test_full_sets_go_to_pairs_not_to_keys(spark, monkeypatch):
    """F1: pairs at 0.73 share about half of their 30 keys and are no links; each row meets its partner's full set once."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(20):
        w = [word() for _ in range(100)]
        texts.append(" ".join(w))
        w[20], w[50], w[80] = word(), word(), word()
        texts.append(" ".join(w))
    rows, grouped = [], nd._grouped

    def counted(df, *more):
        if "shingles" in df.columns:
            rows.append(df.count())
        return grouped(df, *more)

    monkeypatch.setattr(nd, "_grouped", counted)
    assert [x.component_id for x in sorted(nd.near_dedup(spark, documents(spark, texts)).collect())] == list(range(40))
    assert 20 < sum(rows) <= 40


def shuffled(plan):
    """Rows that each shuffle of a plan that ran has written."""
    todo, out = [plan], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                out.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


@pytest.mark.parametrize("room", [0, 1000])
def test_filter_leaves_out_no_key(spark, tmp_path, room):
    spark.range(0, 3000, 3).selectExpr("cast(cast(id as string) as binary) AS k").write.parquet(f"{tmp_path}/k")
    may = may_hold(spark.read.parquet(f"{tmp_path}/k"), "k", room)
    got = {x.id for x in spark.range(3000).selectExpr("id", "cast(cast(id as string) as binary) AS k").where(may("k")).select("id").collect()}
    assert got >= set(range(0, 3000, 3)) and (room == 0 or len(got) < 1300)
    spark.range(0).selectExpr("cast('' as binary) AS k").write.parquet(f"{tmp_path}/none")
    assert spark.range(9).select(may_hold(spark.read.parquet(f"{tmp_path}/none"), "k", room)(nd.F.lit(b"x")).alias("x")).where("x").count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1080)] + [(2000, k) for k in range(2001, 2060)] + [(5, 5)]
    root = defaultdict(lambda: None)

    def find(x):
        root[x] = x if root[x] is None else root[x]
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long"), "c")
    assert {x.node: x.comp for x in got.collect()} == {k: find(k) for k in list(root)}
