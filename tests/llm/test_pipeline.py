"""The stages against plain Python on a small corpus, and the queries' registration."""

import random

import corpus_pipeline as cp
import pytest
import sentencepiece
from helpers import DOCS, ODD
from test_decontaminate import item
from test_near_dedup import brute

from hduframe.llm import queries
from hduframe.llm.secrets import MARK


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    word = lambda: r.choice("bcdfgh") + r.choice("aeiou") + r.choice("lmnrst") + r.choice("aeiou") + r.choice("kpvz")
    text = lambda n: " ".join(word() for _ in range(n))
    items = [item(r) for _ in range(20)]
    texts, kind = [], []
    for k in range(500):
        t = text(r.randrange(30, 120))
        if k % 5 == 1:
            kind.append("toxic")
            t += " grobian " + text(5) + " scoundrel"
        elif k % 5 == 2 and k > 20:
            kind.append("copy")
            t = texts[k - 5 - k % 5]
        elif k % 25 == 3:
            kind.append("leak")
            t = t + " " + items[k % 20] + " " + text(9)
        elif k % 25 == 4:
            kind.append("secret")
            t = t + " token = 0123456789abcdef0123456789abcdef " + text(4)
        else:
            kind.append("clean")
        texts.append(t)
    texts, kind = texts + ODD, kind + ["odd"] * len(ODD)
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(x == "toxic")) for k, x in enumerate(kind) if x != "odd"], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, kind


def test_stages(spark, tables):
    path, texts, kind = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/out-{name}")
        docs = spark.read.parquet(f"{path}/out-{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == [f.name for f in DOCS.fields]
    left = sorted(kept["toxicity"])
    assert left == [k for k, x in enumerate(kind) if x != "toxic"]
    comp, _ = brute([texts[k] for k in left])
    assert sorted(kept["near_dedup"]) == [left[k] for k, c in enumerate(comp) if k == c]
    assert sorted(kept["decontaminate"]) == [k for k in sorted(kept["near_dedup"]) if kind[k] != "leak"]
    assert sorted(kept["secrets"]) == sorted(kept["decontaminate"])
    for k, r in kept["secrets"].items():
        assert (MARK in (r.text or "")) == (kind[k] == "secret") and (r.text == texts[k] or kind[k] == "secret")
        assert r.n_chars == (len(r.text) if r.text is not None else None)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    for k, r in kept["sentencepiece"].items():
        assert r.ids == sp.encode(kept["secrets"][k].text or "")
    assert sorted(r.doc_id for r in cp.run(spark, path).select("doc_id").collect()) == sorted(kept["sentencepiece"])


def test_rows_are_told_apart(spark, tmp_path):
    """One id with two texts, repeated rows, null ids and texts, and columns that stages could use for themselves."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c), (None, None), (2, ""), (2, ""), (3, b + " more"), (4, "two words")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS).selectExpr("*", "0.9D AS score", "'mine' AS leaks", "7 AS key", "8 AS rows", "9 AS mine")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        assert docs.columns == [f.name for f in DOCS.fields] + ["score", "leaks", "key", "rows", "mine"]
    want = [(1, a), (1, b), (None, c), (None, None), (2, ""), (2, ""), (4, "two words")]
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(want, key=repr)
    assert {(r.score, r.leaks, r.key) for r in docs.collect()} == {(0.9, "mine", 7)}
    empty = tmp_path / "empty"
    spark.createDataFrame([], DOCS).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{empty}/{name}.parquet")
    assert cp.run(spark, str(empty)).count() == 0


def test_what_is_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "sentencepiece"]
    assert set(__spark_entry__.oracle_sql()) <= set(names)
