import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from helpers import ODD, documents, odd_frame
from tokenizers import Tokenizer

from hduframe.llm.token_files import FrameWriter, encoder, open_file, read, read_bytes, write

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_like_the_library(library):
    e, r = encoder(FILE), random.Random(7)
    alphabet = " \n\tabcd'sté漢字😀\x1c\x85 　0123½²_!?<|endoftext|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) + r.choice(["", "<|endoftext|>", "'s", "  "]) for _ in range(4000)]
    for t in [*texts, *(x for x in ODD if x)]:
        assert np.frombuffer(e(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def written(docs, width=2, frame=64):
    import io

    sink = io.BytesIO()
    w = FrameWriter(sink, width, frame)
    for d, ids in docs:
        w.add(d, np.array(ids, "<u4").tobytes())
    w.close()
    return sink.getvalue()


DOCS = [(None, [7]), (3, list(range(500))), (5, []), (5, [1, 2, 3]), (9, [65535] * 40)]


@pytest.mark.parametrize("frame", [64, 66, 1 << 18])
def test_files(frame):
    raw = written(DOCS, frame=frame)
    r = read_bytes(raw)
    assert [(d, a.tolist()) for d, a in r.each()] == DOCS
    assert [a.tolist() for a in r.get(3)] == [list(range(500))] and [a.tolist() for a in r.get(5)] == [[], [1, 2, 3]] and r.get(4) == []
    flat = [x for _, ids in DOCS for x in ids]
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert np.frombuffer(whole, "<u2").tolist() == flat  # any reader of the format reads the ids


def test_only_the_frames_asked_for_are_read():
    raw = bytearray(written([(k, [k] * 32) for k in range(10)]))
    r = read_bytes(bytes(raw))
    raw[int(r.from_byte[7]) + 6] ^= 0xFF  # damages frame 7
    r = read_bytes(bytes(raw))
    assert r.get(2)[0].tolist() == [2] * 32
    with pytest.raises((ValueError, zstandard.ZstdError)):
        r.get(7)


def test_damaged_files():
    raw = written(DOCS)
    for bad in (raw[:-1], raw[:-9] + b"\0" * 9):
        with pytest.raises(ValueError):
            read_bytes(bad)
    assert list(read_bytes(written([])).each()) == []


def test_frame(spark, library, tmp_path):
    df = odd_frame(spark).unionByName(documents(spark, ["no id"]).selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    manifest = write(df.repartition(3), FILE, f"file://{tmp_path}/t")
    rows = read(spark, manifest).collect()
    assert len(rows) == len(ODD) + 2
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *sorted([*range(len(ODD)), 9])]
    at = 0
    for r in rows:
        ids = [*library.encode("no id" if r.doc_id is None else ODD[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sum(f["n_docs"] for f in manifest) == len(rows) and open_file(manifest[0]["path"]).width == 2
    empty = write(documents(spark, []), FILE, f"file://{tmp_path}/e")
    assert empty == [] and read(spark, empty).count() == 0


def test_files_are_rolled(spark, tmp_path, monkeypatch):
    """A task begins a new file at the bound; ids shared by many rows are dealt to several tasks."""
    import hduframe.llm.token_files as tf

    texts = [f"text number {k} of all " * (k % 7) for k in range(300)]
    docs = spark.createDataFrame([(None if k % 3 == 0 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = write(docs, FILE, f"file://{tmp_path}/a")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({f["part"] for f in files if f["n_docs"]}) == 4 and max(f["n_docs"] for f in files) < 130  # a hundred null ids

    class Task:  # the mapped function, run here, where the small bounds hold
        partitionId = staticmethod(lambda: 3)
        taskAttemptId = staticmethod(lambda: 5)
        get = classmethod(lambda cls: cls)

    monkeypatch.setattr(tf, "FILE_DOCS", 40)
    monkeypatch.setattr(tf, "FILE_BYTES", 2000)
    monkeypatch.setattr(tf, "TaskContext", Task)
    run = {}

    class Frame:
        columns = docs.columns
        select = repartitionByRange = sortWithinPartitions = lambda self, *a: self

        def mapInArrow(self, f, schema):
            run["f"] = f
            return self

        def collect(self):
            return []

    write(Frame(), FILE, f"file://{tmp_path}/b")
    made = [x for b in run["f"](iter(docs.toArrow().to_batches(max_chunksize=50))) for x in b.to_pylist()]
    assert [f["k"] for f in made] == list(range(len(made))) and len(made) > 6 and all(f["n_docs"] <= 40 for f in made)
    every = [(d, a.tolist()) for f in made for d, a in open_file(f["path"]).each()]
    assert every == [(r.doc_id, np.frombuffer(encoder(FILE)(r.text), "<u4").tolist() + [0]) for r in docs.collect()]
