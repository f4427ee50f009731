import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD, documents, odd_frame

from hduframe.llm.sentencepiece_codec import codec, digests, encode_decode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(c, text):
    return [int.from_bytes(r[k : k + 4], "little") for r in c.encode(text) for k in range(0, len(r), 4)]


def test_like_the_library(library):
    c, r = codec(MODEL), random.Random(5)
    alphabet = " ▁\n\t\rabcdeéñ漢字😀<s>0x'\x00 　 the in </s>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)] + ["</s>", "<0x0A>", "▁", " a", "a ", "a" * 3000, " " * 100, "=-" * 50, "�", "internationalization" * 20]
    for t in [*texts, *(x for x in ODD if x)]:
        want = library.encode(t)
        assert ids(c, t) == want
        assert c.decode(c.encode(t)) == library.decode(want)


def test_steps_back_when_no_token_fits():
    """Where the longest match leads nowhere the walk must come back; merges decide."""
    c, r = codec(MODEL), random.Random(9)
    letters = sorted(c.chars - {"▁"})[:400] + list("aeiourstln" * 20)
    for _ in range(2000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(1, 25)))
        assert [c.piece[i] for i in c.backtrack(t)] == c.merge(t)


def test_frame(spark, library):
    out = encode_decode(odd_frame(spark), MODEL)
    rows = out.collect()
    assert out.schema["ids"].dataType.simpleString() == "array<int>" and "key" in out.columns and len(rows) == len(ODD) + 1
    for r in rows:
        assert r.ids == library.encode(ODD[r.doc_id] or "") and r.decoded == library.decode(r.ids)
    d = {r.doc_id: r for r in digests(out).collect()}
    assert d[0].n_tokens == 0 and d[0].ids_sha256 == hashlib.sha256(b"").hexdigest() == d[1].decoded_sha256
    assert d[8].ids_sha256 == hashlib.sha256(",".join(map(str, library.encode(ODD[8]))).encode()).hexdigest()
    assert encode_decode(documents(spark, []), MODEL).count() == 0
