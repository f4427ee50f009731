"""SentencePiece BPE by backtracking over longest matches, and its decoding.

A segmentation is the one that the merges give if and only if each two neighbouring tokens stay as they are
when their joined text is merged anew.  So the encoder walks a chunk from the left with the longest token that an
Aho-Corasick automaton found there, takes it if it is compatible with the token before, else the next shorter one,
and steps back where none is left; a bit field holds the positions from which no encoding was found, so that none is
tried twice.  Pieces hold the space mark only in front, and some characters in no piece at all, so texts
fall into chunks whose encodings are independent; chunks repeat, and a bounded cache holds their ids.

Null and empty texts give no ids and decode to "".  Texts of any length are encoded whole, a long chunk in time in proportion to its length and
without being kept in the cache.  Each row gets its own result, repeated rows equal ones; doc_id isn't looked at.  Extra columns are kept;
columns named like the results are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, keep_fields, slices

MARK = "▁"
_CODECS: dict[str, "Codec"] = {}


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.unk = sp.unk_id()
        self.byte = {bytes([int(self.piece[i][3:5], 16)])[0]: i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.piece) if not special[i]}
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds the space mark behind other characters")
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        # tokens that merging their own text does give; others never come out
        self.tokens = {p: i for p, i in self.id.items() if len(p) == 1 or self.merge(p) == [p]}
        self.chars = frozenset(p for p in self.tokens if len(p) == 1)
        auto = ahocorasick.Automaton()
        for p, i in self.tokens.items():
            auto.add_word(p, (i, len(p)))
        auto.make_automaton()
        self.auto = auto
        #: By id: the longest other token that it begins with, or -1; its length.
        self.shorter = [next((self.tokens[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.tokens), -1) if p in self.tokens else -1 for p in self.piece]
        self.length = [len(p) for p in self.piece]
        self.pairs = Cache(self.compatible, 1_000_000)
        inside = {c for p in self.id for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        letters = r"[^\W\d_]"
        others = f"(?:[^\\w {MARK}{alone}]|[\\d_])"
        if any(re.search(f"{letters}[^\\w{MARK}]|{letters}[\\d_]|(?:[^\\w{MARK}]|[\\d_]){letters}", p) for p in self.id):
            word = f"[^ {MARK}{alone}]+"
        else:  # no piece holds letters beside other characters, so that these are chunks of their own
            word = f"(?:{letters}+|{others}+)"
        self.chunks = re.compile(f"[ {MARK}]*{word}|[ {MARK}]+" + (f"|[{alone}]" if alone else ""))
        self.pack = [i.to_bytes(4, "little") for i in range(n)]
        self.utf8 = {self.pack[i]: bytes([self.byte_of[i]]) if i in self.byte_of else self.piece[i].encode() for i in range(n)}
        self.ids = Cache(lambda chunk: b"".join(map(self.pack.__getitem__, self.encode_chunk(chunk.replace(" ", MARK)))), 500_000)
        self.text = Cache(self.decode_bytes, 500_000)

    def merge(self, text: str) -> list[str]:
        """The merges as the model defines them: the best score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        known, start = self.tokens, 0
        if self.chars.issuperset(chunk):
            return self.backtrack(chunk)
        for k, c in enumerate(chunk):  # characters without a piece merge with nothing and become bytes
            if c not in known:
                out += self.backtrack(chunk[start:k])
                out += [self.byte[b] for b in c.encode()]
                start = k + 1
        return out + self.backtrack(chunk[start:] if start else chunk)

    def compatible(self, pair: int) -> bool:
        """Whether two tokens (id * 2**32 + id) stay as they are when their joined text is merged."""
        left, right = self.piece[pair >> 32], self.piece[pair & 0xFFFFFFFF]
        return self.merge(left + right) == [left, right]

    def backtrack(self, text: str) -> list[int]:
        """The ids of a text in which each character is a token."""
        if text in self.tokens:
            return [self.tokens[text]]
        n = len(text)
        if not n:
            return []
        longest = [-1] * n
        for end, (i, size) in self.auto.iter(text):  # of one start, the later end is the longer
            longest[end - size + 1] = i
        shorter, length, pairs = self.shorter, self.length, self.pairs
        failed = 0  # a bit for each position from which no encoding was found
        path: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            while token >= 0:
                end = at + length[token]
                if (before < 0 or pairs[before << 32 | token]) and not (failed and failed >> end & 1):
                    break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                if end == n:
                    return path
                at, before, token = end, token, longest[end]
            else:
                failed |= 1 << at
                token = path.pop()
                at -= length[token]
                before = path[-1] if path else -1
                token = shorter[token]

    def decode_bytes(self, raw: bytes) -> bytes:
        """UTF-8 bytes of ids, the space mark still in place."""
        utf8 = self.utf8
        return b"".join([utf8[raw[k : k + 4]] for k in range(0, len(raw), 4)])

    def encode(self, text: str | None) -> list[bytes]:
        """Ids as little-endian integers, in runs that decode one by one."""
        if not text:
            return []
        chunks = self.chunks.findall(text)
        if chunks[0][0] in "\n\t\r" and len(chunks[0]) == 1 and chunks[0] not in self.tokens:
            chunks.insert(0, " ")
        else:
            chunks[0] = " " + chunks[0]
        return list(map(self.ids.__getitem__, chunks))

    def decode(self, runs: list[bytes]) -> str:
        text = b"".join(map(self.text.__getitem__, runs)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def codec(model_file: str) -> Codec:
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode_decode(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of each text (array<int>) and what they decode to (string)."""
    keep = keep_fields(df.schema, (ids, decoded))
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for part in slices(batches, 256):
            runs = [c.encode(t) for t in part.column(text).to_pylist()]
            flat = [b"".join(r) for r in runs]
            at = np.zeros(len(flat) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in flat], out=at[1:])
            values = pa.array(np.frombuffer(b"".join(flat), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in names), pa.ListArray.from_arrays(pa.array(at), values), pa.array(map(c.decode, runs), pa.string())],
                names=[*names, ids, decoded],
            )

    same = names if text in names else [*names, text]
    return df.select(*same).mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """op1: the digest columns of ids and decoded text."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
