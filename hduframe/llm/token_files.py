"""Token ids in files of independent zstandard frames.

A file is a run of zstandard frames, then a skippable frame with the documents' index, then the seek table of the
public seekable format (a skippable frame: compressed size, size and the low 32 bits of XXH64 for each frame, then a
footer).  Any zstandard reader can decompress the file; a reader of one document seeks to the frames that hold it,
decompresses only these and compares their checksums.  Files hold documents in ascending doc_id order over all files;
the manifest has a row for each file.  A task begins a new file beyond FILE_BYTES of ids or FILE_DOCS documents, so files and what a writer
holds are bounded whatever the shuffle's partitions; only one document, which lies in one file, can be longer.  A task writes under a name of its own
and moves the whole file into place, so a task that runs twice leaves one whole file.

Null texts count as empty; a null doc_id comes first and is read back as null; equal ids are ordered by a hash of their text and then the
text, and a range of rows may end between them, so very many equal or null ids aren't one task's.  Repeated rows are all written.
An empty table gives no files and no rows.  Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layout import filesystem
from .common import Cache, Scratch, slices

#: Fixed values of the seekable format.
SEEK_MAGIC, SKIP_SEEK, SKIP_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
INDEX = np.dtype([("doc", "<i8"), ("null", "u1"), ("n", "<u8")])
FRAME_BYTES = 1 << 18
FILE_BYTES, FILE_DOCS = 256 << 20, 1 << 20
#: White space of the tokenizer's split pattern; Python counts four control characters more as such.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: The tokenizer's split pattern for characters below U+0250, where these eight are the only numbers but the digits.
SPLIT = re.compile(r" ?[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: All others: beyond them the two regex libraries could hold different Unicode versions, and four count as white space in one alone.
ODD = re.compile("[^\x00-\x1b\x20-\u024f]")
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Byte-level BPE of the tokenizers library; ids of words are kept, and of white-space-led chunks of texts with odd characters."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.all = Tokenizer.from_file(file)
        self.model = self.all.model
        self.special = [t.content for t in self.all.get_added_tokens_decoder().values()]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(plain)]
        self.table = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}
        self.word = Cache(self._word, 800_000)
        self.chunk = Cache(self._chunk, 200_000)

    def _word(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.table))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def _chunk(self, chunk: str) -> bytes:
        return self.whole(chunk) if ODD.search(chunk) else b"".join(map(self.word.__getitem__, SPLIT.findall(chunk)))

    def whole(self, text: str) -> bytes:
        return np.array(self.all.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        if ODD.search(text):
            return b"".join(map(self.chunk.__getitem__, CHUNK.findall(text)))
        return b"".join(map(self.word.__getitem__, SPLIT.findall(text)))


def encoder(file: str) -> Encoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


class FrameWriter:
    """Writes documents to an open binary file; ids that fit go as 16 bits."""

    def __init__(self, sink, width: int, frame_bytes: int = FRAME_BYTES):
        self.sink, self.kind, self.frame_bytes = sink, f"<u{width}", frame_bytes
        self.pending, self.held, self.frames, self.docs, self.tokens = [], 0, [], [], 0
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc: int | None, ids: bytes) -> None:
        """ids: little-endian 32-bit integers."""
        n = len(ids) // 4
        self.docs.append((doc or 0, doc is None, n))
        self.tokens += n
        raw = ids if self.kind == "<u4" else np.frombuffer(ids, "<u4").astype(self.kind).tobytes()
        for at in range(0, len(raw), self.frame_bytes):
            piece = raw[at : at + self.frame_bytes]
            self.pending.append(piece)
            self.held += len(piece)
            if self.held >= self.frame_bytes:
                self.flush()

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.pending)
            packed = self.packer.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = struct.pack("<B", int(self.kind[2:])) + self.packer.compress(np.array(self.docs, INDEX).tobytes())
        self.sink.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)


class FrameReader:
    """Reads from an open seekable binary file."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        head = size - 17 - 12 * n
        if struct.unpack("<II", self._at(head, 8)) != (SKIP_SEEK, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(self._at(head + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.from_byte = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.from_raw = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        at = int(self.from_byte[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != SKIP_INDEX or at + 8 + length != head:
            raise ValueError("the index is damaged")
        index = self._at(at + 8, length)
        self.width = index[0]
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(index[1:]), INDEX)
        self.from_token = np.concatenate([[0], np.cumsum(self.docs["n"], dtype=np.int64)])

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        packed, size, check = self.frames[k].tolist()
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.from_byte[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def each(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents, in the file's order, a frame at a time."""
        held, k = b"", 0
        for doc, null, n in self.docs.tolist():
            parts, need = [held], n * self.width - len(held)
            while need > 0:
                parts.append(self.frame(k))
                need -= len(parts[-1])
                k += 1
            raw = b"".join(parts)
            yield None if null else doc, np.frombuffer(raw[: n * self.width], f"<u{self.width}")
            held = raw[n * self.width :]

    def get(self, doc: int) -> list[np.ndarray]:
        """The documents of this id; only the frames that hold them are decompressed."""
        out = []
        for k in np.flatnonzero((self.docs["doc"] == doc) & (self.docs["null"] == 0)).tolist():
            a, b = (int(x) * self.width for x in self.from_token[k : k + 2])
            first, last = np.searchsorted(self.from_raw, [a, max(a, b - 1)], "right") - 1
            raw = b"".join(self.frame(f) for f in range(first, last + 1)) if b > a else b""
            skip = a - int(self.from_raw[first]) if b > a else 0
            out.append(np.frombuffer(raw[skip : skip + b - a], f"<u{self.width}"))
        return out


def open_file(path: str) -> FrameReader:
    """A token file by its path in any store that pyarrow knows."""
    store, name = filesystem(path)
    return FrameReader(store.open_input_file(name), store.get_file_info(name).size)


def read_bytes(data: bytes) -> FrameReader:
    return FrameReader(io.BytesIO(data), len(data))


def write(df: DataFrame, tokenizer_file: str, folder: str, end_id: int = 0, doc: str = "doc_id", text: str = "text") -> list[dict]:
    """Encodes and writes all texts; returns the manifest, a row for each file in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encode, end = encoder(tokenizer_file), end_id.to_bytes(4, "little")
        width = 2 if max(encode.all.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        task = TaskContext.get()
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        sink, k = None, 0

        def close() -> pa.RecordBatch:
            w.close()
            sink.close()
            if not isinstance(store, pafs.LocalFileSystem) and store.get_file_info(name).type == pafs.FileType.File:
                store.delete_file(name)
            store.move(own, name)
            return pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "k": pa.array([k], pa.int32()), "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_docs": pa.array([len(w.docs)], pa.int64()), "n_tokens": pa.array([w.tokens], pa.int64())})

        for group in ([first], batches):
            for part in slices(iter(group), 256):
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if sink and (w.tokens * width >= FILE_BYTES or len(w.docs) >= FILE_DOCS):
                        yield close()
                        sink, k = None, k + 1
                    if not sink:
                        name = f"{base}/tokens-{task.partitionId():06d}-{k:04d}.zst"
                        own = f"{name}.{task.taskAttemptId()}"
                        sink = store.open_output_stream(own)
                        w = FrameWriter(sink, width)
                    w.add(d, encode(t) + end)
        yield close()

    by = [F.col(doc), F.xxhash64(text)]
    ordered = df.select(doc, text).repartitionByRange(*by).sortWithinPartitions(*by, text)
    files = ordered.mapInArrow(run, "part int, k int, path string, n_docs long, n_tokens long").collect()  # a row a file
    return [r.asDict() for r in sorted(files)]


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """All documents of the files: doc_id, start (ids before it), n_tokens and ids_crc32 of 32-bit ids."""
    base, rows = 0, []
    for f in manifest:
        rows.append((f["path"], base))
        base += f["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                for d, ids in open_file(path).each():
                    out.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 4096:
                        yield rows_of(out)
                        out = []
                yield rows_of(out)

    return spark.createDataFrame(rows, "path string, start long").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """op4: token files of all documents in the shared folder, read back."""
    return read(spark, write(docs, tokenizer_file, Scratch(spark, "token-files").path("files")))
