"""Writing FITS: by default a folder with whole files, some for each task; with ``single`` one file.

Options: hdu (bintable, ascii, image), extname, checksum, single, tforms (``name=8A;other=1PJ``), axes and bitpix (image; axis
1 first), primary (image: in the first HDU), cards (a list of (name, value, comment) as JSON), fileBytes, longest (TFORMs of
variable-length columns name the longest cell).
Tasks write below a folder beside the target; the commit moves whole files into place.  For ``single`` and images the commit
copies the tasks' parts one behind the other, once, a block at a time, and moves the heaps' addresses on; checksums are those of the parts, summed up
by the tasks as they write, turned to where the parts come to lie, with what the moved addresses add.  Images need the columns row_index and values; parts are ordered by
the first row_index of each, so rows must be sorted by it over all partitions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from ..errors import InvalidTable, SizeMismatch
from ..functions.checksum import Checksum, checksum, combine, fold, stamp, turned
from .cards import Card, Header
from .encode import BITPIX_OF, ascii_header, bintable_header, empty_primary, encode_ascii, encode_pixels, encode_rows, image_header
from .layout import filesystem, padded
from .tform import NUMPY, Binary, for_spark, parse_ascii

FILE_BYTES = 64 << 20
CHUNK = 4 << 20  # bytes that are copied, or made of a batch's rows, at a time


@dataclass
class Piece:
    """What a task wrote: a whole file, or the rows and the heap of a part."""

    path: str
    first: int
    nrows: int
    body: int
    heap: int
    sums: tuple[int, int] = (0, 0)  # checksums of rows and heap
    most: tuple[int, ...] = ()  # of each variable-length column the elements of the longest cell


@dataclass
class Done(WriterCommitMessage):
    pieces: list[Piece] = field(default_factory=list)


def cards_of(options: dict) -> list[Card]:
    return [Card(n, tuple(v) if isinstance(v, list) else v, c) for n, v, c in json.loads(options.get("cards", "[]"))]


class FitsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.options, self.table, self.overwrite = options, schema, overwrite
        self.path = options["path"]
        self.kind = options.get("hdu", "bintable")
        self.single = options.get("single", "false").lower() == "true" or self.kind == "image"
        self.sums = options.get("checksum", "false").lower() == "true"
        self.work = f"{self.path.rstrip('/')}.writing-{uuid.uuid4().hex}"
        named = dict(x.split("=", 1) for x in options.get("tforms", "").split(";") if x)
        if self.kind == "image":
            if "values" not in schema.names or "row_index" not in schema.names:
                raise InvalidTable("an image is written from columns row_index and values")
            t = schema["values"].dataType.elementType
            self.bitpix = int(options.get("bitpix", BITPIX_OF[type(t)]))
            self.axes = [int(x) for x in options["axes"].split(",")]
        elif self.kind == "ascii":
            self.forms = [parse_ascii(named.get(f.name) or (f.metadata or {}).get("tform")) for f in schema.fields]
        else:
            self.forms = [for_spark(f.dataType, named.get(f.name) or (f.metadata or {}).get("tform")) for f in schema.fields]
        #: Of a binary table: where the descriptors of variable-length columns lie in a row, and a row's bytes.
        self.places: list[tuple[int, Binary]] = []
        self.width = 0
        if self.kind == "bintable":
            for f in self.forms:
                if f.of:
                    self.places.append((self.width, f))
                self.width += f.size

    # ---- on executors

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        task = TaskContext.get()
        fs, work = filesystem(self.work)
        fs.create_dir(work, recursive=True)
        name = f"{work}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        limit = (1 << 62) if self.single else int(self.options.get("filebytes", FILE_BYTES))
        done, k, first = Done(), 0, -1
        rows: list[bytes] = []
        heap: list[bytes] = []
        size = heap_size = n = 0
        sums, most = (Checksum(), Checksum()), np.zeros(len(self.places), np.int64)

        def close() -> None:
            nonlocal rows, heap, size, heap_size, n, k, first, sums, most
            if self.single:
                body.close()
                tail.close()
            else:
                with fs.open_output_stream(f"{name}-{k}.fits") as out:
                    self._file(out, n, rows, heap, most)
            done.pieces.append(Piece(f"{name}-{k}" + ("" if self.single else ".fits"), first, n, size, heap_size, (sums[0].finish(), sums[1].finish()), tuple(most.tolist())))
            rows, heap, size, heap_size, n, first = [], [], 0, 0, 0, -1
            sums, most = (Checksum(), Checksum()), np.zeros(len(self.places), np.int64)
            k += 1

        if self.single:  # parts go to files as they come
            body, tail = fs.open_output_stream(f"{name}-0"), fs.open_output_stream(f"{name}-0.heap")
        for batch in batches if self.kind == "image" else _cut(batches):
            if not batch.num_rows:
                continue
            if self.kind == "image":
                t = pa.Table.from_batches([batch]).sort_by("row_index")
                if first < 0:
                    first = t.column("row_index")[0].as_py()
                raw, more = encode_pixels(t.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False), self.bitpix), b""
            elif self.kind == "ascii":
                raw, more = encode_ascii(batch, self.forms), b""
            else:
                matrix, more = encode_rows(batch, self.forms, heap_size)
                raw = matrix.tobytes()
                for j, (at, f) in enumerate(self.places):
                    lengths = np.ascontiguousarray(matrix[:, at : at + f.size]).view(NUMPY[f.code])[:, 0]
                    most[j] = max(most[j], int(lengths.max(initial=0)))
            if self.single:
                body.write(raw)
                tail.write(more)
                if self.sums:
                    sums[0].update(raw)
                    sums[1].update(more)
            else:
                rows.append(raw)
                heap.append(more)
            size, heap_size, n = size + len(raw), heap_size + len(more), n + batch.num_rows
            if size + heap_size >= limit:
                close()
        if n or self.single or task.partitionId() == 0 and not done.pieces:
            close()
        return done

    def _header(self, n: int, heap: int, most=()) -> Header:
        name, extra = self.options.get("extname"), cards_of(self.options)
        if self.kind == "image":
            return image_header(self.bitpix, self.axes, self.options.get("primary", "false").lower() == "true", name, extra)
        if self.kind == "ascii":
            return ascii_header(self.table.fields, self.forms, n, name, extra)
        forms = list(self.forms)
        if self.options.get("longest", "false").lower() == "true":
            longest = iter(most)
            forms = [replace(f, most=int(next(longest))) if f.of else f for f in forms]
        return bintable_header(self.table.fields, forms, n, heap, name, extra)

    def _file(self, out, n: int, rows: list[bytes], heap: list[bytes], most=()) -> None:
        """A whole file; rows and heap come in pieces and aren't put together in memory."""
        after = sum(map(len, heap))
        size = sum(map(len, rows)) + after
        pad = (b" " if self.kind == "ascii" else b"\0") * (padded(size) - size)
        out.write(primary(self.sums))
        h = self._header(n, after, most)
        if self.sums:
            total = Checksum()
            for raw in (*rows, *heap, pad):
                total.update(raw)
            h = stamp(h, total.finish())
        out.write(h.to_bytes())
        for raw in (*rows, *heap, pad):
            out.write(raw)

    # ---- on the driver

    def commit(self, messages: list[Done | None]) -> None:
        fs, work = filesystem(self.work)
        _, path = filesystem(self.path)
        pieces = [p for m in messages if m for p in m.pieces]
        there = fs.get_file_info(path).type
        if there != pafs.FileType.NotFound and not self.overwrite and self.single:
            raise InvalidTable(f"{self.path} exists")
        if self.options.get("parts", "false").lower() == "true":
            with fs.open_output_stream(path) as out:  # for FitsBuilder, which joins them
                out.write(json.dumps({"work": work, "pieces": [asdict(p) for p in pieces]}).encode())
            return
        if self.single:
            own = f"{work}/whole"
            with fs.open_output_stream(own) as out:
                self._join(fs, out, pieces)
            _remove(fs, path, there)
            fs.move(own, path)
        else:
            if self.overwrite:
                _remove(fs, path, there)
            fs.create_dir(path, recursive=True)
            tag = uuid.uuid4().hex[:8]
            for p in [p for p in pieces if p.nrows] or pieces[:1]:  # a table without rows is one file
                fs.move(p.path, f"{path}/{p.path.rsplit('/', 1)[1].removesuffix('.fits')}-{tag}.fits")
        fs.delete_dir(work)

    def _join(self, fs, out, pieces: list[Piece], begins: bool = True) -> None:
        """One HDU of the pieces, behind an empty primary HDU if the file begins with it."""
        if self.kind == "image":
            pieces = sorted((p for p in pieces if p.nrows), key=lambda p: p.first)
        n, rows, heap = sum(p.nrows for p in pieces), sum(p.body for p in pieces), sum(p.heap for p in pieces)
        if self.kind == "image" and rows != (expected := int(np.prod(self.axes)) * abs(self.bitpix) // 8):
            raise SizeMismatch(f"pixels of {rows} bytes, the axes need {expected}")
        fill = b" " if self.kind == "ascii" else b"\0"
        pad = fill * (padded(rows + heap) - rows - heap)
        is_primary = self.kind == "image" and self.options.get("primary", "false").lower() == "true"
        if begins and not is_primary:
            out.write(primary(self.sums))
        h = self._header(n, heap, np.max([p.most for p in pieces], axis=0) if pieces else np.zeros(len(self.places), np.int64))
        if self.sums:
            h = stamp(h, self._datasum(pieces, pad))
        out.write(h.to_bytes())
        for raw in self._parts(fs, pieces):
            out.write(raw)
        out.write(pad)

    def _datasum(self, pieces: list[Piece], pad: bytes) -> int:
        """Of the parts' own sums, without a look at their bytes."""
        total, at, base, row = 0, 0, 0, 0
        for p in pieces:
            total = combine(total, turned(p.sums[0], at))
            # every address of the part is moved on by ``base``, at places that turn with the rows, four rows to a round
            for place, f in self.places:
                for k in range(min(4, p.nrows)):
                    times = -(-(p.nrows - k) // 4)
                    end = (row + k) * self.width + place + f.size  # an address is the last half of its descriptor
                    total = combine(total, turned(fold(base * times), end))
            at, base, row = at + p.body, base + p.heap, row + p.nrows
        for p in pieces:
            total = combine(total, turned(p.sums[1], at))
            at += p.heap
        return combine(total, checksum(pad, at))

    def _parts(self, fs, pieces: list[Piece]) -> Iterator[bytes]:
        """All rows, their addresses moved on by the heaps of the pieces before, then all heaps."""
        places, width = self.places, self.width
        base = 0
        for p in pieces:
            with fs.open_input_stream(p.path) as part:
                while raw := part.read(max(1, CHUNK // width) * width if places else CHUNK):
                    yield _moved(raw, width, places, base) if places and base else raw
            base += p.heap
        for p in pieces:
            if p.heap:
                with fs.open_input_stream(f"{p.path}.heap") as part:
                    while raw := part.read(CHUNK):
                        yield raw

    def abort(self, messages: list[Done | None]) -> None:
        fs, work = filesystem(self.work)
        if fs.get_file_info(work).type == pafs.FileType.Directory:
            fs.delete_dir(work)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes."""
    for batch in batches:
        each = max(1, batch.num_rows * CHUNK // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)


def _moved(raw: bytes, width: int, places: list[tuple[int, Binary]], base: int) -> bytes:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, width).copy()
    for at, f in places:
        pair = np.ascontiguousarray(rows[:, at : at + f.size]).view(NUMPY[f.code])
        moved = pair[:, 1].astype(np.int64) + base
        if len(moved) and moved.max() > np.iinfo(np.dtype(NUMPY[f.code])).max:
            raise InvalidTable("the heap is too large for P descriptors; use Q")
        pair[:, 1] = moved
        rows[:, at : at + f.size] = pair.view(np.uint8).reshape(len(rows), f.size)
    return rows.tobytes()


def _remove(fs, path: str, kind) -> None:
    if kind == pafs.FileType.File:
        fs.delete_file(path)
    elif kind == pafs.FileType.Directory:
        fs.delete_dir(path)


def primary(sums: bool) -> bytes:
    return (stamp(empty_primary(), 0) if sums else empty_primary()).to_bytes()


def write(df: DataFrame, path: str, **options) -> None:
    """Writes a table or image over what is at path."""
    from .fits_source import register

    register(df.sparkSession)
    df.write.format("fits").mode("overwrite").options(**as_text(options)).save(path)


def as_text(options: dict) -> dict[str, str]:
    """Options as Spark takes them."""
    return {k.lower(): json.dumps(v) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}


class FitsBuilder:
    """Collects HDUs and writes them to one file: the first image may be primary, the rest are extensions."""

    def __init__(self):
        self.parts: list[tuple[DataFrame, dict]] = []

    def image(self, df: DataFrame, axes: list[int], extname: str | None = None, **options) -> FitsBuilder:
        return self._add(df, hdu="image", axes=",".join(map(str, axes)), extname=extname, **options)

    def primary_image(self, df: DataFrame, axes: list[int], **options) -> FitsBuilder:
        if self.parts:
            raise InvalidTable("the primary image comes first")
        return self.image(df, axes, primary=True, **options)

    def bintable(self, df: DataFrame, extname: str | None = None, **options) -> FitsBuilder:
        return self._add(df, hdu="bintable", extname=extname, **options)

    def ascii_table(self, df: DataFrame, tforms: str, extname: str | None = None, **options) -> FitsBuilder:
        return self._add(df, hdu="ascii", tforms=tforms, extname=extname, **options)

    def _add(self, df: DataFrame, **options) -> FitsBuilder:
        self.parts.append((df, {k: v for k, v in options.items() if v is not None}))
        return self

    def save(self, path: str, checksum: bool = False) -> None:
        """Each HDU's parts are written by its own job; then all parts are copied, once, one HDU behind the other."""
        fs, name = filesystem(path)
        own = f"{name}.building-{uuid.uuid4().hex}"
        head = path[: len(path) - len(name)]
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(own) as out:
            if not (self.parts and self.parts[0][1].get("primary")):
                out.write(primary(checksum))
            for k, (df, options) in enumerate(self.parts):
                part = f"{own}.{k}"
                options = {"single": True, "parts": True, "checksum": checksum, **options}
                write(df, head + part, **options)
                with fs.open_input_stream(part) as src:
                    made = json.loads(src.read())
                FitsWriter({"path": path, **as_text(options)}, df.schema, True)._join(fs, out, [Piece(**p) for p in made["pieces"]], begins=False)
                fs.delete_dir(made["work"])
                fs.delete_file(part)
        there = fs.get_file_info(name).type
        _remove(fs, name, there)
        fs.move(own, name)


